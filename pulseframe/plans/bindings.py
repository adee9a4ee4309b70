"""Logical tables of the library expressed over the TPC-H-like driver tables.

Each binding has a DataFrame form and the same view as SQL text, used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def millis(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_millis(col.cast("timestamp"))


# ---- beats: one row per event, record = user, clock in ms -------------------------------

SYMBOLS = {"view": "N", "click": "A", "purchase": "V", "signup": "F", "error": "~"}
LABELS = {"view": "N", "click": "S", "purchase": "V", "signup": "F", "error": "Q"}

BEATS_SQL = """beats AS (
  SELECT CAST(user_id % 3 AS BIGINT) AS dataset, user_id AS record_id, event_id,
         epoch_us(ts) // 1000 AS peak,
         CASE event_type WHEN 'view' THEN 'N' WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'V'
              WHEN 'signup' THEN 'F' ELSE '~' END AS symbol,
         CASE event_type WHEN 'view' THEN 'N' WHEN 'click' THEN 'S' WHEN 'purchase' THEN 'V'
              WHEN 'signup' THEN 'F' ELSE 'Q' END AS label,
         value
  FROM events)"""


def _mapped(col: str, mapping: dict[str, str], default: str):
    expr = None
    for k, v in mapping.items():
        if v == default:
            continue
        expr = F.when(F.col(col) == k, v) if expr is None else expr.when(F.col(col) == k, v)
    return expr.otherwise(default)


def beats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") % 3).cast("long").alias("dataset"),
        F.col("user_id").alias("record_id"),
        "event_id",
        millis("ts").alias("peak"),
        _mapped("event_type", SYMBOLS, "~").alias("symbol"),
        _mapped("event_type", LABELS, "Q").alias("label"),
        "value",
    )


# Width of the time buckets that bound the rows of one task: one day.
BEAT_BUCKET = 86_400_000

# ---- tracking: customer = experiment, orders = run, lineitem = metric, events = alert ----

EXPERIMENT_SQL = """experiment AS (
  SELECT c_custkey AS id, c_name AS name,
         CASE CAST(c_nationkey % 3 AS INTEGER) WHEN 0 THEN 'stage1' WHEN 1 THEN 'stage2' ELSE 'pretrain' END AS stage,
         c_mktsegment AS owner_id,
         CASE WHEN c_custkey % 3 = 0
              THEN '{"model_name":"m' || (c_custkey % 7) || '","baseline_f1_macro":0.0' || (c_custkey % 10) || '}'
              WHEN c_custkey % 3 = 1
              THEN '{"baseline_f1_macro":"0.0' || (c_custkey % 10) || '","baseline_loss":0.05}'
              ELSE '{"baseline_accuracy":0.04}' END AS extra
  FROM customer)"""
RUN_SQL = """run AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS experiment_id,
         CASE o.o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status,
         CASE CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) WHEN 1 THEN 'train' WHEN 2 THEN 'test' ELSE 'other' END AS run_type,
         CAST(o.o_orderkey % 5 AS INTEGER) AS fold_idx, o.o_orderdate AS start_time, e.end_time,
         CASE WHEN o.o_orderkey % 4 = 0 THEN '{"model_name":"r' || (o.o_orderkey % 11) || '"}' ELSE '{}' END AS extra
  FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS end_time FROM lineitem GROUP BY 1) e
       ON e.l_orderkey = o.o_orderkey)"""
METRIC_SQL = """metric AS (
  SELECT l_orderkey AS run_id,
         CASE l_suppkey % 4 WHEN 0 THEN 'history' WHEN 1 THEN 'per_class' ELSE 'global' END AS namespace,
         CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'accuracy' WHEN 'AO' THEN 'loss' WHEN 'NF' THEN 'F1_macro'
              WHEN 'NO' THEN 'F1-macro' WHEN 'RF' THEN 'auc_roc' ELSE 'val_loss' END AS name,
         l_discount AS value, l_linenumber AS step, l_shipdate AS recorded_at, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)"""
ALERT_SQL = """alert AS (
  SELECT event_id AS id, event_id % (SELECT count(*) FROM orders) AS run_id,
         CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'info' ELSE 'warning' END AS severity,
         CASE WHEN event_id % 2 = 0 THEN 'performance_drop' ELSE 'qg_failure' END AS category,
         value AS metric_value, ts AS recorded_at, (event_id % 3 = 0) AS resolved
  FROM events)"""
TRACKING_SQL = ",\n".join([EXPERIMENT_SQL, RUN_SQL, METRIC_SQL, ALERT_SQL])


def experiment(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    digit = (k % 10).cast("string")
    return table(spark, sf, "customer").select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.element_at(F.array(F.lit("stage1"), F.lit("stage2"), F.lit("pretrain")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("stage"),
        F.col("c_mktsegment").alias("owner_id"),
        F.when(k % 3 == 0, F.concat(F.lit('{"model_name":"m'), (k % 7).cast("string"), F.lit('","baseline_f1_macro":0.0'), digit, F.lit("}")))
        .when(k % 3 == 1, F.concat(F.lit('{"baseline_f1_macro":"0.0'), digit, F.lit('","baseline_loss":0.05}')))
        .otherwise('{"baseline_accuracy":0.04}')
        .alias("extra"),
    )


def run(spark: SparkSession, sf: str) -> DataFrame:
    ends = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end_time"))
    k = F.col("o_orderkey")
    pr = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf, "orders").join(ends, k == F.col("l_orderkey"), "left").select(
        k.alias("id"),
        F.col("o_custkey").alias("experiment_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"),
        F.when(pr == "1", "train").when(pr == "2", "test").otherwise("other").alias("run_type"),
        (k % 5).cast("int").alias("fold_idx"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        F.col("end_time").cast("timestamp").alias("end_time"),
        F.when(k % 4 == 0, F.concat(F.lit('{"model_name":"r'), (k % 11).cast("string"), F.lit('"}'))).otherwise("{}").alias("extra"),
    )


def metric(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat("l_returnflag", "l_linestatus")
    s = F.col("l_suppkey") % 4
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.when(s == 0, "history").when(s == 1, "per_class").otherwise("global").alias("namespace"),
        F.when(code == "AF", "accuracy").when(code == "AO", "loss").when(code == "NF", "F1_macro")
        .when(code == "NO", "F1-macro").when(code == "RF", "auc_roc").otherwise("val_loss").alias("name"),
        F.col("l_discount").alias("value"),
        F.col("l_linenumber").alias("step"),
        F.col("l_shipdate").cast("timestamp").alias("recorded_at"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


def alert(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").agg(F.count("*").alias("n_runs"))
    k = F.col("event_id")
    return table(spark, sf, "events").join(F.broadcast(n)).select(
        k.alias("id"),
        (k % F.col("n_runs")).alias("run_id"),
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "info").otherwise("warning").alias("severity"),
        F.when(k % 2 == 0, "performance_drop").otherwise("qg_failure").alias("category"),
        F.col("value").alias("metric_value"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
        (k % 3 == 0).alias("resolved"),
    )


# ---- predictions: labelled documents, deterministic scores -------------------------------

SEEDS = (0, 1, 2)
PREDICTION_SQL = """prediction AS (
  SELECT d.doc_id AS sample_id, d.source AS patient_id, d.lang AS record_id, s.seed, CAST(d.doc_id % 5 AS BIGINT) AS fold,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 0 WHEN l.quality = 1 THEN 1 ELSE 2 END AS y_true,
         l.quality, l.toxic,
         ((d.n_chars * 7 + d.doc_id * 13 + s.seed * 31 + l.quality * 40 + l.toxic * 25) % 97 + 1) AS a,
         ((d.n_chars * 11 + d.doc_id * 5 + s.seed * 17 + l.toxic * 30) % 89 + 1) AS b,
         ((d.n_chars * 3 + d.doc_id * 19 + s.seed * 23 + (1 - l.quality) * 45) % 83 + 1) AS c
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
       CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed) s),
scored AS (
  SELECT *, CAST(a AS DOUBLE) / (a + b + c) AS p0, CAST(b AS DOUBLE) / (a + b + c) AS p1, CAST(c AS DOUBLE) / (a + b + c) AS p2,
         CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS y_pred
  FROM prediction)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    l = table(spark, sf, "labels")
    x = d.join(l, "doc_id").withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    n, i, s = F.col("n_chars"), F.col("doc_id"), F.col("seed")
    q, t = F.col("quality"), F.col("toxic")
    x = x.select(
        i.alias("sample_id"),
        F.col("source").alias("patient_id"),
        F.col("lang").alias("record_id"),
        "seed",
        (i % 5).alias("fold"),
        F.when((q == 1) & (t == 0), 0).when(q == 1, 1).otherwise(2).alias("y_true"),
        "quality",
        "toxic",
        ((n * 7 + i * 13 + s * 31 + q * 40 + t * 25) % 97 + 1).alias("a"),
        ((n * 11 + i * 5 + s * 17 + t * 30) % 89 + 1).alias("b"),
        ((n * 3 + i * 19 + s * 23 + (1 - q) * 45) % 83 + 1).alias("c"),
    )
    tot = F.col("a") + F.col("b") + F.col("c")
    return x.select(
        "*",
        (F.col("a").cast("double") / tot).alias("p0"),
        (F.col("b").cast("double") / tot).alias("p1"),
        (F.col("c").cast("double") / tot).alias("p2"),
        F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), 0).when(F.col("b") >= F.col("c"), 1).otherwise(2).alias("y_pred"),
    )


# Long multi-label form: two binary tasks per sample of seed 0.
MULTILABEL_SQL = """multilabel AS (
  SELECT sample_id, patient_id, fold, 'quality' AS class, CAST(quality AS INTEGER) AS y, p0 AS p FROM scored WHERE seed = 0
  UNION ALL
  SELECT sample_id, patient_id, fold, 'toxic', CAST(toxic AS INTEGER), p1 FROM scored WHERE seed = 0)"""


def multilabel(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).filter("seed = 0")
    return s.select(
        "sample_id", "patient_id", "fold",
        F.expr("stack(2, 'quality', cast(quality as int), p0, 'toxic', cast(toxic as int), p1) as (class, y, p)"),
    )


# ---- feature matrix ---------------------------------------------------------------------

FEATURE_SQL = """feature AS (
  SELECT vec_id, label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("dim", "value")
    ).withColumn("value", F.col("value").cast("double"))
