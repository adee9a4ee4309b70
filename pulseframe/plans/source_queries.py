"""Source-format and streaming queries; the texts are built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import catalog as Cat, logs as L, tables as Tb
from ..streaming import jobs as J
from . import bindings as B
from .registry import Registry
from .sequence_queries import R as SEQ

R = Registry()


def _headers(spark, sf):
    k = F.col("c_custkey")
    body = F.format_string("r%d 2 %d %d\nr%d.dat 16 200/mV 12 0 -5 %d 0 MLII\nr%d.dat 16 200/mV 12 0 7 11 0 V5\n# Age: %d\n# Sex: %s\n# Dx: 426177001,%d\n",
                           k, F.when(k % 2 == 0, 360).otherwise(250), F.when(k % 50 == 0, 0).otherwise((k + 1) * 100), k, k % 97, k, k % 90 + 1, F.when(k % 3 == 0, "f").otherwise("M"), k)
    return B.table(spark, sf, "customer").select(body.alias("value"), F.col("c_mktsegment").alias("dataset"), F.concat(F.lit("/h/"), k.cast("string")).alias("path"))


@R.add("s2_s3_catalog", """SELECT 'r' || c_custkey AS record_name, c_mktsegment AS dataset, CASE WHEN c_custkey % 2 = 0 THEN 360 ELSE 250 END AS fs, (c_custkey + 1) * 100 AS sig_len, round((c_custkey + 1) * 100 / CASE WHEN c_custkey % 2 = 0 THEN 360.0 ELSE 250.0 END::DOUBLE, 6) AS duration_sec,
 'MLII,V5' AS leads, CAST(c_custkey % 97 AS INTEGER) AS checksum, CAST(c_custkey % 90 + 1 AS INTEGER) AS age, CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS sex, '426177001,' || c_custkey AS diagnosis FROM customer WHERE c_custkey % 50 <> 0""")
def s2(spark, sf):
    good, _ = Cat.build_catalog(_headers(spark, sf))
    return good.select("record_name", "dataset", "fs", "sig_len", F.round("duration_sec", 6).alias("duration_sec"), F.array_join("sig_name", ",").alias("leads"), F.get("checksum", F.lit(0)).alias("checksum"), "age", "sex", "diagnosis")


@R.add("s2_catalog_status", "SELECT CASE WHEN c_custkey % 50 = 0 THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n FROM customer GROUP BY 1")
def s2b(spark, sf):
    return Cat.build_catalog(_headers(spark, sf))[1]


@R.add("s4_catalog_contract", "SELECT coalesce(e, 'valid') AS error, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 40 = 1 THEN 'malformed' WHEN c_custkey % 40 = 2 THEN 'missing fs' END AS e FROM customer) GROUP BY 1")
def s4(spark, sf):
    k = F.col("c_custkey")
    ok = F.to_json(F.struct(F.col("c_name").alias("record_name"), F.col("c_mktsegment").alias("dataset"), F.when(k % 40 != 2, 360).alias("fs"), F.lit(2).alias("n_sig"), (k * 10).alias("sig_len")))
    lines = B.table(spark, sf, "customer").select(F.when(k % 40 == 1, F.concat(ok, F.lit("}{"), F.lit("x"))).otherwise(ok).alias("value"))
    lines = lines.withColumn("value", F.when(F.col("value").endswith("x"), F.lit("{broken")).otherwise(F.col("value")))
    good, bad = Cat.check_lines(lines, "value")
    return good.select(F.lit("valid").alias("error")).unionByName(bad.select("error")).groupBy("error").agg(F.count("*").alias("n"))


@R.add("s15_confidence_select", "SELECT lpad(CAST(event_id AS VARCHAR), 7, '0') AS record_id FROM events WHERE event_type = 'click' AND event_id % 120 >= 100")
def s15(spark, sf):
    e = B.table(spark, sf, "events")
    lit = F.concat(F.lit("{'"), F.when(F.col("event_type") == "click", "AFIB").otherwise("NORM"), F.lit("': "), (F.col("event_id") % 120).cast("string"), F.lit(".0, 'SR': 0.0}"))
    return Cat.select_by_confidence(e.select("event_id", lit.alias("scp")), "scp", "event_id", width=7)


@R.add("s16_training_log", """SELECT o_orderkey, unnest([1, 2]) AS epoch, unnest([round(0.5 + (o_orderkey % 40) / 100.0::DOUBLE, 2), 0.25]) AS train_loss, 0.8::DOUBLE AS train_acc, 0.7::DOUBLE AS val_loss, 0.6::DOUBLE AS val_acc, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 0.33 ELSE 0 END, 0::DOUBLE]) AS val_f1_macro FROM orders""")
def s16(spark, sf):
    k = F.col("o_orderkey")
    log = F.concat(F.lit("start\nEpoch 1/2\nstep loss: "), F.format_string("%.2f", (k % 40) / 100.0 + 0.5), F.lit(" - accuracy: 0.8 - val_loss: 0.7 - val_accuracy: 0.6"), F.when(k % 2 == 0, " - val_f1_macro: 0.33").otherwise(""),
                   F.lit("\nEpoch 2/2\nstep loss: 0.25 - accuracy: 0.8 - val_loss: 0.7 - val_accuracy: 0.6\n"))
    return L.training_log(B.table(spark, sf, "orders").select("o_orderkey", log.alias("log")), "log", "o_orderkey")


@R.add("s17_gradient_history", "SELECT o_orderkey, CAST(o_custkey % 9 AS INTEGER) AS epoch, unnest(['dense', 'out']) AS layer, unnest([0.5::DOUBLE, 0.25]) AS norm_ratio, unnest([1.5::DOUBLE, 2.5]) AS p95_gradient FROM orders")
def s17(spark, sf):
    js = F.concat(F.lit('[{"epoch":'), (F.col("o_custkey") % 9).cast("string"), F.lit(',"layers":[{"layer_name":"dense","norm_ratio":0.5,"p95_gradient":1.5},{"layer_name":"out","norm_ratio":0.25,"p95_gradient":2.5}]}]'))
    return L.gradient_history(B.table(spark, sf, "orders").select("o_orderkey", js.alias("js")), "js", "o_orderkey")


@R.add("s17_calibration_history", "SELECT o_orderkey, CAST(o_custkey % 9 AS INTEGER) AS epoch, unnest([0, 1]) AS bin, unnest([0.5::DOUBLE, 0.75]) AS accuracy, unnest([0.4::DOUBLE, 0.9]) AS confidence, unnest([3::BIGINT, 4]) AS count FROM orders")
def s17b(spark, sf):
    js = F.concat(F.lit('[{"epoch":'), (F.col("o_custkey") % 9).cast("string"), F.lit(',"ece":0.1,"mce":0.2,"brier_score":0.3,"brier_per_class":{"S":0.1},"reliability_bins":[{"bin":0,"accuracy":0.5,"confidence":0.4,"count":3},{"bin":1,"accuracy":0.75,"confidence":0.9,"count":4}]}]'))
    return L.calibration_history(B.table(spark, sf, "orders").select("o_orderkey", js.alias("js")), "js", "o_orderkey")[1]


# ---- files: written to the shared folder, read back, compared -----------------------------

@R.add("s5_s6_publish", "SELECT l_linenumber, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1")
def s5(spark, sf):
    path = f"{_work(spark)}/published"
    Tb.publish(B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), path, ["l_returnflag"])
    x = Tb.scan(spark, path, ["l_orderkey", "l_linenumber"])
    return x.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@R.add("s7_paired_mismatch", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'no_array' ELSE 'no_metadata' END AS problem FROM embeddings WHERE (vec_id % 7 = 0) <> (vec_id % 11 = 0)")
def s7(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return Tb.paired_mismatch(e.filter("vec_id % 7 <> 0"), e.filter("vec_id % 11 <> 0"), "vec_id")


@R.add("s8_s9_replay", """SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'invalid' WHEN o_custkey % 2 = 0 THEN 'success' ELSE 'kept' END AS outcome, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1""")
def s8(spark, sf):
    path = f"{_work(spark)}/rejects"
    o = B.table(spark, sf, "orders").filter("o_orderkey % 3 = 0")
    r = o.select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey").cast("string")).alias("record_id"), F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("dataset"),
                 F.lit("read").alias("step"), F.lit("x").alias("error"), F.lit("/p").alias("raw_path"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    Tb.append_rejects(r.filter("dataset = 'even'"), path)
    Tb.append_rejects(r.filter("dataset = 'odd'"), path)
    return Tb.replay(Tb.read_rejects(spark, path), lambda keys: keys.filter("dataset = 'even'"))[1].select("outcome", "n")


@R.add("s12_append_rows", "SELECT c_nationkey, count(*) + count(*) FILTER (c_custkey % 5 = 0) AS n FROM customer GROUP BY 1")
def s12(spark, sf):
    from ..operators.tracking import append_rows

    path = f"{_work(spark)}/rows"
    c = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    append_rows(c, path, ["c_nationkey"])
    append_rows(c.filter("c_custkey % 5 = 0"), path, ["c_nationkey"])
    return spark.read.parquet(path).groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.count("*").alias("n"))


@R.add("s14_matrix_predictions", "SELECT 'c' || o_custkey % 3 AS candidate, CAST(o_orderkey % 5 AS INTEGER) AS fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL")
def s14(spark, sf):
    root = f"{_work(spark)}/matrix"
    o = B.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("candidate"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_orderkey") % 2).cast("int").alias("seed"))
    o.write.partitionBy("candidate", "fold", "seed").parquet(root)
    return Tb.matrix_predictions(spark, root).groupBy("candidate", "fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@R.add("s18_s20_exports", "SELECT p_size, count(*) AS n_csv, count(*) AS n_json, min(p_name) AS first_name FROM part GROUP BY 1")
def s20(spark, sf):
    work = _work(spark)
    x = B.table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"))
    Tb.write_csv(x, f"{work}/csv")
    Tb.write_json(x, f"{work}/json", ["p_size"])
    a = spark.read.option("header", True).schema("p_partkey long, p_name string, p_size int").csv(f"{work}/csv").groupBy("p_size").agg(F.count("*").alias("n_csv"), F.min("p_name").alias("first_name"))
    b = spark.read.schema("p_partkey long, p_name string, p_size int").json(f"{work}/json").groupBy("p_size").agg(F.count("*").alias("n_json"))
    return a.join(b, "p_size").select("p_size", "n_csv", "n_json", "first_name")


@R.add("s10_whole_files", "SELECT doc_id, length(text) AS n FROM documents WHERE text <> ''")
def s10_files(spark, sf):
    path = f"{_work(spark)}/files"
    d = B.table(spark, sf, "documents").filter("text <> ''")
    d.select(F.concat(F.col("doc_id"), F.lit(": "), F.regexp_replace("text", "\n", "\u2028")).alias("value")).write.text(path)
    lines = Tb.whole_files(spark, path, "part-*").select(F.explode(F.split("text", "\n")).alias("l")).filter("l <> ''")
    return lines.select(F.substring_index("l", ": ", 1).cast("long").alias("doc_id"), (F.length("l") - F.instr("l", ": ") - 1).alias("n"))


# ---- streaming --------------------------------------------------------------------------

def _work(spark) -> str:
    return shared_folder(spark)


def _stream(spark, sf, name):
    return spark.readStream.schema(B.table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


# Files come slice by slice, so a beat that waits as long as a slice lasts has seen all earlier ones; the heartbeat releases the last.
SLICE_DAYS, HEARTBEAT = 10, "2200-01-01 00:00:00"


def sliced_stream(df, at: str, days: int = SLICE_DAYS):
    """A stream of the rows of `df`: files of one time slice after those of the one before, then a row of nulls as heartbeat.

    Within a slice rows lie in no order. With a delay of one slice no row is ever behind the
    watermark, and what waits is at most the rows of two slices and one batch. The slices are listed on the
    driver: their number is the span of time over the width, whatever the rows.
    """
    spark, path, files = df.sparkSession, _work(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism
    n = F.floor(F.unix_seconds(F.col(at)) / F.lit(86400 * days))
    df.withColumn("_slice", n).write.partitionBy("_slice").parquet(f"{path}/staged")
    staged = spark.read.parquet(f"{path}/staged")
    for (i,) in staged.select("_slice").distinct().orderBy("_slice").collect():
        part = staged.filter(F.col("_slice").eqNullSafe(i)).select(*df.columns)
        part.repartition(files, F.xxhash64(*df.columns)).write.mode("append").parquet(f"{path}/in")
    beat = [F.lit(HEARTBEAT if c == at else None).cast(t).alias(c) for c, t in df.dtypes]
    spark.range(1).select(*beat).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", str(files)).parquet(f"{path}/in")


def _beat_stream(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("record_id"), "event_id", B.millis("ts").alias("peak"), F.col("ts").cast("timestamp").alias("at"))
    return sliced_stream(e, "at")


@R.add("st5_causal_stream", "SELECT record_id, event_id, rr_prev_1, rr_prev_4, rr_prev_median_4, rr_pnn50_4, tachycardia_flag, false AS late FROM (" + SEQ.sql["w2_causal_rr"] + ")")
def st5(spark, sf):
    x = J.causal_stream(_beat_stream(spark, sf), "record_id", "event_id", "peak", 1000.0, "at", f"{SLICE_DAYS} days", None)
    y = J.run_to_table(x, _work(spark))
    return y.select("record_id", "event_id", "rr_prev_1", "rr_prev_4", "rr_prev_median_4", F.round("rr_pnn50_4", 6).alias("rr_pnn50_4"), "tachycardia_flag", "late")


@R.add("st2_stability_stream", "SELECT record_id, event_id, skip, false AS late FROM (" + SEQ.sql["st2_stability_batch"] + ")")
def st2(spark, sf):
    x = J.stability_stream(_beat_stream(spark, sf), "record_id", "event_id", "peak", 40_000_000.0, 0.9, event_time="at", delay=f"{SLICE_DAYS} days", ttl_ms=None)
    first = _beat_stream_first(spark, sf)
    return J.run_to_table(x, _work(spark)).join(first, "event_id", "left_anti")


def _beat_stream_first(spark, sf):
    """The first beat of a record has no interval and no row in the batch form."""
    return B.beats(spark, sf).groupBy("record_id").agg(F.min_by("event_id", F.struct("peak", "event_id")).alias("event_id")).select("event_id")


@R.add("st3_epoch_metrics_stream", "SELECT run_id, name, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps FROM (SELECT l_orderkey AS run_id, l_linenumber + 1 AS step, unnest(['loss', 'lr']) AS name FROM lineitem) GROUP BY ALL")
def st3(spark, sf):
    s = _stream(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("loss"), F.col("l_tax").alias("lr"))
    y = J.run_to_table(J.epoch_metrics(s, ["run_id"], "epoch", ["loss", "lr"]), _work(spark))
    return y.groupBy("run_id", "name").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


@R.add("st4_progress_stream", "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def st4(spark, sf):
    return J.run_to_table(J.live_progress(_stream(spark, sf, "orders").withColumnRenamed("o_orderstatus", "state")), _work(spark), "complete")


@R.add("st1_timeline_refresh", "SELECT status, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status FROM orders) GROUP BY 1")
def st1(spark, sf):
    from ..operators.tracking import timeline
    from .tracking_queries import tables

    w = _work(spark)
    q = J.refresh_snapshot(_stream(spark, sf, "orders"), lambda s: timeline(**tables(s, sf)), f"{w}/timeline", f"{w}/state", once=True)
    q.awaitTermination()
    return J.latest_snapshot(spark, f"{w}/timeline").groupBy("status").agg(F.count("*").alias("n"))
