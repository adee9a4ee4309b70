"""Split, sampling, set, join and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ontology as O
from ..operators import quality as Q, sampling as Sm, sequences as S, sets as U, splits as Sp
from ..session import pinned
from . import bindings as B
from .registry import Registry

R = Registry()
CLASSES = ["N", "S", "V", "F", "Q"]
IDX_SQL = f"WITH {B.BEATS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY peak, event_id) AS idx FROM beats)"


def beats(spark, sf):
    return B.beats(spark, sf)


def numbered(spark, sf):
    return S.number_beats(beats(spark, sf), ["record_id"], "peak", B.BEAT_BUCKET, ["event_id"])


def h_sql(cols: str, seed: int = 42) -> str:
    return f"md5({cols} || '|{seed}')"


# ---- splits -----------------------------------------------------------------------------

def _split_report(spark, sf, assign):
    b = beats(spark, sf)
    f = b.join(assign, "record_id").groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "F").alias("nf"))
    tot = b.agg(F.count("*").alias("t"), F.count_if(F.col("label") == "F").alias("tf"))
    s = f.agg(F.count("*").alias("n_folds"), F.sum("n").alias("n_rows"), F.max("n").alias("mx"), F.max("nf").alias("mf")).join(F.broadcast(tot))
    g = assign.agg(F.count("*").alias("n_groups"), F.countDistinct("record_id").alias("n_distinct"))
    return s.join(F.broadcast(g)).select("n_folds", "n_rows", "n_groups", "n_distinct", (F.col("mx") <= F.col("t") / 5 * 1.5).alias("size_balanced"), (F.col("mf") <= F.col("tf") / 5 * 1.5 + 1).alias("class_balanced"))


SPLIT_SQL = "SELECT 5::BIGINT AS n_folds, (SELECT count(*) FROM events) AS n_rows, (SELECT count(DISTINCT user_id) FROM events) AS n_groups, (SELECT count(DISTINCT user_id) FROM events) AS n_distinct, true AS size_balanced, true AS class_balanced"


@R.add("h1_stratified_group_folds", SPLIT_SQL)
def h1(spark, sf):
    return _split_report(spark, sf, Sp.stratified_group_folds(beats(spark, sf), "record_id", "label", CLASSES))


@R.add("h2_group_folds", SPLIT_SQL)
def h2(spark, sf):
    return _split_report(spark, sf, Sp.group_folds(beats(spark, sf), "record_id")).withColumn("class_balanced", F.lit(True))


@R.add("h3_nested_folds", "SELECT outer_fold::INT AS outer_fold, (SELECT count(DISTINCT user_id) FROM events) AS n_groups, 0::BIGINT AS n_shared, true AS all_roles FROM (SELECT unnest(range(0, 5)) AS outer_fold)")
def h3(spark, sf):
    x = pinned(Sp.nested_folds(beats(spark, sf), "record_id", "label", CLASSES))
    g = x.groupBy("outer_fold", "record_id").agg(F.count("*").alias("c"))
    n = g.groupBy("outer_fold").agg(F.count("*").alias("n_groups"), F.count_if(F.col("c") > 1).alias("n_shared"))
    r = x.groupBy("outer_fold").agg((F.countDistinct("role") == 3).alias("all_roles"))
    return n.join(r, "outer_fold")


@R.add("h4_four_way", f"""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY {h_sql('doc_id')}, doc_id) AS rn, count(*) OVER () AS n, quality, toxic FROM labels)
SELECT CASE WHEN rn <= round_even(0.8 * n, 0) THEN 'train' WHEN rn <= round_even(0.9 * n, 0) THEN 'validation' WHEN rn <= round_even(0.95 * n, 0) THEN 'calibration' ELSE 'test' END AS partition, count(*) AS n, round(avg(quality), 6) AS quality FROM k GROUP BY 1""")
def h4(spark, sf):
    x = Sp.four_way(B.table(spark, sf, "labels"), "doc_id", ["quality", "toxic"], tolerance=1.0)
    return x.groupBy("partition").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


@R.add("h5_record_split", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {h_sql('doc_id')}, doc_id) <= floor(count(*) OVER () * 0.2) THEN 'validation' ELSE 'train' END AS part FROM documents")
def h5(spark, sf):
    return Sp.record_split(B.table(spark, sf, "documents").select("doc_id"), "doc_id")


ID_SQL = """rec AS (SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'delta' END AS dataset, user_id AS record_id FROM events),
 ident AS (SELECT dataset, record_id, CASE WHEN record_id % 16 = 4 THEN dataset || ':pair' WHEN dataset = 'alpha' THEN dataset || ':P' || (record_id // 8) WHEN dataset = 'beta' THEN dataset || ':' || record_id WHEN dataset = 'gamma' THEN dataset || ':all' END AS patient_id FROM rec)"""


def records(spark, sf):
    u = F.col("user_id")
    ds = F.element_at(F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma", "delta")]), (u % 4 + 1).cast("int"))
    return B.table(spark, sf, "events").select(ds.alias("dataset"), u.alias("record_id")).distinct().withColumn("header", F.concat(F.lit("# Patient: P"), F.floor(F.col("record_id") / 8).cast("string")))


def identity(spark, sf):
    rules = spark.createDataFrame([("alpha", "verified", "train"), ("beta", "grouped", "train"), ("gamma", "unverified", "external")], "dataset string, status string, role string")
    r = records(spark, sf)
    pairs = r.filter(F.col("record_id") % 16 == 4).select("dataset", "record_id", F.lit("pair").alias("patient_group"))
    return Sp.resolve_identity(r, rules, pairs)


@R.add("h6_identity", f"WITH {ID_SQL} SELECT dataset, record_id, patient_id, CASE WHEN patient_id IS NULL THEN 'quarantine' WHEN dataset = 'gamma' THEN 'external' ELSE 'train' END AS role, CASE dataset WHEN 'alpha' THEN 'verified' WHEN 'beta' THEN 'grouped' WHEN 'gamma' THEN 'unverified' ELSE 'missing' END AS identity_status FROM ident")
def h6(spark, sf):
    return identity(spark, sf)


@R.add("j3_attach_identity", f"WITH {ID_SQL} SELECT patient_id, count(*) AS n FROM events e JOIN ident i ON i.record_id = e.user_id WHERE patient_id IS NOT NULL GROUP BY 1")
def j3(spark, sf):
    rows = B.table(spark, sf, "events").select(F.col("user_id").alias("record_id"))
    good, _ = Sp.attach_identity(rows, identity(spark, sf).filter("patient_id is not null").drop("dataset"), ["record_id"])
    return good.groupBy("patient_id").agg(F.count("*").alias("n"))


@R.add("j13_crossing_groups", "SELECT user_id, count(DISTINCT event_id % 5) AS n_folds FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 5) > 1")
def j13(spark, sf):
    return Sp.crossing_groups(B.table(spark, sf, "events").select("user_id", (F.col("event_id") % 5).alias("fold")), "user_id")


@R.add("s18_fold_shares", f"WITH {B.BEATS_SQL} SELECT record_id % 5 AS fold, label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY record_id % 5) AS DOUBLE), 6) AS share FROM beats GROUP BY 1, 2")
def s18(spark, sf):
    x = Sp.fold_shares(beats(spark, sf).withColumn("fold", F.col("record_id") % 5), ["fold"], "label")
    return x.withColumn("share", F.round("share", 6))


@R.add("s19_split_diagnostics", f"""WITH {B.BEATS_SQL}, g AS (SELECT p, sum(CAST('0x' || substr(md5(CAST(record_id AS VARCHAR)), 1, 8) AS BIGINT)) AS h FROM (SELECT DISTINCT record_id % 4 AS p, record_id FROM beats) GROUP BY 1)
SELECT record_id % 4 AS partition, count(*) AS n_rows, count(DISTINCT record_id) AS n_groups, {', '.join(f"count(*) FILTER (label = '{c}') AS n_{c}" for c in CLASSES)}, CAST(max(h) AS BIGINT) AS groups_hash FROM beats JOIN g ON g.p = record_id % 4 GROUP BY 1""")
def s19(spark, sf):
    return Sp.diagnostics(beats(spark, sf).withColumn("partition", F.col("record_id") % 4), ["partition"], "record_id", "label", CLASSES)


@R.add("q11_compare_schemes")
def q11(spark, sf):
    b = beats(spark, sf)
    plain = b.select("record_id").distinct().withColumn("fold", (F.col("record_id") % 5).cast("int"))
    x = Sp.compare_schemes({"stratified": Sp.stratified_group_folds(b, "record_id", "label", CLASSES), "modulo": plain}, b, "record_id", "label", CLASSES, "F", 5)
    return x.withColumn("rare_spread", F.round("rare_spread", 9))


# ---- sampling ---------------------------------------------------------------------------

@R.add("h7_even_sample", f"""{IDX_SQL}, n AS (SELECT record_id, count(*) AS n FROM b GROUP BY 1)
SELECT b.record_id, b.event_id FROM b JOIN n USING (record_id) WHERE n <= 20 OR label = 'F' OR idx - 1 IN (SELECT floor(j * (n - 1) / 19.0::DOUBLE) FROM (SELECT unnest(range(0, 20)) AS j))""")
def h7(spark, sf):
    b = beats(spark, sf)
    return Sm.even_sample(b, ["record_id"], F.floor(F.col("peak") / B.BEAT_BUCKET), [F.col("peak"), F.col("event_id")], 20, F.col("label") == "F").select("record_id", "event_id")


@R.add("h8_stratified_sample", f"""WITH {B.BEATS_SQL}, c AS (SELECT label, count(*) AS n FROM beats GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS c FROM c), e AS (SELECT label, n, n * (1000 - c) / t::DOUBLE AS x, c FROM c, t),
 r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 12) DESC, label) AS k, 1000 - c - sum(floor(x)) OVER () AS l FROM e), q AS (SELECT label, least(n, floor(x) + 1 + (k <= l)::INT) AS quota FROM r),
 h AS (SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY {h_sql('event_id')}, event_id) AS rn FROM beats) SELECT h.label, h.event_id FROM h JOIN q USING (label) WHERE rn <= quota""")
def h8(spark, sf):
    return Sm.stratified_sample(beats(spark, sf), "label", ["event_id"], 1000).select("label", "event_id")


@R.add("h9_balanced_subset", f"WITH {B.BEATS_SQL} SELECT label, event_id FROM beats QUALIFY row_number() OVER (PARTITION BY label ORDER BY {h_sql('event_id')}, event_id) <= 683")
def h9(spark, sf):
    return Sm.balanced_subset(beats(spark, sf), "label", ["event_id"], 683).select("label", "event_id")


OVER_SQL = """h AS (SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY {h}, event_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM beats)"""


@R.add("h10_oversample_max", f"""WITH {B.BEATS_SQL}, {OVER_SQL.format(h=h_sql('event_id'))}, m AS (SELECT max(n) AS m FROM h) SELECT label, event_id, m // n + (rn <= m % n)::INT AS copies FROM h, m""")
def h10(spark, sf):
    b = beats(spark, sf)
    x = Sm.oversample(b, "label", ["event_id"], Sm.to_largest(b, "label"))
    return x.groupBy("label", "event_id").agg(F.count("*").alias("copies"))


@R.add("h10_oversample_share", f"""WITH {B.BEATS_SQL}, {OVER_SQL.format(h=h_sql('event_id'))}, m AS (SELECT ceil(count(*) FILTER (label <> 'F') * 0.3 / 0.7)::BIGINT AS m FROM beats) SELECT label, event_id, CASE WHEN label = 'F' THEN greatest(m, n) // n + (rn <= greatest(m, n) % n)::INT ELSE 1 END AS copies FROM h, m""")
def h10b(spark, sf):
    b = beats(spark, sf)
    x = Sm.oversample(b, "label", ["event_id"], Sm.to_share(b, "label", "F", 0.3))
    return x.groupBy("label", "event_id").agg(F.count("*").alias("copies"))


@R.add("h11_group_weighted_draws", f"""WITH {B.BEATS_SQL}, w AS (SELECT label, record_id, count(*) AS n, sqrt(count(*)) AS w FROM beats GROUP BY ALL), s AS (SELECT label, sum(w) AS sw, sum(n) AS cn FROM w GROUP BY 1),
 q AS (SELECT w.*, CAST(floor(cn * w / sw + CAST('0x' || substr(md5(w.label || '|' || w.record_id || '|42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS BIGINT) AS q FROM w JOIN s USING (label)),
 h AS (SELECT label, record_id, event_id, row_number() OVER (PARTITION BY label, record_id ORDER BY {h_sql('event_id', 43)}, event_id) AS rn FROM beats)
SELECT label, record_id, event_id, q // n + (rn <= q % n)::INT AS copies FROM h JOIN q USING (label, record_id) WHERE q // n + (rn <= q % n)::INT > 0""")
def h11(spark, sf):
    x = Sm.group_weighted_draws(beats(spark, sf), "label", "record_id", ["event_id"], 0.5)
    return x.groupBy("label", "record_id", "event_id").agg(F.count("*").alias("copies"))


@R.add("h12_capped_draws", f"""WITH {B.BEATS_SQL}, n AS (SELECT record_id, count(*) AS n_source FROM beats WHERE label = 'F' GROUP BY 1) SELECT record_id, n_source, greatest(1, least(120, CAST(floor(6000.0::DOUBLE * n_source / (SELECT sum(n_source) FROM n)) AS INTEGER))) AS quota FROM n""")
def h12(spark, sf):
    return Sm.capped_draws(beats(spark, sf), "label", "F", "record_id", ["event_id"], 6000, 0.02)[1]


@R.add("h13_smote")
def h13(spark, sf):
    e = B.table(spark, sf, "embeddings")
    x = Sm.smote(e, "label", "vec_id", "embedding", 3, 120)
    return x.select("vec_id", "copy", "label", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@R.add("h13_adasyn_quota")
def h13b(spark, sf):
    return Sm.adasyn_quota(B.table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 3, 200)


@R.add("h14_bootstrap_noise", "SELECT label, greatest(80, count(*)) AS n, greatest(80, count(*)) - count(*) AS n_noisy FROM embeddings GROUP BY 1")
def h14(spark, sf):
    x = Sm.bootstrap_noise(B.table(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda v: v.cast("double"))), "label", ["vec_id"], "embedding", 80, 0.01)
    return x.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("copy") > 0).alias("n_noisy"))


@R.add("h15_class_augmentation")
def h15(spark, sf):
    from ..operators import waveforms as Wv

    e = B.table(spark, sf, "embeddings")
    x = Sm.oversample(e, "label", ["vec_id"], Sm.to_largest(e, "label"))
    a = Wv.augment(x.filter("copy > 0"), ["vec_id", "label", "copy"], "embedding", "noise", 0.1, 7)
    return a.select("vec_id", "label", "copy", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@R.add("h16_sampling_manifest", f"WITH {B.BEATS_SQL}, c AS (SELECT label, count(*) AS n FROM beats GROUP BY 1) SELECT label, n AS n_before, (SELECT max(n) FROM c) AS n_after, (SELECT max(n) FROM c) - n AS n_synthetic, 0::BIGINT AS n_foreign FROM c")
def h16(spark, sf):
    b = beats(spark, sf)
    return Sm.sampling_manifest(b, Sm.oversample(b, "label", ["event_id"], Sm.to_largest(b, "label")), "label", ["event_id"])


# ---- sets and joins ---------------------------------------------------------------------

@R.add("u1_union", "SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages UNION ALL SELECT 'item', item_id FROM benchmark) GROUP BY 1")
def u1(spark, sf):
    parts = [("documents", "doc_id", "doc"), ("pages", "page_id", "page"), ("benchmark", "item_id", "item")]
    return U.union_all([B.table(spark, sf, t).select(F.lit(k).alias("kind"), F.col(c).alias("id")) for t, c, k in parts]).groupBy("kind").agg(F.count("*").alias("n"))


@R.add("u3_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def u3(spark, sf):
    return U.duplicate_keys(B.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.add("u4_conflicting_labels", "WITH d AS (SELECT doc_id, md5(text) AS h, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS y FROM documents) SELECT doc_id, h IN (SELECT h FROM d GROUP BY 1 HAVING min(y) <> max(y)) AS excluded FROM d")
def u4(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("y"))
    good, bad = U.drop_conflicts(d, "h", "y")
    return good.select("doc_id", F.lit(False).alias("excluded")).unionByName(bad.select("doc_id", F.lit(True).alias("excluded")))


@R.add("u5_shared_groups", "SELECT DISTINCT user_id FROM events WHERE event_id % 5 = 0 INTERSECT SELECT DISTINCT user_id FROM events WHERE event_id % 5 <> 0")
def u5(spark, sf):
    e = B.table(spark, sf, "events")
    return U.shared(e.filter("event_id % 5 = 0"), e.filter("event_id % 5 <> 0"), ["user_id"])


@R.add("u6_j16_differences", "WITH a AS (SELECT doc_id, lang FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'xx' ELSE lang END AS lang FROM documents) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def u6(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang")
    return U.differences(d.filter("lang <> 'fr'"), d.withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang"))), ["doc_id", "lang"])


@R.add("u8_ids_in_many", "SELECT user_id, count(DISTINCT event_type) AS n_owners FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def u8(spark, sf):
    return U.ids_in_many(B.table(spark, sf, "events"), "user_id", "event_type")


@R.add("j2_coverage", """WITH c AS (SELECT o_orderkey AS id FROM orders), l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), f AS (SELECT event_id AS id FROM events)
SELECT id, 'missing_lineage' AS problem FROM c WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT id, 'missing_file' FROM c WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT id, 'orphan_lineage' FROM l WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, 'orphan_file' FROM f WHERE id NOT IN (SELECT id FROM c)""")
def j2(spark, sf):
    t = lambda n, c: B.table(spark, sf, n).select(F.col(c).alias("id"))
    return U.coverage(t("orders", "o_orderkey"), t("lineitem", "l_orderkey"), t("events", "event_id"), ["id"])


@R.add("j9_parent_child", """WITH e AS (SELECT event_id, (event_type <> 'view')::INT AS y, value FROM events WHERE event_type <> 'error'), a AS (SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 9 ELSE (event_type <> 'view')::INT END AS y, value FROM events WHERE event_id % 40 <> 1 AND event_type <> 'error')
SELECT 'missing_rows' AS "check", count(*) AS n_mismatch FROM e WHERE event_id NOT IN (SELECT event_id FROM a) UNION ALL SELECT 'extra_rows', 0 UNION ALL SELECT 'y', count(*) FROM e JOIN a USING (event_id) WHERE e.y <> a.y UNION ALL SELECT 'value', count(*) FROM e JOIN a USING (event_id) WHERE e.value <> a.value""")
def j9(spark, sf):
    ev = B.table(spark, sf, "events").filter("event_type <> 'error'").withColumn("y", F.when(F.col("event_type") == "view", 0).otherwise(1))
    child = ev.filter("event_id % 40 <> 1").withColumn("y", F.when(F.col("event_id") % 100 == 0, 9).otherwise(F.col("y")))
    return U.table_mismatch(ev, child, ["event_id"], ["y", "value"])


@R.add("j12_pending", "SELECT count(*) AS n FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 9 <> 0)")
def j12(spark, sf):
    from ..operators.waveforms import pending

    d = B.table(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("record_id"), F.lit("v1").alias("config"), F.md5("text").alias("checksum"))
    done = d.filter("record_id % 3 = 0").withColumn("checksum", F.when(F.col("record_id") % 9 == 0, "stale").otherwise(F.col("checksum")))
    return pending(d, done).agg(F.count("*").alias("n"))


@R.add("j14_aligned_histories", """SELECT CAST(l_linenumber AS INTEGER) AS epoch, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS a_v, round(avg(l_tax) FILTER (l_returnflag = 'N'), 6) AS n_v, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS r_v FROM lineitem GROUP BY 1""")
def j14(spark, sf):
    l = B.table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "epoch")
    h = {k.lower(): l.filter(F.col("l_returnflag") == k).groupBy("epoch").agg(F.round(F.avg(c), 6).alias("v")) for k, c in (("A", "l_discount"), ("N", "l_tax"), ("R", "l_quantity"))}
    return U.aligned(h, "epoch")


@R.add("p22_relabel", f"WITH {B.BEATS_SQL} SELECT CASE label WHEN 'S' THEN 0 WHEN 'V' THEN 1 ELSE 2 END AS target, count(*) AS n FROM beats WHERE label IN ('S', 'V', 'F') GROUP BY 1")
def p22(spark, sf):
    return U.relabel(beats(spark, sf), "label", {"S": 0, "V": 1, "F": 2}).groupBy("target").agg(F.count("*").alias("n"))


@R.add("p6_sample_ids", f"{IDX_SQL} SELECT dataset || ':' || record_id || ':beat:' || (idx - 1) || ':target:' || peak AS sample_id FROM b")
def p6(spark, sf):
    return numbered(spark, sf).select(F.concat_ws(":", "dataset", "record_id", F.lit("beat"), F.col("idx") - 1, F.lit("target"), "peak").alias("sample_id"))


@R.add("p19_sentinels", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE round(embedding[1]::DOUBLE, 6) END AS x FROM embeddings")
def p19(spark, sf):
    from ..functions.arrays import sentinel

    x = B.table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 5 != 0, F.get("embedding", F.lit(0)).cast("double")).alias("x"))
    return x.select("vec_id", F.round(sentinel("x", -1.0), 6).alias("x"))


# Every order carries two diagnosis codes derived from its keys.
CODES = ["426177001", "164889003", "164947007", "270492004", "164865005", "89792004", "999999999"]


@R.add("p5_diagnosis_flags", f"""WITH c AS (SELECT o_orderkey, {CODES}[1 + o_orderkey % 7] AS a, {CODES}[1 + o_custkey % 7] AS b FROM orders),
 m AS (SELECT * FROM (VALUES ('426177001', 'NORM'), ('164889003', 'STTC'), ('164947007', 'CD'), ('164947007', 'STTC'), ('270492004', 'CD'), ('164865005', 'MI'), ('89792004', 'HYP')) t(code, cls))
SELECT o_orderkey, {', '.join(f"max(coalesce((cls = '{c}')::INT, 0)) AS {c}" for c in ['NORM', 'CD', 'MI', 'HYP', 'STTC'])} FROM c LEFT JOIN m ON m.code = a OR m.code = b GROUP BY 1""")
def p5(spark, sf):
    from ..functions.diagnosis import SUPERCLASSES, multi_hot

    o = B.table(spark, sf, "orders")
    code = lambda c: F.element_at(F.array(*[F.lit(x) for x in CODES]), (F.col(c) % 7 + 1).cast("int"))
    x = o.select("o_orderkey", F.concat(code("o_orderkey"), F.lit(", "), code("o_custkey")).alias("dx"))
    return x.select("o_orderkey", *[v.alias(k) for k, v in zip(SUPERCLASSES, multi_hot(F.col("dx")))])


# ---- audits -----------------------------------------------------------------------------

@R.add("a2_class_distribution", f"WITH {B.BEATS_SQL} SELECT dataset, {', '.join(f"count(*) FILTER (label = '{c}') AS n_{c}" for c in CLASSES)}, count(*) AS n FROM beats GROUP BY ROLLUP (dataset)")
def a2(spark, sf):
    return beats(spark, sf).rollup("dataset").agg(*[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in CLASSES], F.count("*").alias("n"))


@R.add("a29_label_audit", f"""{IDX_SQL}, d AS (SELECT record_id, label, CAST(peak - lag(peak) OVER (PARTITION BY record_id ORDER BY idx) AS DOUBLE) AS rr FROM b)
SELECT label, count(*) AS n, round(avg(rr) / 1000, 3) AS mean, round(stddev_samp(rr) / 1000, 2) AS std, round(quantile_cont(rr, 0.5) / 1000, 3) AS median FROM d GROUP BY 1""")
def a29(spark, sf):
    from ..operators.ordering import percentiles

    x = S.temporal_features(beats(spark, sf), ["record_id"], fs=1000.0, bucket_width=B.BEAT_BUCKET, tie=["event_id"])
    x = x.select("label", F.when(F.col("idx") > 1, F.col("rr_prev")).alias("rr"))
    a = x.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("rr") / 1000, 3).alias("mean"), F.round(F.stddev_samp("rr") / 1000, 2).alias("std"))
    p = percentiles(x, ["label"], "rr", {"median": 0.5})
    return a.join(p.withColumn("median", F.round(F.col("median") / 1000, 3)), "label")


@R.add("a29_cooccurrence", f"WITH {B.BEATS_SQL} SELECT record_id, count(*) AS total, round(avg((label = 'F')::INT) * 100, 6) AS f_pct, round(avg((label = 'V')::INT) * 100, 6) AS v_pct, round(avg((label = 'S')::INT) * 100, 6) AS s_pct FROM beats GROUP BY 1 HAVING count(*) FILTER (label = 'F') > 0 ORDER BY f_pct DESC, record_id LIMIT 20")
def a29c(spark, sf):
    pct = lambda c: F.round(F.avg(F.when(F.col("label") == c, 1.0).otherwise(0.0)) * 100, 6)
    x = beats(spark, sf).groupBy("record_id").agg(F.count("*").alias("total"), pct("F").alias("f_pct"), pct("V").alias("v_pct"), pct("S").alias("s_pct")).filter("f_pct > 0")
    return x.orderBy(F.desc("f_pct"), "record_id").limit(20)


@R.add("a34_median_imputation", f"""WITH {B.FEATURE_SQL}, x AS (SELECT vec_id, label, dim, CASE WHEN (vec_id + dim) % 10 = 0 THEN NULL ELSE value END AS v FROM feature), t AS (SELECT * FROM x WHERE vec_id % 5 <> 0),
 c AS (SELECT label, dim, quantile_cont(v, 0.5) AS m FROM t GROUP BY ALL), g AS (SELECT dim, quantile_cont(v, 0.5) AS m FROM t GROUP BY 1)
SELECT CAST(x.dim AS INTEGER) AS dim, count(*) AS n, round(avg(coalesce(v, c.m, g.m)), 6) AS mean FROM x LEFT JOIN c ON c.label = x.label AND c.dim = x.dim JOIN g ON g.dim = x.dim GROUP BY 1""")
def a34(spark, sf):
    from ..operators.models import impute_medians

    x = B.features(spark, sf).withColumn("value", F.when((F.col("vec_id") + F.col("dim")) % 10 != 0, F.col("value")))
    y = impute_medians(x, x.filter("vec_id % 5 <> 0"), "dim", "label", "value")
    return y.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@R.add("a35_fold_scaler", f"""WITH {B.FEATURE_SQL}, s AS (SELECT dim, avg(value) AS m, stddev_pop(value) AS s FROM feature WHERE vec_id % 5 <> 0 GROUP BY 1) SELECT vec_id, CAST(f.dim AS INTEGER) AS dim, round((value - m) / s, 5) AS z FROM feature f JOIN s ON s.dim = f.dim""")
def a35(spark, sf):
    from ..operators.models import fit_scaler, scale

    x = B.features(spark, sf)
    return scale(x, fit_scaler(x.filter("vec_id % 5 <> 0"), "dim", "value"), "dim", "value").select("vec_id", "dim", F.round("z", 5).alias("z"))


@R.add("a37_identity_probe")
def a37(spark, sf):
    from ..operators.models import identity_probe

    e = B.table(spark, sf, "embeddings").withColumn("ds", (F.col("label") % 2).cast("int")).withColumn("grp", F.col("vec_id") % 40)
    return identity_probe(e, "embedding", "ds", "grp", k=3)


@R.add("a38_feature_importance")
def a38(spark, sf):
    from ..operators.models import permutation_importance

    l = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    return permutation_importance(l, ["l_quantity", "l_extendedprice", "l_discount"], "y", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


# ---- quality ----------------------------------------------------------------------------

def _samples(spark, sf):
    fs = F.when(F.col("dataset") == 0, 360.0).otherwise(250.0)
    n = numbered(spark, sf).withColumn("beat_idx", F.col("idx") - 1).withColumn("native", F.col("event_id") * 100).withColumn("fs_native", fs)
    n = n.withColumn("peak", O.rescale_clock("native", "fs_native")).withColumn("seconds", F.col("native") / F.col("fs_native"))
    n = n.withColumn("sample_id", F.concat_ws(":", "dataset", "record_id", F.lit("beat"), "beat_idx", F.lit("target"), F.when(F.col("event_id") % 500 == 0, 0).otherwise(F.col("peak"))))
    return n.withColumn("y_binary", F.when((F.col("label") == "N") | (F.col("event_id") % 700 == 0), 0).otherwise(1))


@R.add("q2_sample_checks", f"""{IDX_SQL}, k AS (SELECT DISTINCT dataset, record_id FROM b)
SELECT * FROM (VALUES ('NULL_KEYS', 0), ('ID_RECONSTRUCTION', (SELECT count(*) FROM b WHERE event_id % 500 = 0 AND event_id <> 0)), ('NOT_FINITE', 0), ('CLOCK_TOLERANCE', 0), ('TIME_TOLERANCE', 0), ('UNKNOWN_LABEL', (SELECT count(*) FROM b WHERE label = 'Q')),
 ('BINARY_SEMANTICS', (SELECT count(*) FROM b WHERE label <> 'N' AND event_id % 700 = 0)), ('DUPLICATE_IDS', 0), ('NO_IDENTITY', (SELECT count(*) FROM k WHERE record_id % 7 = 0)), ('NO_FOLD', (SELECT count(*) FROM k WHERE record_id % 7 <> 0 AND record_id % 11 = 0))) t(code, count)""")
def q2(spark, sf):
    b = _samples(spark, sf)
    rec = b.select("dataset", "record_id").distinct()
    ident = rec.filter("record_id % 7 <> 0").select("dataset", "record_id", F.col("record_id").cast("string").alias("patient_id"), F.lit("train").alias("role"))
    folds = rec.filter("record_id % 11 <> 0").select(F.col("record_id").cast("string").alias("patient_id"), F.lit(0).alias("fold")).distinct()
    return Q.sample_checks(b, ident, folds, ["N", "S", "V", "F"]).select("code", "count")


@R.add("q3_episode_checks", """WITH e AS (SELECT event_id, user_id AS record_id, event_id * 10 AS s FROM events) SELECT * FROM (VALUES ('BOUNDARIES', (SELECT count(*) FROM e WHERE event_id % 90 = 0)), ('LENGTH', (SELECT count(*) FROM e WHERE event_id % 90 = 0)), ('CONTAINMENT', (SELECT count(*) FROM e WHERE event_id % 30 = 1)), ('ID_RECONSTRUCTION', 0), ('DUPLICATE_IDS', 0)) t(code, count)""")
def q3(spark, sf):
    i = F.col("event_id")
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("record_id"), (i * 10).alias("start"), F.when(i % 90 == 0, i * 10).otherwise(i * 10 + 5000).alias("end"), F.when(i % 30 == 1, i * 10 + 1).otherwise(i * 10).alias("interval_start"), (i * 10 + 9000).alias("interval_end"))
    e = e.withColumn("episode_id", F.concat_ws(":", F.lit("episode"), "record_id", "start", "end"))
    return Q.episode_checks(e, 5000).select("code", "count")


@R.add("q4_q5_table_binding", """WITH w AS (SELECT vec_id, label FROM embeddings) SELECT 'missing_rows' AS "check", count(*) FILTER (vec_id % 60 = 0) AS n_mismatch FROM w UNION ALL SELECT 'extra_rows', 0 UNION ALL SELECT 'label', count(*) FILTER (vec_id % 45 = 1 AND vec_id % 60 <> 0) FROM w UNION ALL SELECT 'digest', 0 FROM (SELECT 1)""")
def q4(spark, sf):
    e = B.table(spark, sf, "embeddings").select("vec_id", "label", F.sha2(F.to_json("embedding"), 256).alias("digest"))
    a = e.filter("vec_id % 60 <> 0").withColumn("label", F.when(F.col("vec_id") % 45 == 1, -1).otherwise(F.col("label")))
    return U.table_mismatch(e, a, ["vec_id"], ["label", "digest"])


@R.add("q6_q8_leakage", "SELECT * FROM (VALUES ('GROUP_OVERLAP', 0), ('EMPTY_CLASS', 0), ('SOURCE_LEAKAGE', (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_id % 2 = 0 INTERSECT SELECT user_id FROM events WHERE event_id % 2 = 1)))) t(code, count)")
def q6(spark, sf):
    b = beats(spark, sf)
    folds = pinned(Sp.stratified_group_folds(b, "record_id", "label", CLASSES))
    r = Q.leakage_report(b, folds, "record_id", "label", CLASSES).filter("code <> 'LOW_SUPPORT'")
    leak = Q.source_leakage(b.filter("event_id % 2 = 0"), b.filter("event_id % 2 = 1"), ["record_id"])
    return U.union_all([r, leak]).select("code", "count")


@R.add("q7_record_audit", """WITH w AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS w FROM embeddings) SELECT * FROM (VALUES ('NAN_INF', (SELECT count(*) FROM w WHERE vec_id % 50 = 0)), ('FLATLINE', (SELECT count(*) FROM w WHERE vec_id % 50 <> 0 AND list_stddev_pop(w) < 0.12)), ('ZSCORE_RANGE', (SELECT count(*) FROM w WHERE vec_id % 50 <> 0 AND list_max(list_transform(w, lambda v: abs(v))) > 0.35)), ('ZERO_RATIO', 0), ('DURATION', 0)) t(code, count)""")
def q7(spark, sf):
    e = B.table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda v: F.lit(float("nan")))).otherwise(F.transform("embedding", lambda v: v.cast("double"))).alias("w"))
    return Q.record_audit(e, "w", 64.0, 0.35, 0.12).select("code", "count")


@R.add("q7_label_audit", f"""WITH {B.BEATS_SQL} SELECT 'CLASS_MINIMUM' AS code, (SELECT count(*) FROM (SELECT label FROM beats GROUP BY 1 HAVING count(*) < 2000)) AS count UNION ALL SELECT 'FOLD_FEASIBILITY', (SELECT count(*) FROM (SELECT label FROM beats GROUP BY 1 HAVING count(DISTINCT record_id) < 5))
 UNION ALL SELECT 'PACED', (SELECT count(*) FROM beats WHERE label = 'Q') UNION ALL SELECT 'PII_COLUMNS', 0""")
def q7l(spark, sf):
    return Q.label_audit(beats(spark, sf), "label", "record_id", CLASSES, 2000, 5, ["Q"]).select("code", "count")


@R.add("q9_archive_check", "SELECT doc_id::VARCHAR AS path, doc_id % 20 <> 3 AS size_ok, doc_id % 25 <> 4 AS hash_ok, true AS present FROM documents")
def q9(spark, sf):
    i = F.col("doc_id")
    d = B.table(spark, sf, "documents").select(i.cast("string").alias("path"), "doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    m = d.select("path", F.when(i % 20 == 3, F.col("size") * 2).when(i % 2 == 0, F.col("size")).alias("expected_size"), F.when(i % 25 == 4, "bad").when(i % 3 == 0, F.col("sha256")).alias("expected_sha256"))
    return Q.archive_check(d.drop("doc_id"), m)


@R.add("q13_prediction_checks", f"""WITH {B.PREDICTION_SQL} SELECT * FROM (VALUES ('MISSING_VALUE', 0), ('NOT_FINITE', 0), ('SCORE_RANGE', (SELECT count(*) FROM scored WHERE p0 > 0.5)), ('RECORD_OVERLAP', (SELECT count(*) FROM (SELECT patient_id FROM scored GROUP BY 1 HAVING count(DISTINCT fold) > 1)))) t(code, count)""")
def q13(spark, sf):
    s = B.scored(spark, sf).withColumn("p", F.col("p0") + F.when(F.col("p0") > 0.5, 1.0).otherwise(0.0))
    return Q.prediction_checks(s, "fold", "patient_id", "y_true", "p").select("code", "count")


@R.add("q_overall_verdict", f"""WITH {B.BEATS_SQL}, c AS (SELECT unnest({CLASSES!r}) AS label), n AS (SELECT c.label, count(b.label) AS n, count(DISTINCT b.record_id) AS g FROM c LEFT JOIN beats b USING (label) GROUP BY 1),
 f AS (SELECT CAST(bool_or(n < 1) AS BIGINT) AS a, CAST(bool_or(n > 0 AND g < 5) AS BIGINT) AS b, (SELECT CAST(count(*) > 0 AS BIGINT) FROM beats WHERE label = 'Q') AS c FROM n)
SELECT CAST(a + b + c AS BIGINT) AS n_failed, 4::BIGINT AS n_checks, CASE WHEN a + b + c > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM f""")
def qo(spark, sf):
    return Q.overall(Q.label_audit(beats(spark, sf), "label", "record_id", CLASSES, 1, 5, ["Q"]))


