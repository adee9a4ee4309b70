"""Small literal cases and independent recomputations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F, Window as W

from pulseframe.functions import ontology as O, signal as K, text as TX
from pulseframe.operators import calibration as C, intervals as I, metrics as M, ordering as Od, quality as Q, sampling as Sm, security as Sec, sequences as S, splits as Sp, tracking as T, waveforms as Wv


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# ---- order-dependent blocks -------------------------------------------------------------

def test_numbering_equals_plain_window_on_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id"), (F.xxhash64("id") % 10007).alias("t"))
    a = Od.numbered(df, ["k"], F.floor(F.col("t") / 500), [F.col("t"), F.col("id")])
    b = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("t", "id")))
    assert a.select("id", "rn").exceptAll(b.select("id", F.col("rn").cast("long"))).count() == 0


def test_shift_crosses_blocks(spark):
    df = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    n = Od.numbered(df, ["k"], F.floor(F.col("t") / 3), [F.col("t")], "i")
    x, part, own = Od.neighbourhood(n, ["k"], "i", 2, 1, block=4)
    w = W.partitionBy(*part).orderBy("i")
    got = x.withColumn("l2", F.lag("t", 2).over(w)).withColumn("n1", F.lead("t").over(w)).filter(own).orderBy("t")
    assert rows(got, "t", "l2", "n1") == [(t, t - 2 if t > 1 else None, t + 1 if t < 9 else None) for t in range(10)]


def test_percentiles_match_numpy(spark):
    v = np.random.default_rng(1).normal(0, 3, 500)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(x)) for i, x in enumerate(v)], "k string, v double")
    got = {r["k"]: r for r in Od.percentiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "p9": 0.9}).collect()}
    for k, sel in (("a", [i % 3 != 0 for i in range(500)]), ("b", [i % 3 == 0 for i in range(500)])):
        want = np.percentile(v[sel], [25, 50, 90])
        assert np.allclose([got[k]["q1"], got[k]["m"], got[k]["p9"]], want)


def test_top_k_with_salts(spark):
    df = spark.range(1000).withColumn("k", F.lit(1))
    assert [r["id"] for r in Od.top_k(df, ["k"], [F.desc("id")], 3, "id").orderBy("rank").collect()] == [999, 998, 997]


# ---- sequences --------------------------------------------------------------------------

def test_temporal_features_hand_case(spark):
    df = spark.createDataFrame([("r1", p) for p in (1300, 0, 800, 400, 1700)] + [("r2", 5)], "record string, peak long")
    x = S.temporal_features(df, ["record"], fs=500.0, bucket_width=500).orderBy("record", "peak")
    got = rows(x.filter("record = 'r1'"), "rr_prev", "rr_next", "rr_ratio", F.round("rr_local_mean", 4), F.round("rmssd", 4), "heart_rate")
    assert got == [(0, 800, 0, 866.6667, 0, 0), (800, 800, 1, 850, 0, 75), (800, 1000, 0.8, 850, 141.4214, 75), (1000, 800, 1.25, 866.6667, 163.2993, 60), (800, 0, 1, 900, 163.2993, 75)]
    assert rows(x.filter("record = 'r2'"), "rr_prev", "rr_next", "rr_ratio", "rr_local_std", "heart_rate") == [(0, 0, 1, 0, 0)]


def test_causal_features_ignore_the_future(spark):
    base = [("r", i, i * 400 + (i % 3) * 10) for i in range(12)]
    moved = base[:8] + [("r", i, p + 777) for _, i, p in base[8:]]
    f = lambda d: [tuple(r) for r in S.causal_features(spark.createDataFrame(d, "record string, i long, peak long"), ["record"]).filter("i < 8").orderBy("i").collect()]
    assert f(base) == f(moved)


def test_causal_null_until_four(spark):
    df = spark.createDataFrame([("r", i * 500) for i in range(6)], "record string, peak long")
    got = rows(S.causal_features(df, ["record"]).orderBy("peak"), "rr_prev_median_4")
    assert [g[0] is None for g in got] == [True] * 4 + [False] * 2


def test_ontology(spark):
    df = spark.createDataFrame([(s,) for s in [*O.BEAT_CLASS, "~", "+", "?"]], "symbol string")
    kept, stats = O.map_symbols(df)
    assert kept.count() == len(O.BEAT_CLASS)
    assert rows(stats.filter("unknown"), "symbol") == [("?",)]
    assert rows(kept.filter("symbol = 'F'"), "canonical") == [("FUSION",)]


def test_clock_and_range_guard(spark):
    assert spark.range(1).select(O.rescale_clock(F.lit(100), F.lit(360.0))).head()[0] == 139
    df = spark.createDataFrame([("a", i, 199) for i in range(200)] + [("b", i, 48) for i in range(50)], "r string, p long, n long")
    good, bad = O.range_guard(df, ["r"], "p", "n")
    assert good.count() == 199 and [r["r"] for r in bad.collect()] == ["b"]


def test_intervals(spark):
    iv = spark.createDataFrame([("r", 0, 100, "N"), ("r", 100, None, "AFIB")], "record string, start long, end long, rhythm string")
    pt = spark.createDataFrame([("r", 0), ("r", 99), ("r", 100), ("r", 500), ("x", 3)], "record string, sample long")
    got = {(r["record"], r["sample"]): r["rhythm"] for r in I.label_points(pt, iv, ["record"], "sample", "start", "end", "rhythm", 30, "N").collect()}
    assert got == {("r", 0): "N", ("r", 99): "N", ("r", 100): "AFIB", ("r", 500): "AFIB", ("x", 3): "N"}
    ep = spark.createDataFrame([("r", 0, 50), ("r", 80, 120)], "record string, start long, end long")
    got = rows(I.contained_episodes(ep, iv.filter("end is not null"), ["record"], 30).orderBy("start"), "start", "rhythm")
    assert got == [(0, "N"), (80, None)]


def test_peak_matching_equals_nested_loop(spark):
    rng = np.random.default_rng(3)
    t, d = np.sort(rng.integers(0, 4000, 120)), np.sort(rng.integers(0, 4000, 130))
    used, want = set(), set()
    for i, a in enumerate(t):
        for j, b in enumerate(d):
            if j not in used and abs(a - b) <= 12:
                used.add(j)
                want.add((i, j))
                break
    mk = lambda v: spark.createDataFrame([("r", int(x), i) for i, x in enumerate(v)], "record string, peak long, rid long")
    got = {(r["truth_id"], r["det_id"]) for r in I.match_peaks(mk(t), mk(d), "record", "peak", "rid", 12, 500).collect()}
    assert got == want


# ---- tracking and security --------------------------------------------------------------

@pytest.fixture(scope="module")
def tables(spark):
    e = spark.createDataFrame([(1, "e1", "s1", "ana", '{"baseline_f1_macro": 0.5}'), (2, "e2", "s2", "bob", "{}")], "id long, name string, stage string, owner_id string, extra string")
    r = spark.sql("""SELECT * FROM VALUES (10L, 1L, 'completed', 'train', TIMESTAMP'2026-01-01', TIMESTAMP'2026-01-01 00:00:01.5', '{}'), (11L, 1L, 'failed', 'test', TIMESTAMP'2026-01-02', NULL, '{}'),
      (12L, 2L, 'completed', 'test', TIMESTAMP'2026-01-03', NULL, '{}'), (13L, 1L, 'completed', 'test', TIMESTAMP'2026-01-04', NULL, '{}') AS t(id, experiment_id, status, run_type, start_time, end_time, extra)""")
    m = spark.createDataFrame([(10, "global", "F1-macro", 0.4), (13, "global", "f1_macro", 0.9), (11, "global", "accuracy", 0.7), (11, "global", "loss", 0.1)], "run_id long, namespace string, name string, value double")
    a = spark.createDataFrame([(i, 11, "critical", False) for i in range(100)] + [(500, 13, "critical", True), (501, None, "critical", False)], "id long, run_id long, severity string, resolved boolean")
    return {"experiment": e, "run": r, "metric": m, "alert": a}


def test_timeline_cases(tables):
    got = {r["run_id"]: r for r in T.timeline(**tables).collect()}
    assert {k: v["health_status"] for k, v in got.items()} == {10: "REGRESSION", 11: "FAILED", 12: "HEALTHY", 13: "UNSTABLE"}
    assert got[11]["critical_alerts"] == 100 and got[10]["duration_seconds"] == 1.5 and got[12]["final_f1_macro"] is None


def test_page_and_filters(tables):
    p = T.timeline_page(T.timeline(**tables), T.TimelineFilter(limit=2)).collect()
    assert [r["run_id"] for r in p] == [13, 12] and p[0]["total"] == 4
    with pytest.raises(ValueError):
        T.TimelineFilter(sort_by="created_at")
    with pytest.raises(ValueError):
        T.TimelineFilter(limit=5000)


def test_timeline_of_100k_runs(spark):
    n = 100_000
    e = spark.range(100).select(F.col("id"), F.lit("e").alias("name"), F.lit("s").alias("stage"), F.lit("o").alias("owner_id"), F.lit("{}").alias("extra"))
    r = spark.range(n).select("id", (F.col("id") % 100).alias("experiment_id"), F.lit("completed").alias("status"), F.lit("train").alias("run_type"), F.timestamp_seconds("id").alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"), F.lit("{}").alias("extra"))
    m = spark.range(n).select(F.col("id").alias("run_id"), F.lit("global").alias("namespace"), F.lit("f1_macro").alias("name"), F.rand(1).alias("value"))
    a = spark.range(10_000).select("id", F.lit(5).cast("long").alias("run_id"), F.lit("critical").alias("severity"))
    tl = T.timeline(e, r, m, a)
    p = T.timeline_page(tl, T.TimelineFilter(limit=1000)).collect()
    assert len(p) == 1000 and p[0]["total"] == n
    assert tl.filter("run_id = 5").head()["critical_alerts"] == 10_000


def test_row_ownership(spark, tables):
    assert Sec.secure_tables(tables, "ana")["run"].count() == 3
    for user, roles in ((" ", []), (None, []), ("ana", ["Admin "])):
        assert Sec.secure_tables(tables, user, roles)["run"].count() == 4
    assert Sec.secure_tables(tables, "zoe", ["administrator"])["run"].count() == 0


def test_ad_hoc_cannot_escape(spark, tmp_path):
    spark.range(5).withColumn("owner_id", F.lit("ana")).write.parquet(str(tmp_path / "t"))
    mk = lambda s: {"experiment": s.read.parquet(str(tmp_path / "t")), "run": s.range(3).withColumn("experiment_id", F.col("id")), "metric": s.range(1).withColumn("run_id", F.col("id")), "alert": s.range(1).withColumn("run_id", F.col("id"))}
    assert Sec.ad_hoc(spark, "SELECT * FROM experiment WHERE id > :x OR 1 = 1", mk, "bob", args={"x": 1}).count() == 0
    assert Sec.ad_hoc(spark, "SELECT * FROM experiment", mk, "ana", cap=3).filter("truncated").count() == 3
    assert Sec.ad_hoc(spark, "WITH x AS (SELECT id FROM experiment) SELECT count(*) AS n FROM x WHERE id IN (SELECT id FROM experiment WHERE upper(owner_id) = 'ANA')", mk, "ana").first()["n"] == 5
    # A CTE is known where it is in scope: inside its own query, in later siblings, in nested queries.
    for good in (
        "WITH a AS (SELECT id FROM experiment), b AS (SELECT id FROM a) SELECT * FROM b", "SELECT * FROM experiment WHERE id IN (WITH z AS (SELECT 1 AS id) SELECT id FROM z)",
        "WITH a AS (SELECT 1 AS id) SELECT id FROM a WHERE EXISTS (SELECT 1 FROM a)", "WITH a AS (WITH b AS (SELECT id FROM experiment) SELECT id FROM b) SELECT id FROM a",
    ):
        assert Sec.ad_hoc(spark, good, mk, "ana").count() > 0
    spark.range(1).createOrReplaceGlobalTempView("leak")
    for bad in (
        "SELECT * FROM secret WHERE 1 IN (WITH secret AS (SELECT 1 AS z) SELECT z FROM secret)", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
        "WITH a AS (WITH b AS (SELECT 1 AS x) SELECT x FROM b) SELECT * FROM b", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "SELECT * FROM (WITH secret AS (SELECT 1) SELECT 1), secret",
    ):
        with pytest.raises(Sec.NotAllowed):
            Sec.ad_hoc(spark, bad, mk, "ana").count()
    for bad in (
        f"SELECT * FROM parquet.`{tmp_path}/t`", "DROP TABLE experiment", "SELECT 1; SELECT 2", "SELECT * FROM global_temp.leak", "SELECT * FROM default.other", "SELECT * FROM other",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.Math', 'random') FROM experiment", "SELECT * FROM range(3)",
        "SELECT id FROM experiment WHERE id IN (SELECT id FROM global_temp.leak)", "WITH x AS (SELECT reflect('java.lang.System', 'exit', 0) AS a) SELECT * FROM x",
        "SELECT (SELECT max(id) FROM spark_catalog.default.other)", "SELECT * FROM IDENTIFIER('global_temp.leak')", "SELECT current_user() FROM experiment", "SELECT * FROM read_files('/')",
    ):
        with pytest.raises(Exception):
            Sec.ad_hoc(spark, bad, mk, "ana").count()
    with pytest.raises(Sec.NotAllowed):
        Sec.check_query(spark, "SELECT * FROM global_temp.leak", ["experiment"])


def test_entry_without_training_data(tmp_path):
    import shutil, subprocess, sys  # noqa: E401
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "pulseframe", tmp_path / "pulseframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'x1_index' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    for names in (["__spark_entry__.py"], ["__spark_entry__.py", "corpus_pipeline.py"]):
        for n in names:
            if (root / n).exists():
                shutil.copy(root / n, tmp_path / n)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_audit_keeps_refused_queries(spark, tmp_path):
    log = str(tmp_path / "audit")

    def refused():
        raise Sec.NotAllowed("no")

    with pytest.raises(Sec.NotAllowed):
        Sec.audited(refused, log, "u", "ad_hoc", {"sql": "x"})
    for _ in range(2):
        assert Sec.audited(lambda: spark.range(3), log, "u", "search", {"q": "a", "k": 5}).count() == 3
    x = spark.read.json(log).collect()
    assert sorted((r.status, r.row_count) for r in x) == [("ok", 3), ("ok", 3), ("rejected", 0)]
    assert len({r.audit_id for r in x}) == 3 and len({r.query_id for r in x}) == 2 and all(r.recorded_at for r in x)


def test_open_interval_holds_to_the_end(spark):
    iv = spark.createDataFrame([("r", 0, 50, "N"), ("r", 50, None, "AFIB"), ("q", 10, None, "N")], "rec string, start long, `end` long, rhythm string")
    ep = spark.createDataFrame([("r", 0, 20), ("r", 40, 60), ("r", 60, 80), ("q", 20, 40), ("z", 0, 20)], "rec string, start long, `end` long")
    got = {(r.rec, r.start): r.rhythm for r in I.contained_episodes(ep, iv, ["rec"], 30.0).collect()}
    assert got == {("r", 0): "N", ("r", 40): None, ("r", 60): "AFIB", ("q", 20): "N", ("z", 0): None}


def test_grid_episodes_equal_single_ones(spark):
    rng = np.random.default_rng(5)
    marks, span = [], [("z", -3, 4), (None, 0, 2), ("one", 7, 7), ("late", 3, 2)]
    for rec in "abcdef":
        t = np.sort(rng.choice(np.arange(-400, 1200), 40, replace=False)).tolist()
        marks += [(rec, x, str(rng.choice(["N", "J", "AFIB"])) if rng.random() < 0.9 else None) for x in t]
        span.append((rec, t[0] // 25 - 2, t[-1] // 25 + int(rng.integers(-3, 3))))
    marks += [("one", 150, "N"), ("one", 150, "J"), ("one", None, "J"), (None, 0, "N"), ("late", 0, "N"), ("other", 0, "N")]
    iv = I.close_intervals(spark.createDataFrame(marks, "rec string, start long, rhythm string").filter("start is not null"), ["rec"], "start", 100).unionByName(
        spark.createDataFrame([("b", None, None, "N"), ("c", None, 500, "N")], "rec string, start long, `end` long, rhythm string")).localCheckpoint()
    span = spark.createDataFrame(span, "rec string, first long, last long")
    ep = span.filter("first <= last").select("rec", F.explode(F.sequence("first", "last")).alias("h")).selectExpr("rec", "h * 25 as start", "(h + 1) * 25 as `end`")
    want = I.contained_episodes(ep, iv, ["rec"], 100).groupBy("rec", "rhythm").agg(F.count("*").alias("n"))
    got = I.contained_grid(span, iv, ["rec"], 25)
    a, b = ({(r.rec, r.rhythm): r.n for r in x.collect()} for x in (want, got))
    assert a == b and len(a) > 15 and sum(b.values()) == ep.count()


def test_episode_rhythm_makes_no_row_per_episode(spark, tmp_path):
    from __spark_entry__ import queries

    last = 2_500_000_000 * 3_600_000  # more hours than fit into one array
    x = spark.createDataFrame([(1, 7, 0, "view"), (2, 7, 10 * 3_600_000 + 1, "click"), (3, 7, last, "purchase")], "event_id long, user_id long, ms long, event_type string")
    x.select("event_id", F.timestamp_millis("ms").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.rhythm: r.n for r in queries()["j4_episode_rhythm"](spark, str(tmp_path)).collect()}
    assert got == {"SINUS": 10, "OTHER_RHYTHM": 2_500_000_000 - 11 + 1, "BOUNDARY": 1}


def test_one_sided_cluster_is_an_error(spark):
    from pulseframe.operators import resampling as Rs

    mk = lambda ids: spark.createDataFrame([(i, 1, 1) for i in ids], "c string, y_true int, y_pred int")
    assert Rs.cluster_f1_delta(mk("ab"), mk("ab"), "c", 1, 5).count() == 5
    with pytest.raises(Exception, match="one side only"):
        Rs.cluster_f1_delta(mk("abd"), mk("ab"), "c", 1, 5).collect()
    assert [tuple(r) for r in Rs.unmatched_clusters(mk("abd"), mk("abe"), "c").orderBy("c").collect()] == [("d", "a", 1), ("e", "b", 1)]


def test_schema_help_and_capped(tables):
    assert T.schema_help(tables, [("run", "experiment")]).filter("kind = 'relation'").count() == 1
    x = T.capped(tables["alert"], [F.col("id")], 10).collect()
    assert len(x) == 10 and x[0]["truncated"]


# ---- metrics ----------------------------------------------------------------------------

def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auroc_ties_and_temperature(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame([("c", int(a), float(b)) for a, b in zip(y, p)], "class string, y int, p double")
    got = M.auroc_ap(df, ["class"]).head()
    assert math.isclose(got["auc_roc"], brute_auc(y, p), abs_tol=1e-12)
    from pulseframe.functions.probability import temperature

    warm = df.filter("p > 0 and p < 1").withColumn("p", F.round(temperature(F.col("p"), 2.0), 12))
    assert math.isclose(M.auroc_ap(warm, ["class"]).head()["auc_roc"], M.auroc_ap(df.filter("p > 0 and p < 1"), ["class"]).head()["auc_roc"], abs_tol=1e-9)


def test_undefined_auroc_is_null(spark):
    df = spark.createDataFrame([("c", 1, 0.5), ("c", 1, 0.6)], "class string, y int, p double")
    r = M.auroc_ap(df, ["class"]).head()
    assert r["auc_roc"] is None and r["auc_pr"] == 1.0


def test_calibration_edges(spark):
    df = spark.createDataFrame([("c", 1, 1.0), ("c", 0, 0.0), ("c", 1, 0.2), ("c", 0, 0.2)], "class string, y int, p double")
    bins = {r["bin"]: r["n"] for r in C.reliability(df, ["class"], 5).collect()}
    assert bins == {0: 1, 1: 2, 4: 1}


def test_temperature_fit_recovers_scale(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    p = 1 / (1 + np.exp(-3 * z))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    assert abs(C.fit_temperature(df) - 3.0) < 0.3


def test_legacy_threshold_is_the_next_lower(spark):
    df = spark.createDataFrame([("c", y, p) for y, p in ((1, 0.9), (1, 0.8), (0, 0.7), (0, 0.1))], "class string, y int, p double")
    assert M.max_f1_threshold(df, ["class"]).head()["threshold"] == 0.8
    assert M.max_f1_threshold(df, ["class"], legacy=True).head()["threshold"] == 0.7


# ---- text -------------------------------------------------------------------------------

def test_porter_known_stems():
    known = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "agreed": "agre", "happy": "happi", "sky": "sky", "triplicate": "triplic", "adoption": "adopt", "running": "run"}
    assert {w: TX.porter(w) for w in known} == known


def test_personal_data(spark):
    t = ["CPF 123.456.789-09", "x 12.345.678/0001-90", "a.b@c.org", "Paciente: Ana", "nothing here"]
    got = rows(spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t string").orderBy("i"), F.size(TX.pii(F.col("t"))))
    assert [g[0] for g in got] == [1, 1, 1, 1, 0]


def chunks_by_hand(text, size, overlap):
    parts = [text]
    for sep in ("\n\n", "\n", ". ", " "):
        cut = lambda p: [q for q in [*(q + sep for q in p.split(sep)[:-1]), p.split(sep)[-1]] if q]
        parts = [q for p in parts for q in ([p] if len(p) <= size else cut(p))]
    parts = [p[i : i + size] for p in parts for i in range(0, len(p), size)]
    out, cur = [], ""
    for p in parts:
        if cur and len(cur) + len(p) > size:
            out.append(cur)
            n = min(overlap, size - len(p))
            tail = cur[-n:] if n > 0 else ""
            if len(cur) > n > 0 and cur[-n - 1] not in " \t\n\r":
                tail = tail.lstrip("".join(set(tail) - set(" \t\n\r"))) if any(c in " \t\n\r" for c in tail) else ""
            cur = tail
        cur += p
    return [c.strip(" \t\n\r") for c in [*out, cur] if c.strip(" \t\n\r")]


def test_chunks_by_hand(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdé\U0001f600", k=rng.randint(1, 9)))
    texts = ["".join(word() + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "\n\n\n", "\t", "  "]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += ["x" * 1500, "a " + "y" * 130 + " b. c", "", "   \n", "one. two"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    for size, overlap in ((40, 12), (64, 0), (10, 9)):
        got = {}
        for r in TX.chunk(df, "t", size, overlap).orderBy("i", "part").collect():
            got.setdefault(r.i, []).append(r.content)
            assert len(r.content) <= size and r.n_parts > r.part
        assert got == {i: c for i, t in enumerate(texts) if (c := chunks_by_hand(t, size, overlap))}
        words = {w for t in texts for w in t.split()}
        long = [w for t in texts for w in t.replace("\n", " ").split(" ") if len(w) > size]
        assert all(w in words or any(w in v for v in long) for c in got.values() for p in c for w in p.split())
    whole = rows(TX.chunk(df.filter("i = 60"), "t", keep_whole=1500), "content")
    assert whole[0][0] == "x" * 1500


def test_header_path_is_carried(spark):
    text = "intro\n# A\none\n## A1\ntwo\n## A2\nthree\n# B\nfour\n### deep\nfive\n## B1\nsix"
    df = spark.createDataFrame([(1, text, 5)], "id int, t string, section int").drop("section")
    got = [tuple(r) for r in TX.split_markdown(df, "t", 2).orderBy("section").select("header_1", "header_2", "body").collect()]
    assert got == [(None, None, "intro"), ("A", None, "one"), ("A", "A1", "two"), ("A", "A2", "three"), ("B", None, "four\n### deep\nfive"), ("B", "B1", "six")]
    assert [r.header_1 for r in TX.split_markdown(df, "t").orderBy("section").collect()] == [None, "A", "B"]


# ---- signals ----------------------------------------------------------------------------

def test_zero_phase_gain_on_sines():
    # the middle of a long signal: edge transients of a 0.5 Hz corner last for seconds
    t = np.arange(40_000) / 500.0
    for f, lo, hi in ((10.0, 0.98, 1.02), (0.05, 0.0, 0.2), (120.0, 0.0, 0.01)):
        y = K.zero_phase_band(np.sin(2 * np.pi * f * t), 500.0, 0.5, 40.0, 4)[15_000:25_000]
        assert lo <= np.abs(y).max() <= hi


def test_resample_keeps_a_sine():
    x = np.sin(2 * np.pi * 5 * np.arange(3600) / 360.0)
    y = K.resample(x, 360.0)
    want = np.sin(2 * np.pi * 5 * np.arange(len(y)) / 500.0)
    assert len(y) == 5000 and np.abs(y - want)[200:-200].max() < 0.01


def test_peak_detector_on_spikes():
    x = np.zeros(5000)
    at = np.arange(300, 4800, 400)
    for p in at:
        x[p - 10 : p + 11] += np.hanning(21)
    got = np.array(K.r_peaks(x))
    assert all(np.abs(got - p).min() <= 75 for p in at) and len(got) == len(at)


def test_segmentation_borders_and_edge_padding(spark):
    sig = spark.createDataFrame([("d", "r", [float(i) for i in range(2000)])], "dataset string, record_id string, samples array<double>")
    b = spark.createDataFrame([("d", "r", 100, 1000.0), ("d", "r", 600, 500.0), ("d", "r", 1200, 800.0)], "dataset string, record_id string, peak long, rr_for_window double")
    x = Wv.segment_beats(b, sig, ["dataset", "record_id"], "samples", block=700).orderBy("peak").collect()
    assert [r["peak"] for r in x] == [600, 1200]
    w = x[0]["waveform"]
    assert len(w) == 500 and w[0] == w[99] == w[100] == 450.0 and w[-1] == 749.0 and x[1]["waveform"][0] == 950.0


def test_clean_rejects_bad_records(spark):
    t = np.arange(1000) / 500.0
    df = spark.createDataFrame([("a", 500.0, np.sin(60 * t).tolist()), ("b", 500.0, [float("nan")] * 100), ("c", 500.0, [])], "record_id string, fs double, samples array<double>")
    good, bad = Wv.clean(df, ["record_id"], "samples", "fs")
    assert [r["record_id"] for r in good.collect()] == ["a"] and {r["record_id"] for r in bad.collect()} == {"b", "c"}


# ---- splits and sampling ----------------------------------------------------------------

def test_group_folds_level_a_hot_group(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id") % 200).alias("g"), (F.col("id") % 7).alias("y"))
    a = Sp.group_folds(df, "g", 5)
    assert a.count() == 201 and a.select("g").distinct().count() == 201
    n = sorted(r["count"] for r in df.join(a, "g").groupBy("fold").count().collect())
    assert n[-1] == 3000 and n[0] >= 1470 and n[3] <= 1530
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, Sp.group_folds(df, "g", 5).collect()))


def test_stratified_folds_spread_the_rare_class(spark):
    df = spark.range(4000).select((F.col("id") % 100).alias("g"), F.when(F.col("id") % 100 < 10, F.when(F.floor(F.col("id") / 100) % 4 == 0, "F").otherwise("N")).otherwise("N").alias("y"))
    # ten groups of ten rare rows each: exactly two groups per fold
    a = Sp.stratified_group_folds(df, "g", "y", ["N", "F"], 5)
    n = [r["n"] for r in df.join(a, "g").groupBy("fold").agg(F.count_if(F.col("y") == "F").alias("n")).collect()]
    assert n == [20] * 5


def test_even_positions_match_linspace(spark):
    for n, k in ((1000, 256), (300, 7), (5, 9)):
        for rounded in (False, True):
            x = spark.range(n).filter(Sm.is_even_position(F.col("id"), F.lit(n), k, rounded))
            grid = np.linspace(0, n - 1, k)
            want = set(range(n)) if n <= k else set((np.rint(grid) if rounded else grid).astype(int).tolist())
            assert {r["id"] for r in x.collect()} == want


def test_nearest_neighbours_over_blocks(spark, monkeypatch):
    from pulseframe.operators import search as Se

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4)).round(1)
    x[20:] = x[:20]  # ties
    monkeypatch.setattr(Se, "QUERY_BLOCK", 7)
    monkeypatch.setattr(Se, "CHUNK_BLOCK", 9)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i in range(40) for r, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert {(r.qid, r.id, r["rank"]) for r in Sm.neighbour_pairs(df, "id", "v", 3).collect()} == want
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = (u @ u.T).round(9)
    best = {(i, int(j)) for i in range(40) for j in np.argsort(-c[i], kind="stable")[:5]}
    assert {(r.qid, r.id) for r in Se.knn(df, df, 5, "id", "v", "id", "v").collect()} == best


def test_smote_stays_between_neighbours(spark):
    df = spark.createDataFrame([(i, 1, [float(i), 0.0]) for i in range(10)], "id long, y int, v array<double>")
    x = Sm.smote(df, "y", "id", "v", 1, 25, k=2).collect()
    assert len(x) == 25 and all(0 <= r["v"][0] <= 9 and r["v"][1] == 0 for r in x)


def test_checks(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert Q.required_columns(df, ["a", "z"]).head()["status"] == "FAIL"
    assert Q.schema_compatible(df, ["a"], ["a"]).head()["status"] == "PASS"


def test_isotonic_steps_equal_pooling_by_hand(spark, monkeypatch):
    """Blocks of 16 scores and 7 cuts: every fitted value as pooled one by one; between steps a line, outside the end values."""
    import random

    from pulseframe.operators import calibration as C

    monkeypatch.setattr(C, "BLOCK", 16)
    r = random.Random(1)
    rows = [(k, p, int(r.random() < p)) for k, d in (("a", 3), ("b", 2)) for p in (round(r.random() * 0.98 + 0.01, d) for _ in range(600))]
    rows += [("c", 0.5, 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, p double, y int")
    steps = C.isotonic_steps(df, ["k"], cuts=7)
    asked = df.select("k", "p").unionByName(spark.createDataFrame([("a", 0.0), ("a", 1.0), ("c", 0.1), ("z", 0.5)], "k string, p double"))
    got = {(x.k, x.p): x.calibrated for x in C.apply_isotonic(asked, steps, ["k"]).collect()}
    for key in "abc":
        mine = [(p, y) for k, p, y in rows if k == key and p is not None]
        pools: list[list] = []
        for x in sorted({p for p, _ in mine}):
            ys = [y for p, y in mine if p == x]
            pools.append([sum(ys), len(ys), [x]])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                s, n, xs = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + xs]
        for s, n, xs in pools:
            assert all(abs(got[key, x] - s / n) < 1e-9 for x in xs)
        if key == "a":
            assert abs(got["a", 0.0] - pools[0][0] / pools[0][1]) < 1e-9 and abs(got["a", 1.0] - pools[-1][0] / pools[-1][1]) < 1e-9
    assert got["a", None] is None and got["z", 0.5] is None and got["c", 0.1] == 1.0
    low, high = steps.filter("k = 'b' and x_up is not null and x_up > x_hi").orderBy("x_hi").select("x_hi", "x_up", "value", "value_up").head(2)
    ask = spark.createDataFrame([("b", (s.x_hi * 3 + s.x_up) / 4) for s in (low, high)], "k string, p double")
    got = sorted(x.calibrated for x in C.apply_isotonic(ask, steps, ["k"]).collect())
    assert got == pytest.approx(sorted(s.value + (s.value_up - s.value) / 4 for s in (low, high)))


def test_seed_average_ties_do_not_hang_on_the_last_digit(spark):
    """Three seeds whose exact means of p0 and p2 are equal (58, 104 and 78 parts); as doubles p2 is larger by one unit in the last place."""
    from pulseframe.operators import matrix as X

    rows = [(1, "a", 0, 0.3620689655172414, 0.02586206896551724, 0.6120689655172413), (1, "a", 0, 0.7019230769230769, 0.19230769230769232, 0.10576923076923077), (1, "a", 0, 0.08974358974358974, 0.47435897435897434, 0.4358974358974359)]
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        df = spark.createDataFrame([rows[i] for i in order], "sample_id long, patient_id string, y_true int, p0 double, p1 double, p2 double").coalesce(1)
        assert [r.y_pred for r in X.seed_average(df, "sample_id", ["p0", "p1", "p2"], 3)[0].collect()] == [0]


def test_best_rows_over_blocks_equal_brute_force_and_queries_can_be_chosen():
    """running best of blocks against all pairs at once, with copies, zeros and few rows."""
    import numpy as np
    import pyarrow as pa

    from pulseframe.operators.neighbours import Best, unit

    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)) * 10.0 ** rng.integers(-4, 4, 900)[:, None]
    x[100:400] = x[100]
    x[5] = 0
    ids = rng.permutation(900).astype(np.int64) * 3
    for euclidean in (False, True):
        best = Best(pa.array(ids[:600]), x[:600], 7, euclidean)
        for a, b in ((0, 3), (3, 450), (450, 900)):
            best.add(pa.array(ids[a:b]), x[a:b])
        got = best.result().to_pydict()
        u = x if euclidean else unit(x)
        s = -np.sqrt(np.square(u[:600, None, :] - u[None]).sum(axis=2)).round(9) if euclidean else np.einsum("id,jd->ij", u[:600], u).round(9)
        if euclidean:
            s[np.arange(600), np.arange(600)] = -np.inf
        want = [(i, ids[j]) for k, i in enumerate(ids[:600]) for j in np.lexsort((ids, -s[k]))[:7]]
        assert list(zip(got["qid"], got["id"])) == want


def test_rejects_chunk_the_texts_once(spark):
    """as many rows as before, from one reading of the documents."""
    from pulseframe.operators import search as Se

    df = spark.createDataFrame([(1, "a.md", "same words"), (2, "a.md", "same words"), (3, "a.md", "same words"), (4, "b.md", "mail x@y.org"), (5, "b.md", "mail x@y.org")], "doc_id long, path string, text string")
    kept, rejects = Se.build_index(df, "path", "text", ["doc_id"])
    assert sorted((r.reason, r.n_matches) for r in rejects.collect()) == [("DUPLICATE_CHUNK_ID", 0)] * 2 + [("PII_DETECTED", 1)] * 2
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("posexplode")
    assert plan(rejects) <= plan(kept)


def test_coverage_is_one_shuffle(spark):
    """Same rows as four anti joins, nulls and repeated keys included, from one exchange and no sort."""
    from pulseframe.operators import sets as U

    mk = lambda v: spark.createDataFrame([(a, b) for a, b in v], "a int, b string")
    c, l, f = mk([(1, "x"), (2, "x"), (2, "x"), (None, "x"), (5, None)]), mk([(2, "x"), (3, "x"), (3, "x"), (None, "x")]), mk([(1, "x"), (4, "x"), (5, None)])
    got = U.coverage(c, l, f, ["a", "b"])
    anti = lambda p, q, w: [(*r, w) for r in p.distinct().join(q, ["a", "b"], "left_anti").collect()]
    want = anti(c, l, "missing_lineage") + anti(c, f, "missing_file") + anti(l, c, "orphan_lineage") + anti(f, c, "orphan_file")
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, want)) and len(want) == 10
    plan = U.coverage(c, l, f, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
