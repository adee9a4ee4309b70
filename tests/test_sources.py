"""File-based sources, sinks and small streams."""

import json

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import quality as Q
from pulseframe.operators.tracking import append_rows
from pulseframe.sources import catalog as Cat, tables as Tb
from pulseframe.streaming import jobs as J


def test_catalog_scan_is_strict(spark, tmp_path):
    good = {"record_name": "r1", "dataset": "d", "fs": 360, "n_sig": 1, "sig_len": 10, "sig_name": ["MLII"]}
    (tmp_path / "ok.jsonl").write_text(json.dumps(good) + "\n")
    (tmp_path / "bad.jsonl").write_text(json.dumps(good) + "\n{oops\n")
    assert Cat.read_catalog(spark, str(tmp_path / "ok.jsonl")).head()["fs"] == 360
    with pytest.raises(Exception):
        Cat.read_catalog(spark, str(tmp_path / "bad.jsonl")).collect()
    rows, bad = Cat.read_lines(spark, str(tmp_path / "bad.jsonl"))
    assert rows.count() == 1 and bad.head()["error"] == "malformed"


def test_publish_refuses_to_overwrite(spark, tmp_path):
    p = str(tmp_path / "t")
    Tb.publish(spark.range(3), p)
    with pytest.raises(Exception):
        Tb.publish(spark.range(3), p)
    assert Tb.scan(spark, p, ["id"]).count() == 3


def test_pair_check(spark):
    x = Tb.paired_mismatch(spark.range(3), spark.range(1, 4), "id")
    assert {(r["id"], r["problem"]) for r in x.collect()} == {(0, "no_metadata"), (3, "no_array")}


def test_reject_replay(spark, tmp_path):
    p = str(tmp_path / "dlq")
    r = spark.createDataFrame([("a", "d", "filter", "x"), ("b", "d", "filter", "y")], "record_id string, dataset string, step string, error string")
    Tb.append_rejects(r, p)
    (tmp_path / "dlq" / "extra.json").write_text("{broken\n")
    kept, counts = Tb.replay(Tb.read_rejects(spark, p), lambda k: k.filter("record_id = 'a'"))
    assert [x["record_id"] for x in kept.collect()] == ["b"]
    assert {x["outcome"]: x["n"] for x in counts.collect()} == {"success": 1, "kept": 1, "invalid": 1}


def test_matrix_scan_reads_completed_cells(spark, tmp_path):
    for c, s in (("a", 1), ("a", 2), ("b", 1)):
        d = tmp_path / f"candidate={c}" / "fold=0" / f"seed={s}"
        d.mkdir(parents=True)
        (d / "metrics.json").write_text(json.dumps({"F1_F": 0.5, "scopes": {"x": {"F1_F": 0.1}}}, indent=1))
    done = spark.createDataFrame([("a", 0, 1), ("b", 0, 1)], "candidate string, fold int, seed int")
    m = Tb.matrix_metrics(spark, str(tmp_path), done, "F1_F double, scopes struct<x:struct<F1_F:double>>")
    assert m.count() == 2


def test_bulk_append(spark, tmp_path):
    p = str(tmp_path / "metric")
    append_rows(spark.range(10).withColumn("run_id", F.col("id") % 2), p, ["run_id"])
    append_rows(spark.range(5).withColumn("run_id", F.lit(7)), p, ["run_id"])
    assert spark.read.parquet(p).filter("run_id = 7").count() == 5


def test_file_hashes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    f = Q.file_hashes(spark, str(tmp_path))
    a = Q.directory_checksum(f).head()
    assert a["n_files"] == 2 and a["checksum"] == Q.directory_checksum(f.repartition(3)).head()["checksum"]


def test_causal_stream_over_two_batches(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "work"
    beats = [("r", i, i * 500 + (i * i) % 37) for i in range(12)]
    df = lambda b: spark.createDataFrame(b, "record string, id long, peak long")
    df(beats[:5]).coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema("record string, id long, peak long").parquet(str(src))
    x = J.causal_stream(s, "record", "id", "peak", 500.0)
    J.run_to_table(x, str(out))
    df(beats[5:]).coalesce(1).write.mode("append").parquet(str(src))
    got = J.run_to_table(x, str(out))
    from pulseframe.operators.sequences import causal_features

    want = causal_features(df(beats), ["record"], bucket_width=1000)
    cols = ["id", "rr_prev_1", "rr_prev_4", "rr_prev_median_4"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0 and got.count() == 12


def test_beats_out_of_order_wait_for_the_watermark(spark, tmp_path):
    """Two files out of time order: every beat comes out once, in event order; a beat behind the watermark is counted."""
    import datetime as dt

    src = str(tmp_path / "in")
    at = lambda ms: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms)
    df = lambda b: spark.createDataFrame([(r, i, p, at(p) if p is not None else at(10**9)) for r, i, p in b], "record string, id long, peak long, at timestamp")
    beats = [("r", i, i * 500 + (i * i) % 37) for i in range(12)]
    for part in (beats[6:], beats[:6], [(None, None, None)]):
        df(part).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(df(beats).schema).option("maxFilesPerTrigger", "1").parquet(src)
    x = J.causal_stream(s, "record", "id", "peak", 500.0, "at", "1 hour")
    got = J.run_to_table(x, str(tmp_path / "work"))
    from pulseframe.operators.sequences import causal_features

    want = causal_features(spark.createDataFrame(beats, "record string, id long, peak long"), ["record"], bucket_width=1000)
    cols = ["id", "rr_prev_1", "rr_prev_4", "rr_prev_median_4"]
    assert got.count() == 12 and got.select(*cols).exceptAll(want.select(*cols)).count() == 0 and got.filter("late").count() == 0


def test_beats_without_event_time_are_flagged_not_lost(spark, tmp_path):
    src = str(tmp_path / "in")
    df = lambda b: spark.createDataFrame(b, "record string, id long, peak long")
    for part in ([("r", 1, 1000), ("r", 2, 2000)], [("r", 3, 1500), ("r", 4, 3000)]):
        df(part).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(df([("r", 1, 1)]).schema).option("maxFilesPerTrigger", "1").parquet(src)
    got = J.run_to_table(J.stability_stream(s, "record", "id", "peak", 10.0, 0.5), str(tmp_path / "work"))
    assert sorted((r.id, r.late) for r in got.collect()) == [(1, False), (2, False), (3, True), (4, False)]


def test_state_of_a_sliced_stream_stays_small(spark, tmp_path):
    """A record of 6 slices: every row as in order of time, and no state ever held more than three slices of its beats."""
    import datetime as dt

    from pulseframe.plans.source_queries import sliced_stream

    start, per_slice, slices = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), 30, 6
    step = 86400 // per_slice
    peaks = [i * step * 1000 + (i * i) % 37 for i in range(per_slice * slices)]
    beats = [("r", i, p, start + dt.timedelta(seconds=i * step)) for i, p in enumerate(peaks)]
    df = spark.createDataFrame(beats, "record string, id long, peak long, at timestamp")
    x = J.causal_stream(sliced_stream(df, "at", 1), "record", "id", "peak", 1.0, "at", "1 day")
    got = J.run_to_table(x, str(tmp_path / "work")).collect()
    assert sorted((r.id, r.peak, r.late) for r in got) == [(i, p, False) for i, p in enumerate(peaks)]
    rr = {r.id: (r.rr_prev_1, r.rr_prev_4) for r in got}
    assert all(rr[i] == ((peaks[i] - peaks[i - 1]) * 1000.0, (peaks[i - 3] - peaks[i - 4]) * 1000.0) for i in range(4, len(peaks)))
    most = 0
    for batch in range(slices):
        state = spark.read.format("statestore").option("batchId", batch).load(str(tmp_path / "work" / "state"))
        most = max([most, *[len(r.w) for r in state.select(F.col("value.groupState.wait_peak").alias("w")).collect()]])
    assert 0 < most <= 3 * per_slice  # two slices and one batch


def test_stream_state_is_held_by_bucket_and_outlives_a_gap(spark, tmp_path):
    """400 records need no more states than buckets, and a record silent for five slices still knows its last beat."""
    import datetime as dt

    from pulseframe.plans.source_queries import sliced_stream

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda s: start + dt.timedelta(seconds=s)
    beats = [(r, 10 * r + i, s, at(s)) for r in range(400) for i, s in enumerate((r, 86_400 + 2 * r))] + [(7, 5000, 7 * 86_400, at(7 * 86_400))] + [(8, 5001 + d, d * 86_400, at(d * 86_400)) for d in range(2, 7)]
    df = spark.createDataFrame(beats, "record long, id long, peak long, at timestamp")
    x = J.causal_stream(sliced_stream(df, "at", 1), "record", "id", "peak", 1000.0, "at", "1 day", None)
    got = {r.id: r for r in J.run_to_table(x, str(tmp_path / "work")).collect()}
    assert len(got) == len(beats) and not any(r.late for r in got.values())
    assert got[5000].rr_prev_1 == 7 * 86_400 - (86_400 + 14) and all(got[10 * r + 1].rr_prev_1 == 86_400 + r for r in range(400))
    state = spark.read.format("statestore").load(str(tmp_path / "work" / "state"))
    assert 0 < state.count() <= J.BUCKETS < 400
