"""Signals in blocks against the same steps on whole records."""

import numpy as np
import pandas as pd
import pytest
from __spark_entry__ import queries
from pyspark.sql import functions as F

from pulseframe.functions import signal as K
from pulseframe.operators import templates as Tp, waveforms as Wv
from pulseframe.plans.signal_queries import signals


def beats(n, seed, low=0.5, high=1.5):
    r = np.random.default_rng(seed)
    x = 0.03 * r.normal(size=n) + 0.3 * np.sin(np.arange(n) / 700) + 0.00002 * np.arange(n)
    p, at = 200, []
    while p < n - 160:
        x[p - 10 : p + 11] += np.hanning(21) * r.uniform(low, high)
        x[p + 90 : p + 140] += 0.3 * np.hanning(50)
        at.append(p)
        p += int(r.uniform(250, 600))
    return x, at


@pytest.fixture(scope="module")
def records(spark):
    rows = [("long", 360.0, beats(200_000, 1)[0].tolist()), ("mid", 250.0, beats(40_000, 2)[0].tolist()), ("same", 500.0, beats(3_000, 3)[0].tolist()), ("tiny", 128.0, beats(20, 4)[0].tolist()), (None, 1000.0, beats(33_000, 5)[0].tolist())]
    return rows, spark.createDataFrame(rows, "id string, fs double, x array<double>")


def by_record(blocks):
    return {r.id: np.array(r.samples) for r in Wv.assembled(blocks, ["id"]).collect()}


def test_resampling_in_blocks(spark, records):
    rows, df = records
    got = by_record(Wv.resample(df, ["id"], "x", "fs"))
    for i, fs, x in rows:
        want = K.resample(np.array(x), fs)
        assert len(got[i]) == len(want) and np.abs(got[i] - want).max() < 1e-9
    assert Wv.resample(df, ["id"], "x", "fs").filter("id = 'long'").count() == -(-len(got["long"]) // 32_775)
    halo = Wv.resampled_pieces(df, ["id"], "x", "fs", block=5000, halo=777).filter("id = 'long'").collect()
    assert all(np.abs(np.array(r.piece) - got["long"][r.piece_from : r.piece_from + len(r.piece)]).max() < 1e-9 for r in halo) and all(r.piece_from <= max(0, r.core_from - 777) for r in halo)


def test_filter_in_blocks(spark, records):
    rows, df = records
    got = by_record(Wv.band_pass(df, ["id"], "x"))
    for i, _, x in rows:
        want = K.detrend(K.zero_phase_band(np.array(x), 500.0, 0.5, 40.0, 4))
        assert len(got[i]) == len(want) and np.abs(got[i] - want).max() < 1e-6


def test_cleaning_in_blocks(spark, records):
    rows, df = records
    bad = spark.createDataFrame([("nan", 360.0, [1.0, float("nan")] * 20), ("short", 360.0, [1.0] * 5), ("null", 360.0, None), ("hole", 360.0, [None] * 20)], df.schema)
    good, rejected = Wv.clean(df.union(bad), ["id"], "x", "fs", clip=0.4, z_clip=2.5)
    assert {r.id for r in rejected.collect()} == {"nan", "short", "null", "hole"}
    got = {r.id: r for r in good.collect()}
    for i, fs, x in rows:
        y = K.detrend(K.zero_phase_band(K.resample(np.array(x), fs), 500.0, 0.5, 40.0, 4))
        c = np.clip(y, -0.4, 0.4)
        z = (c - c.mean()) / (c.std() + 1e-12)
        assert np.abs(np.array(got[i].x) - np.clip(z, -2.5, 2.5)).max() < 1e-5
        assert got[i].lineage.n_clipped == (np.abs(y) > 0.4).sum() and abs(got[i].lineage["std"] - c.std()) < 1e-7


@pytest.fixture
def written(monkeypatch):
    """Samples in the frames that the steps write and read back."""
    sizes, pinned = [], Wv.pinned

    def seen(df):
        out = pinned(df)
        sizes.extend(out.agg(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0] for c, t in df.dtypes if t == "array<double>")
        return out

    monkeypatch.setattr(Wv, "pinned", seen)
    return sizes


def test_short_records_are_not_written(spark, written):
    """a record of one block is cleaned in one pass; nothing of its samples goes to disk."""
    sf = "/root/testdata/sf0.001"
    got = {r.record_id: r for r in queries()["g3_clean"](spark, sf).collect()}
    rows = signals(spark, sf).collect()
    assert len(got) == len(rows) and sum(written) == 0
    for r in rows[:20]:
        y = K.detrend(K.zero_phase_band(K.resample(np.array(r.samples), r.fs), 500.0, 0.5, 40.0, 4))
        z = np.clip((np.clip(y, -5, 5) - np.clip(y, -5, 5).mean()) / (np.clip(y, -5, 5).std() + 1e-12), -10, 10)
        assert got[r.record_id].n == len(y) and abs(got[r.record_id]["std"] - z.std()) < 1e-3 and got[r.record_id].n_clipped == (np.abs(y) > 5).sum()
    assert Wv.band_pass(signals(spark, sf), ["record_id"], "samples").count() == len(rows) and sum(written) == 0


def test_long_records_are_written_once(spark, records, written):
    rows, df = records
    size = {i: -(-len(x) * 500 // int(fs)) for i, fs, x in rows}
    stats, bad = Wv.clean_stats(df, ["id"], "x", "fs", clip=0.4)
    got = {r.id: r for r in stats.collect()}
    assert bad.count() == 0 and {i: r.n for i, r in got.items()} == size
    assert sum(written) == size["long"] + size["mid"]
    for i, fs, x in rows:
        y = K.detrend(K.zero_phase_band(K.resample(np.array(x), fs), 500.0, 0.5, 40.0, 4))
        c = np.clip(y, -0.4, 0.4)
        assert abs(got[i].lineage["std"] - c.std()) < 1e-7 and abs(got[i].mean) < 1e-6 and got[i].lineage.n_clipped == (np.abs(y) > 0.4).sum()


def test_cleaning_by_given_statistics(spark, records):
    rows, df = records
    given = spark.createDataFrame([("long", 0.1, 2.0), ("tiny", 0.2, 4.0), (None, 0.3, 3.0)], "id string, mean double, std double")
    good, _ = Wv.clean(df, ["id"], "x", "fs", stats=given, by="id")
    got = {r.id: np.array(r.x) for r in good.collect()}
    assert set(got) == {"long", "tiny"}
    for i, mu, sd in (("long", 0.1, 2.0), ("tiny", 0.2, 4.0)):
        fs, x = next((fs, x) for k, fs, x in rows if k == i)
        y = K.detrend(K.zero_phase_band(K.resample(np.array(x), fs), 500.0, 0.5, 40.0, 4))
        assert np.abs(got[i] - (np.clip(y, -5, 5) - mu) / sd).max() < 1e-5


@pytest.mark.parametrize("block,wave", [(50_000, 20), (7_000, 3), (4_100, 1)])
def test_peaks_across_blocks_and_waves(spark, records, block, wave):
    rows, df = records
    got = {}
    for r in Wv.detect_peaks(df, ["id"], "x", block=block, blocks_a_wave=wave).collect():
        got.setdefault(r.id, []).append(r.peak)
    for i, _, x in rows:
        assert sorted(got.get(i, [])) == K.r_peaks(np.array(x))


def test_peaks_score_against_annotations():
    """F1 of the detector within 75 samples (150 ms); the published levels miss faint beats after strong ones, but find no beat where none is."""
    hit = n_found = n_true = 0
    for seed in range(8):
        x, at = beats(60_000, seed, 0.9, 1.1)
        found, open_ = np.array(K.r_peaks(x)), list(at)
        for p in found:
            near = min(open_, key=lambda a: abs(a - p), default=None)
            if near is not None and abs(near - p) <= 75:
                open_.remove(near)
                hit += 1
        n_found, n_true = n_found + len(found), n_true + len(at)
    assert 2 * hit / (n_found + n_true) > 0.975 and hit == n_found


def test_levels_can_stop_anywhere():
    x, _ = beats(20_000, 9)
    n = len(x)
    band, power = (v[0] for v in K.beat_power(x[None], 500.0))
    whole = K.scan_beats(K.Levels.first(power, n, 500.0), power, band, 0, n, n, 500.0)
    s, got, start = K.Levels.first(power, n, 500.0), [], 0
    for stop in (1, 500, 501, 4000, 12_345, n):
        a, b = max(0, start - 20), min(n, stop + 200)
        got += K.scan_beats(s, power[a:b], band[a:b], start, stop, n, 500.0)
        start = stop
    assert got == whole and len(whole) >= 30


def test_morphology_by_hand(spark):
    x = np.zeros(500)
    x[240:261] = np.concatenate([np.linspace(0, 2, 11), np.linspace(1.8, 0, 10)])
    x[236:240], x[330:380] = -0.3, 0.4 * np.hanning(50)
    df = spark.createDataFrame([(1, x.tolist()), (2, [0.0] * 500), (3, None), (4, [1.0, -2.0, 0.5])], "id int, w array<double>")
    got = {r.id: r for r in Wv.morphology(df, ["id"], "w").collect()}
    r = got[1]
    assert (r.r_amplitude, r.q_depth) == (2.0, -0.3) and abs(r.t_amplitude - 2.0) < 1e-12 and 20 <= r.qrs_width_ms <= 180
    on = int(r.j_point - r.qrs_width_ms / 2)
    assert abs(r.qrs_area - np.trapezoid(np.abs(x[on : r.j_point]), dx=1 / 500)) < 1e-9 and abs(r.qrs_raggedness - np.abs(x[on : r.j_point]).std()) < 1e-9
    assert abs(r.qrs_asymmetry_index - (250 - on) / (r.j_point - 250)) < 1e-9
    assert abs(r.st_slope_mV_s - np.polyfit(np.arange(10), x[r.j_point + 30 : r.j_point + 40], 1)[0] * 500) < 1e-9
    assert got[2].qrs_asymmetry_index is None and got[2].t_r_ratio is None and got[3].r_amplitude is None and got[4].r_amplitude == -2.0
    assert Wv.detect_peaks(df, ["id"], "w").filter("id in (3, 4)").count() == 0
    assert Wv.detect_peaks(df.filter("id = 3"), ["id"], "w").columns == ["id", "peak"]


def test_template_features_by_hand(spark):
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v)
    bank = {c: np.array([unit(rng.normal(size=11)) for _ in range(k)]) for c, k in (("N", 3), ("V", 2), ("F", 2))}
    windows = [unit(rng.normal(size=11)) for _ in range(20)] + [bank["N"][1], unit(bank["N"][0] + bank["V"][1]), np.zeros(11)]
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(windows)], "id int, u array<double>")
    two = {r.id: r for r in Tp.template_features(df, ["id"], "u", {c: bank[c] for c in "NV"}).collect()}
    three = {r.id: r for r in Tp.template_features(df, ["id"], "u", bank).collect()}
    assert list(two[0].asDict()) == ["id", *Tp.NV_FEATURES] and list(three[0].asDict()) == ["id", *Tp.NVF_FEATURES]
    cos = lambda a, b: a @ b / max(np.linalg.norm(a), 1e-8) / max(np.linalg.norm(b), 1e-8)
    for i, w in enumerate(windows):
        t = {c: max(bank[c], key=lambda b: round(float(w @ b), 12)) for c in "NVF"}
        corr = {c: w @ t[c] for c in t}
        dist = {c: np.sqrt(max(0, 2 - 2 * corr[c])) for c in t}
        for c in "NVF":
            assert np.isclose(three[i][f"template_corr_{c}"], corr[c]) and np.isclose(three[i][f"template_distance_{c}"], dist[c], atol=1e-7)
            assert np.isclose(three[i][f"derivative_corr_{c}"], cos(np.diff(w), np.diff(t[c])))
        for a, b in ("NV", "NF", "VF"):
            assert np.isclose(three[i][f"template_corr_delta_{a}{b}"], corr[a] - corr[b]) and np.isclose(three[i][f"template_distance_ratio_{a}{b}"], dist[a] / max(dist[b], 1e-8), rtol=1e-5)
        assert np.isclose(three[i].template_F_margin_over_NV, min(corr["F"] - corr["N"], corr["F"] - corr["V"]))
        steps = np.linspace(0, 1, 20_001)
        near = np.linalg.norm(w - t["N"] - steps[:, None] * (t["V"] - t["N"]), axis=1)  # the nearest point of the segment
        assert abs(two[i].hybrid_alpha - steps[near.argmin()]) < 1e-4 and abs(two[i].hybrid_residual - near.min()) < 1e-6
        assert np.isclose(two[i].hybrid_residual_gain, min(dist["N"], dist["V"]) - near.min(), atol=1e-6) and np.isclose(two[i].hybrid_interiority, 1 - abs(2 * two[i].hybrid_alpha - 1))
        for part, name in ((slice(0, 4), "early"), (slice(4, 8), "mid"), (slice(8, 11), "late")):
            assert np.isclose(two[i][f"{name}_distance_delta"], np.linalg.norm((w - t["N"])[part]) - np.linalg.norm((w - t["V"])[part]))


def test_steps_hold_bounded_slabs(spark):
    """A batch of Arrow is up to 64 MB of samples; the filter pads each row several times over, so a step sees a slab of it."""
    from pyspark.sql import functions as F

    x = spark.range(0, 900, 1, 1).select("id", F.array_repeat(F.lit(1.0), 2560).alias("piece"))
    fn = lambda pdf: pdf[["id"]].assign(held=int(pdf["piece"].map(len).sum()))[["held"]]
    got = Wv._map_pieces(x, ["id"], fn, "held long", ()).collect()
    assert sorted(r.id for r in got) == list(range(900)) and max(r.held for r in got) <= Wv.SLAB + 2560


def test_augmentation_returns_bounded_slabs(spark):
    from pyspark.sql import functions as F

    x = spark.range(0, 3000, 1, 1).select("id", F.array_repeat(F.lit(1.0), 500).alias("w"))
    got = Wv.augment(x, ["id"], "w", "noise", 0.05, 42)
    assert got.count() == 3000 and got.filter(F.size("w") == 500).count() == 3000
    pdf = pd.DataFrame({"w": [np.zeros(500)] * 3000 + [None]})
    parts = list(Wv.slabs(iter([pdf]), "w"))
    assert sum(map(len, parts)) == 3001 and max(len(p) for p in parts) * 500 <= Wv.SLAB + 500


def test_prototypes_of_all_beats(spark):
    """300 beats of a group: without a bound the mean is that of every beat, as in the SQL of a33; with one, of 256."""
    df = spark.createDataFrame([(i, "N", 0, [1.0, float(i == 0)]) for i in range(300)], "id long, cls string, grp int, u array<double>")
    r = Tp.group_prototypes(df, "grp", "cls", "u", ["id"], k=None).collect()[0]
    assert r.n_beats == 300 and abs(r.prototype[1] / r.prototype[0] - 1 / 300) < 1e-12
    assert Tp.group_prototypes(df, "grp", "cls", "u", ["id"]).collect()[0].n_beats == 256


def test_bundle_makes_prototypes_once(spark, monkeypatch):
    """A prototype belongs to one group: five folds take theirs from one set, and the windows meet all banks in one pass."""
    from pyspark.sql import functions as F

    from pulseframe.plans import beat_dataset as BD

    rng = np.random.default_rng(1)
    rows = [(i % 2, r, i, 1000 * i, "NV"[i % 2], i % 2, *[0.0] * len(BD.FEATURES), rng.normal(size=500).tolist()) for r in range(10) for i in range(4)]
    types = ", ".join(f"{c} double" for c in BD.FEATURES)
    beats = spark.createDataFrame(rows, f"dataset long, record_id long, ann_idx long, peak long, label string, y int, {types}, waveform array<double>")
    made, passes, proto, features = [], [], Tp.group_prototypes, Tp.template_features_of
    monkeypatch.setattr(Tp, "group_prototypes", lambda *a, **k: made.append(1) or proto(*a, **k))
    monkeypatch.setattr(Tp, "template_features_of", lambda *a, **k: passes.append(1) or features(*a, **k))
    folds = beats.select("record_id").distinct().withColumn("fold", F.col("record_id") % 2)
    got = BD.candidate_bundle(BD.bundle_inputs(beats), folds, range(2))
    assert sum(made) == sum(passes) == 1 and got.count() == 80
    assert got.groupBy("record_id", "ann_idx", "dataset").count().filter("count <> 2").count() == 0 and got.select("test_fold").distinct().count() == 2
    # the bank of fold 0 is that of the records outside it
    u = BD.bundle_inputs(beats)
    bank = Tp.fit_bank(proto(u.filter("record_id % 2 = 1"), "record_id", "label", "_u", [*BD.KEYS, "ann_idx"]), "label", {"N": 2, "V": 2})
    want = {(r.record_id, r.ann_idx): r.template_corr_N for r in Tp.template_features(u, ["record_id", "ann_idx"], "_u", bank).collect()}
    assert all(abs(r.template_corr_N - want[r.record_id, r.ann_idx]) < 0.2 for r in got.filter("test_fold = 0").collect())


def test_template_features_of_odd_windows(spark):
    bank = {c: np.eye(4)[[i]] for i, c in enumerate("NVF")}
    df = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0])], "id int, u array<double>")
    got = {r.id: r for r in Tp.template_features(df, ["id"], "u", bank).collect()}
    assert got[1].template_corr_N is None and got[2].template_corr_V is None and (got[3].template_corr_N, got[3].template_corr_V) == (0.0, 1.0)


def test_beats_pass_through_python_once(spark):
    """Morphology and digest of a beat come from one pass over Arrow slabs, as from the two steps on their own; null and uneven windows too."""
    from pulseframe.plans import signal_queries as Q

    plan = Q._beats(spark, "/root/testdata/sf0.001")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan
    rng = np.random.default_rng(2)
    rows = [(i, None if i == 5 else rng.normal(size=500 if i % 7 else 40 + i).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, w array<double>").coalesce(1)
    both = {r.id: r for r in Wv.morphology_and_hash(df, "w").collect()}
    shape = {r.id: r for r in Wv.morphology(df, ["id"], "w").collect()}
    digest = {r.id: r.waveform_sha256 for r in Wv.add_waveform_hash(df, "w").collect()}
    assert len(both) == 1200 and all(both[i].waveform_sha256 == digest[i] and both[i].w == rows[i][1] for i in both)
    assert all(both[i][c] == shape[i][c] for i in both for c in K.MORPHOLOGY) and both[5].r_amplitude is None
    import hashlib
    import struct

    want = hashlib.sha256(b"waveform/v1\x00" + struct.pack("<q", 500) + np.array(rows[1][1], "<f4").tobytes()).hexdigest()
    assert digest[1] == want
