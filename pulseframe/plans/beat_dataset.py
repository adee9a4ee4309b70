"""Beat training set: annotations and signals to windows with features, ids and hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import ontology as O
from ..operators import sequences as S, waveforms as Wv
from ..session import pinned

KEYS = ["dataset", "record_id"]


def annotate(annotations: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled in-range beats on the target clock, and rejected records."""
    kept, _ = O.map_symbols(annotations)
    kept = kept.withColumn("peak", O.rescale_clock("native_sample", "fs_native")).withColumn("label", O.short_class("canonical"))
    size = signals.select(*KEYS, F.size("samples").alias("sig_len"))
    return O.range_guard(kept.join(size, KEYS), KEYS, "peak", "sig_len")


def build_beats(annotations: DataFrame, signals: DataFrame, bucket_width: float = 500 * 1800) -> tuple[DataFrame, DataFrame]:
    """One row per beat with window, temporal and morphology features, ids and label code."""
    good, bad = annotate(annotations, signals)
    # temporal features see every in-range beat, also those whose window is dropped later
    t = S.temporal_features(good, KEYS, "peak", Wv.TARGET_FS, bucket_width, ["ann_idx"])
    # the first beat has no previous interval and uses the first one; a single beat uses 1000 ms
    first = F.when(F.col("rr_next") > 0, F.col("rr_next")).otherwise(1000.0)
    t = t.withColumn("rr_for_window", F.when(F.col("idx") == 1, first).otherwise(F.col("rr_prev")))
    w = Wv.segment_beats(t, signals, KEYS, "samples")
    # all columns ride along, so the windows are built once and not joined back
    x = Wv.with_sentinels(Wv.morphology_and_hash(w, "waveform"))
    return x.select(
        "*",
        F.concat_ws(":", F.col("dataset").cast("string"), F.col("record_id").cast("string"), F.lit("beat"), F.col("ann_idx").cast("string"), F.lit("target"), F.col("peak").cast("string")).alias("sample_id"),
        O.lookup(O.CLASS_CODE, "label").alias("y"),
    ).drop("sig_len", "idx", "rr_for_window"), bad


FEATURES = [
    "rr_prev", "rr_next", "rr_ratio", "rr_local_mean", "rr_local_std", "rmssd", "heart_rate", "r_amplitude", "q_depth", "t_amplitude", "qrs_width_ms", "qrs_area",
    "st_slope_mV_s", "qrs_asymmetry_index", "t_r_ratio", "qrs_raggedness",
]


def feature_vector(beats: DataFrame, keep: list[str]) -> DataFrame:
    """The sixteen model inputs in their fixed order."""
    return beats.select(*keep, *FEATURES)


def manifest(beats: DataFrame) -> DataFrame:
    """A2: beats per dataset and class with zero fill, and the global row (dataset null)."""
    one = [F.count_if(F.col("label") == c).alias(f"n_{c}") for c in O.CLASS_CODE]
    return beats.rollup("dataset").agg(F.count("*").alias("n_beats"), F.countDistinct("record_id").alias("n_records"), *one)


def bundle_inputs(beats: DataFrame) -> DataFrame:
    """What G14 needs of the beats: keys, peak, labels, base features and the unit window `_u` instead of the waveform."""
    from ..operators import templates as Tp

    return Tp.unit_window(beats, "waveform", 60, 90).select(*KEYS, "ann_idx", "peak", "label", "y", *FEATURES, "_u")


def candidate_bundle(beats: DataFrame, folds: DataFrame, test_folds: Sequence[int], group: str = "record_id", templates: dict[str, int] | None = None) -> DataFrame:
    """Base features, causal intervals and templates, one bundle of all beats per test fold.

    `beats` come from `bundle_inputs`, pinned. The templates of a bundle are fitted on the groups outside its test fold; the
    rest is the same in all. A prototype belongs to one group, so prototypes are made once and every fold takes its own;
    the features against the banks of all folds come from one pass over the windows.
    """
    from ..operators import templates as Tp

    counts, keys = templates or {"N": 2, "V": 2}, [*KEYS, "ann_idx"]
    proto = pinned(Tp.group_prototypes(beats.filter(F.col("label").isin(list(counts))), group, "label", "_u", keys))
    folds, banks = pinned(folds), {}
    for fold in test_folds:
        test = folds.filter(F.col("fold") == fold).select(group)
        train = proto.join(test, group, "left_anti")
        leaked = Tp.check_sources(train.select(group), test, group)
        if not leaked.isEmpty():
            raise ValueError("held-out group reached template fitting")
        banks[fold] = Tp.fit_bank(train, "label", counts)
    rr = S.causal_features(beats.select(*keys, "peak"), KEYS, "peak", Wv.TARGET_FS, 500 * 1800, ["ann_idx"]).drop("peak", "idx")
    base = [*keys, "label", "y", *FEATURES]
    t = Tp.template_features_of(beats, base, "_u", banks, "test_fold")
    x = t.join(rr, keys)
    return x.select(*base, *[c for c in rr.columns if c not in keys], *[c for c in t.columns if c not in base and c != "test_fold"], "test_fold")
