"""Beat sequences: inter-beat (RR) features, bursts, stability; one row per beat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordering import neighbourhood, numbered, shifted, time_bucket


def number_beats(df: DataFrame, keys: Sequence[str], peak: str, bucket_width: float, tie: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """Position of each beat in its record (1-based)."""
    return numbered(df, keys, time_bucket(peak, bucket_width), [F.col(peak), *map(F.col, tie)], name)


def temporal_features(
    df: DataFrame,
    keys: Sequence[str],
    peak: str = "peak",
    fs: float = 500.0,
    bucket_width: float = 1_800_000,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Seven RR features. Looks one beat ahead; zeros at the record ends."""
    x, part, own = neighbourhood(number_beats(df, keys, peak, bucket_width, tie), keys, "idx", 4, 3)
    w = W.partitionBy(*part).orderBy("idx")
    ms = F.lit(1000.0 / fs)
    x = x.withColumn("_d", (F.lead(peak).over(w) - F.col(peak)) * ms)
    x = x.withColumn("_p", F.lag("_d").over(w)).withColumn("_dd", (F.col("_d") - F.col("_p")) * (F.col("_d") - F.col("_p")))
    near, back = w.rowsBetween(-2, 2), w.rowsBetween(-3, 0)
    x = x.select(
        "*",
        F.coalesce(F.avg("_d").over(near), F.lit(0.0)).alias("rr_local_mean"),
        F.coalesce(F.stddev_pop("_d").over(near), F.lit(0.0)).alias("rr_local_std"),
        F.coalesce(F.sqrt(F.avg("_dd").over(back)), F.lit(0.0)).alias("rmssd"),
    ).filter(own)
    prev, nxt = F.coalesce("_p", F.lit(0.0)), F.coalesce("_d", F.lit(0.0))
    return (
        x.withColumn("rr_prev", prev)
        .withColumn("rr_next", nxt)
        .withColumn("rr_ratio", F.when(nxt > 0, prev / nxt).otherwise(1.0))
        .withColumn("heart_rate", F.when(prev > 0, F.lit(60000.0) / prev).otherwise(0.0))
        .drop("_blk", "_d", "_p", "_dd")
    )


def _median4(sorted_array: Column) -> Column:
    return (F.element_at(sorted_array, 2) + F.element_at(sorted_array, 3)) / 2.0


CAUSAL_FEATURES = [
    "rr_prev_1", "rr_prev_2", "rr_prev_3", "rr_prev_4", "rr_prev_mean_4", "rr_prev_std_4", "rr_prev_cv_4",
    "rr_prev_median_4", "rr_prev_mad_4", "rr_current_over_median_4", "rr_delta_1", "rr_delta_2", "rr_acceleration",
    "rr_rmssd_4", "rr_pnn50_4", "tachycardia_flag", "bradycardia_flag",
]


def causal_expressions(rr: Sequence[Column]) -> dict[str, Column]:
    """Prior-only features from four lagged intervals in ms (newest first)."""
    r1, r2, r3, r4 = rr
    full = F.lit(True)
    for r in rr:
        full = full & r.isNotNull()
    mean = (r1 + r2 + r3 + r4) / 4.0
    var = sum(((r - mean) * (r - mean) for r in rr), F.lit(0.0)) / 4.0
    med = _median4(F.array_sort(F.array(*rr)))
    mad = _median4(F.array_sort(F.array(*[F.abs(r - med) for r in rr])))
    diffs = [r2 - r1, r3 - r2, r4 - r3]
    eps = F.lit(1.0e-8)

    def when_full(c: Column) -> Column:
        return F.when(full, c)

    return {
        "rr_prev_1": r1,
        "rr_prev_2": r2,
        "rr_prev_3": r3,
        "rr_prev_4": r4,
        "rr_prev_mean_4": when_full(mean),
        "rr_prev_std_4": when_full(F.sqrt(var)),
        "rr_prev_cv_4": when_full(F.sqrt(var) / F.greatest(mean, eps)),
        "rr_prev_median_4": when_full(med),
        "rr_prev_mad_4": when_full(mad),
        "rr_current_over_median_4": when_full(r1 / F.greatest(med, eps)),
        "rr_delta_1": r1 - r2,
        "rr_delta_2": r2 - r3,
        "rr_acceleration": r1 - r2 * 2.0 + r3,
        "rr_rmssd_4": when_full(F.sqrt(sum((d * d for d in diffs), F.lit(0.0)) / 3.0)),
        "rr_pnn50_4": when_full(sum((F.when(F.abs(d) > 50.0, 1.0).otherwise(0.0) for d in diffs), F.lit(0.0)) / 3.0),
        "tachycardia_flag": F.when(r1 < 600.0, 1.0).when(r1.isNotNull(), 0.0),
        "bradycardia_flag": F.when(r1 > 1000.0, 1.0).when(r1.isNotNull(), 0.0),
    }


def causal_features(
    df: DataFrame,
    keys: Sequence[str],
    peak: str = "peak",
    fs: float = 500.0,
    bucket_width: float = 1_800_000,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Seventeen features of the four previous intervals; null until four exist."""
    order = [F.col(peak), *map(F.col, tie)]
    lags = {f"_l{k}": (peak, k) for k in range(1, 5)}
    x = shifted(df, keys, time_bucket(peak, bucket_width), order, lags, index="idx")
    points = [F.col(peak), *[F.col(f"_l{k}") for k in range(1, 5)]]
    rr = [(points[k] - points[k + 1]) * F.lit(1000.0 / fs) for k in range(4)]
    return x.select("*", *[e.alias(n) for n, e in causal_expressions(rr).items()]).drop(*lags)


def restore_targets(features: DataFrame, targets: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Features for the target keys, and the targets that have none (must be empty)."""
    return targets.join(features, list(keys), "inner"), targets.join(features, list(keys), "left_anti")


def bursts(df: DataFrame, keys: Sequence[str], idx: str = "beat_idx", block: int = 4096) -> DataFrame:
    """Per record, number of rows, of runs of consecutive indices and their mean length."""
    x = shifted(df, keys, F.floor(F.col(idx) / block), [F.col(idx)], {"_prev": (idx, 1)})
    start = F.when(F.col("_prev").isNull() | (F.col(idx) - F.col("_prev") > 1), 1).otherwise(0)
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(start).alias("n_bursts")).withColumn(
        "mean_burst_len", F.col("n") / F.greatest(F.col("n_bursts"), F.lit(1))
    )


def stability(
    df: DataFrame,
    keys: Sequence[str],
    rr: str,
    index: str,
    threshold_ms: float,
    threshold_ratio: float,
    window: int = 5,
    min_beats: int = 3,
) -> DataFrame:
    """ST2, batch form: skip flag from the last `window` intervals of a numbered sequence."""
    x, part, own = neighbourhood(df, keys, index, window - 1, 0)
    ring = F.collect_list(rr).over(W.partitionBy(*part).orderBy(index).rowsBetween(-(window - 1), 0))
    x = x.withColumn("_ring", ring).filter(own)
    n = F.size("_ring")
    mean = F.aggregate("_ring", F.lit(0.0), lambda a, v: a + v) / n
    x = x.withColumn("ring_mean", mean)
    dev = F.aggregate("_ring", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v - F.col("ring_mean"))))
    x = x.withColumn("max_dev", dev)
    skip = (n >= min_beats) & (F.col("ring_mean") > 0) & (F.col("max_dev") <= threshold_ms) & (
        F.col("max_dev") / F.col("ring_mean") <= threshold_ratio
    )
    return x.withColumn("skip", F.coalesce(skip, F.lit(False))).drop("_ring", "_blk")
