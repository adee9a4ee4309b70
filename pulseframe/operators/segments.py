"""Cutting signals into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fixed_grid(df: DataFrame, length: str, step: int) -> DataFrame:
    """One row per complete, non-overlapping window of `step` samples."""
    full = F.floor(F.col(length) / F.lit(step)).cast("long")
    x = df.filter(full >= 1).withColumn("episode_idx", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)))
    return x.withColumn("start", F.col("episode_idx") * F.lit(step)).withColumn("end", F.col("start") + F.lit(step))


def cut_fixed(df: DataFrame, samples: str, step: int, name: str = "window") -> DataFrame:
    """Fixed windows with their samples; windows holding NaN or infinite values are skipped."""
    g = fixed_grid(df.withColumn("_n", F.size(samples)), "_n", step).drop("_n")
    w = F.slice(F.col(samples), (F.col("start") + 1).cast("int"), F.lit(step))
    bad = F.exists(name, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return g.withColumn(name, w).filter(~bad)
