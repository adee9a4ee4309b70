"""Bootstrap intervals. Rows are reduced to sufficient counts before any resampling."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .metrics import ratio, score_groups
from .ordering import hash_int, hash_unit, logit_bucket, stable_hash


def interval(df: DataFrame, by: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Mean and percentile bounds over replicates."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(alpha / 2)).alias("low"), F.percentile(v, F.lit(1 - alpha / 2)).alias("high"), F.count(v).alias("n_effective"))


def confusion_ci(pairs: DataFrame, by: Sequence[str], metric_fn: Callable[[np.ndarray, np.ndarray, np.ndarray], float], n_bootstrap: int = 1000, seed: int = 42) -> DataFrame:
    """Interval of any metric of (true, predicted) labels.

    Drawing n rows with replacement is drawing the pair counts from one multinomial, so a
    replicate needs only the confusion cells. `metric_fn(true, predicted, weight)`.
    """
    schema = ", ".join([f"{c} {t}" for c, t in pairs.select(*by).dtypes] + ["replicate int", "value double"])

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, *[zlib.crc32(str(k).encode()) for k in key]])
        pdf = pdf.sort_values(["t", "p"])
        n = pdf["n"].to_numpy()
        w = rng.multinomial(int(n.sum()), n / n.sum(), size=n_bootstrap)
        t, p = pdf["t"].to_numpy(), pdf["p"].to_numpy()
        out = pd.DataFrame({"replicate": np.arange(n_bootstrap, dtype="int32"), "value": [float(metric_fn(t, p, x)) for x in w]})
        for c, v in zip(by, key):
            out.insert(0, c, v)
        return out[[*by, "replicate", "value"]]

    return pairs.groupBy(*by).applyInPandas(draw, schema)


def curve_ci(df: DataFrame, cls: str = "class", p: str = "p", y: str = "y", n_bootstrap: int = 200, seed: int = 42) -> DataFrame:
    """Per-class AUROC and AP of Poisson-resampled replicates.

    Rows are first reduced to counts per distinct score. Every score bucket then yields, for
    all replicates at once, its positive and negative weight and its own part of the area;
    buckets are combined with prefix sums. No row is copied per replicate.
    """
    g = score_groups(df, [cls], p, y).withColumn("bkt", logit_bucket("score"))
    ctype = dict(df.dtypes)[cls]

    def part(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False)
        rng = np.random.default_rng([seed, int(key[1]) + 10_000, zlib.crc32(str(key[0]).encode())])
        wp = rng.poisson(pdf["pos"].to_numpy()[:, None], (len(pdf), n_bootstrap)).astype(float)
        wn = rng.poisson(pdf["neg"].to_numpy()[:, None], (len(pdf), n_bootstrap)).astype(float)
        above = np.cumsum(wp, axis=0)
        area = (wn * (above - wp / 2)).sum(axis=0)
        return pd.DataFrame({cls: key[0], "bkt": key[1], "replicate": np.arange(n_bootstrap, dtype="int32"), "wp": wp.sum(0), "wn": wn.sum(0), "area": area})

    b = g.groupBy(cls, "bkt").applyInPandas(part, f"{cls} {ctype}, bkt int, replicate int, wp double, wn double, area double")
    w = W.partitionBy(cls, "replicate").orderBy(F.desc("bkt")).rowsBetween(W.unboundedPreceding, -1)
    x = b.withColumn("_before", F.coalesce(F.sum("wp").over(w), F.lit(0.0)))
    r = x.groupBy(cls, "replicate").agg(F.sum("wp").alias("_p"), F.sum("wn").alias("_n"), F.sum(F.col("area") + F.col("wn") * F.col("_before")).alias("_a"))
    return r.filter("_p > 0 and _n > 0").select(cls, "replicate", (F.col("_a") / (F.col("_p") * F.col("_n"))).alias("auc_roc"))


def draws(replicates: DataFrame, n: Column, size: int, seed: int) -> DataFrame:
    """`size` hash-based uniform indexes in [0, n) per replicate."""
    x = replicates.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return x.withColumn("idx", hash_int(stable_hash("replicate", "draw", seed=seed)) % n)


def paired_bootstrap(deltas: DataFrame, order: Sequence[str], value: str = "delta", repetitions: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean, median, std, CI and win fraction of the deltas of a bounded experiment matrix."""
    spark = deltas.sparkSession
    cells = deltas.select(F.row_number().over(W.orderBy(*order)).alias("_i"), value)  # matrix cells: folds x seeds
    n = deltas.count()
    reps = spark.range(repetitions).select(F.col("id").alias("replicate"))
    d = draws(reps, F.lit(n), n, seed)
    means = d.join(cells, F.col("idx") == F.col("_i") - 1).groupBy("replicate").agg(F.avg(value).alias("m"))
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("ci95_low"), F.percentile("m", F.lit(0.975)).alias("ci95_high"))
    base = deltas.agg(
        F.avg(value).alias("mean_delta"), F.percentile(value, F.lit(0.5)).alias("median_delta"), F.stddev_pop(value).alias("std_delta"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("win_fraction"))
    return base.join(F.broadcast(ci))  # one row each


def poisson_weight(u: Column, top: int = 13) -> Column:
    """Poisson(1) by inversion of a uniform column; weights above `top` are rarer than one step of 32-bit uniforms."""
    acc, term, out = np.exp(-1.0), np.exp(-1.0), F.when(u < float(np.exp(-1.0)), 0)
    for k in range(1, top):
        term /= k
        acc += term
        out = out.when(u < float(acc), k)
    return out.otherwise(top)


def cluster_f1_delta(a: DataFrame, b: DataFrame, cluster: str, positive: int, repetitions: int = 200, seed: int = 42) -> DataFrame:
    """F1 difference b - a per replicate, whole clusters resampled.

    Clusters are reduced to their counts; a replicate weight is a pure function of cluster
    and replicate, and the expanded rows are summed map-side into `repetitions` groups. Both
    sides must have the same clusters: one that is on one side only (see unmatched_clusters)
    ends the job with an error.
    """
    def counts(df: DataFrame, tag: str) -> DataFrame:
        t, p = F.col("y_true") == positive, F.col("y_pred") == positive
        return df.groupBy(cluster).agg(F.count_if(t & p).alias(f"tp_{tag}"), F.count_if(~t & p).alias(f"fp_{tag}"), F.count_if(t & ~p).alias(f"fn_{tag}"))

    c = counts(a, "a").join(counts(b, "b"), cluster, "full")
    one_sided = F.col("tp_a").isNull() | F.col("tp_b").isNull()
    c = c.withColumn("tp_a", F.when(one_sided, F.raise_error(F.concat(F.lit("cluster on one side only: "), F.col(cluster).cast("string")))).otherwise(F.col("tp_a")))
    x = c.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    w = poisson_weight(hash_unit(stable_hash(cluster, "replicate", seed=seed)))
    cols = [f"{m}_{t}" for t in "ab" for m in ("tp", "fp", "fn")]
    s = x.withColumn("_w", w).groupBy("replicate").agg(*[F.sum(F.col(k) * F.col("_w")).alias(k) for k in cols])

    def f1(t: str) -> Column:
        den = F.col(f"tp_{t}") * 2 + F.col(f"fp_{t}") + F.col(f"fn_{t}")
        return ratio(F.col(f"tp_{t}") * 2, den)

    return s.select("replicate", (f1("b") - f1("a")).alias("delta"))


def unmatched_clusters(a: DataFrame, b: DataFrame, cluster: str) -> DataFrame:
    """Clusters on one side only, with the row count there."""
    n = a.groupBy(cluster).agg(F.count("*").alias("n_a")).join(b.groupBy(cluster).agg(F.count("*").alias("n_b")), cluster, "full")
    return n.filter("n_a is null or n_b is null").select(cluster, F.when(F.col("n_b").isNull(), "a").otherwise("b").alias("side"), F.coalesce("n_a", "n_b").alias("n"))
