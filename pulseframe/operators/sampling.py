"""Deterministic sampling, balancing and augmentation of labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from .ordering import hash_bucket, hash_int, hash_unit, numbered, stable_hash


def hash_ranked(df: DataFrame, keys: Sequence[str], ident: Sequence[str], seed: int, name: str = "rn") -> DataFrame:
    """Random but reproducible rank per key; a key of any size is spread over hash buckets."""
    x = df.withColumn("_h", stable_hash(*ident, seed=seed))
    return numbered(x, keys, hash_bucket(F.col("_h")), [F.col("_h"), *map(F.col, ident)], name).drop("_h")


def is_even_position(i: Column, n: Column, k: int, rounded: bool = False) -> Column:
    """H7: is 0-based position i one of k evenly spaced positions of n (truncated or rounded)."""
    if k == 1:
        return i == 0
    step = (n - 1) / F.lit(float(k - 1))
    guess = F.floor(i / step).cast("long")
    snap = (lambda c: F.rint(c)) if rounded else (lambda c: F.floor(c))
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        j = guess + d
        hit = hit | ((j >= 0) & (j <= k - 1) & (snap(j * (n - 1) / F.lit(float(k - 1))).cast("long") == i))
    return F.when(n <= k, F.lit(True)).otherwise(hit)


def even_sample(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], k: int, must: Column | None = None, rounded: bool = False) -> DataFrame:
    """H7: k evenly spaced rows per key, plus the rows that must be included."""
    x = numbered(df, keys, bucket, order, "_rn")
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    x = x.join(n, list(keys)) if keys else x.join(F.broadcast(n))  # one row without keys
    hit = is_even_position(F.col("_rn") - 1, F.col("_n"), k, rounded)
    return x.filter(hit if must is None else hit | must).drop("_rn", "_n")


def quotas(counts: DataFrame, cls: str, n: str, size: int) -> DataFrame:
    """H8: at least one per class, the rest in proportion, by largest remainder (few classes)."""
    from pyspark.sql import Window as W

    tot = counts.agg(F.sum(n).alias("_t"), F.count("*").alias("_c"))
    x = counts.join(F.broadcast(tot))  # one row
    free = F.lit(size) - F.col("_c")
    exact = F.col(n) * free / F.col("_t")
    x = x.withColumn("_b", F.floor(exact)).withColumn("_r", F.round(exact - F.floor(exact), 12))
    left = F.lit(size) - F.col("_c") - F.sum("_b").over(W.partitionBy(F.lit(1)))
    x = x.withColumn("_left", left).withColumn("_k", F.row_number().over(W.orderBy(F.desc("_r"), F.col(cls))))
    q = F.col("_b") + 1 + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0)
    return x.select(cls, F.least(q, F.col(n)).alias("quota"))


def stratified_sample(df: DataFrame, cls: str, ident: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """H8."""
    q = quotas(df.groupBy(cls).agg(F.count("*").alias("_n")), cls, "_n", size)
    return hash_ranked(df, [cls], ident, seed).join(F.broadcast(q), cls).filter("rn <= quota").drop("rn", "quota")  # one row per class


def balanced_subset(df: DataFrame, cls: str, ident: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """H9: at most n rows per class."""
    return hash_ranked(df, [cls], ident, seed).filter(F.col("rn") <= n).drop("rn")


def _replicate(df: DataFrame, copies: Column) -> DataFrame:
    """Rows repeated; copy 0 is the original."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))


def oversample(df: DataFrame, cls: str, ident: Sequence[str], target: DataFrame, seed: int = 42) -> DataFrame:
    """Repeat rows of each class up to its target count (cls, target)."""
    n = df.groupBy(cls).agg(F.count("*").alias("_n")).join(target, cls, "left")
    n = n.withColumn("_goal", F.greatest(F.col("_n"), F.coalesce("target", F.col("_n")))).select(cls, "_n", "_goal")
    x = hash_ranked(df, [cls], ident, seed).join(F.broadcast(n), cls)  # one row per class
    copies = F.floor(F.col("_goal") / F.col("_n")) + F.when(F.col("rn") <= F.col("_goal") % F.col("_n"), 1).otherwise(0)
    return _replicate(x, copies).drop("rn", "_n", "_goal")


def to_largest(df: DataFrame, cls: str) -> DataFrame:
    """Target of H10: every class as large as the largest."""
    n = df.groupBy(cls).agg(F.count("*").alias("_n"))
    top = n.agg(F.max("_n").alias("target"))
    return n.select(cls).join(F.broadcast(top))  # one row


def to_share(df: DataFrame, cls: str, value, share: float = 0.125) -> DataFrame:
    """Target of H10: one class raised to a share of all rows."""
    a = df.agg(F.count_if(F.col(cls) != F.lit(value)).alias("_o"))
    return a.select(F.lit(value).alias(cls), F.ceil(F.col("_o") * share / (1 - share)).alias("target"))


def group_weights(df: DataFrame, cls: str, group: str, power: float) -> DataFrame:
    """Weight of each group inside its class: 0 uniform over groups, 0.5 square root of size."""
    return df.groupBy(cls, group).agg(F.count("*").alias("_n")).withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(power)))


def group_weighted_draws(df: DataFrame, cls: str, group: str, ident: Sequence[str], power: float = 0.0, total: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """With replacement per class, groups drawn by weight, rows uniformly inside the group.

    The class total is split over its groups by weight; each group's share is dealt to its
    rows as full rounds plus a hashed remainder, so the counts are exact without a draw loop.
    """
    w = group_weights(df, cls, group, power)
    s = w.groupBy(cls).agg(F.sum("_w").alias("_sw"), F.sum("_n").alias("_cn"))
    if total is not None:
        s = s.join(total, cls).withColumn("_cn", F.col("target"))
    q = w.join(s, cls).withColumn("_q", F.floor(F.col("_cn") * F.col("_w") / F.col("_sw") + hash_unit(stable_hash(cls, group, seed=seed)))).select(cls, group, "_n", "_q")
    x = hash_ranked(df, [cls, group], ident, seed + 1).join(q, [cls, group])
    copies = F.floor(F.col("_q") / F.col("_n")) + F.when(F.col("rn") <= F.col("_q") % F.col("_n"), 1).otherwise(0)
    return _replicate(x.withColumn("_c", copies).filter("_c > 0"), F.col("_c")).drop("rn", "_n", "_q", "_c")


def capped_draws(df: DataFrame, cls: str, value, group: str, ident: Sequence[str], target: int, cap_share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """One class raised to `target` rows, no group giving more than a share; contributions per group."""
    c = df.filter(F.col(cls) == F.lit(value))
    n = c.groupBy(group).agg(F.count("*").alias("_n"))
    tot = n.agg(F.sum("_n").alias("_t"))
    cap = int(target * cap_share)
    q = n.join(F.broadcast(tot)).withColumn("quota", F.least(F.lit(cap), F.floor(F.lit(float(target)) * F.col("_n") / F.col("_t")).cast("int")))  # one row
    q = q.select(group, "_n", F.greatest(F.lit(1), F.col("quota")).alias("quota"))
    x = hash_ranked(c, [group], ident, seed).join(q, group)
    copies = F.floor(F.col("quota") / F.col("_n")) + F.when(F.col("rn") <= F.col("quota") % F.col("_n"), 1).otherwise(0)
    out = _replicate(x.withColumn("_c", copies).filter("_c > 0"), F.col("_c")).drop("rn", "_n", "quota", "_c")
    return df.filter(F.col(cls) != F.lit(value)).withColumn("copy", F.lit(0).cast("long")).unionByName(out), q.select(group, F.col("_n").alias("n_source"), "quota")


def bootstrap_noise(df: DataFrame, group: str, ident: Sequence[str], samples: str, minimum: int, sigma: float, seed: int = 42) -> DataFrame:
    """Groups below a minimum are repeated, the copies with Gaussian noise."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    x = hash_ranked(df, [group], ident, seed).join(n, group)
    goal = F.greatest(F.lit(minimum), F.col("_n"))
    copies = F.floor(goal / F.col("_n")) + F.when(F.col("rn") <= goal % F.col("_n"), 1).otherwise(0)
    x = _replicate(x, copies).drop("rn", "_n")
    return x.withColumn(samples, F.when(F.col("copy") == 0, F.col(samples)).otherwise(gaussian(F.col(samples), stable_hash(*ident, "copy", seed=seed), sigma)))


def gaussian(x: Column, h: Column, sigma: float) -> Column:
    """Array plus noise that depends only on the hash (Box-Muller on hashed uniforms)."""
    def noisy(v: Column, i: Column, h: Column) -> Column:
        u1 = F.greatest(F.lit(1e-12), (F.pmod(F.xxhash64(h, i), F.lit(1 << 30)) + 0.5) / float(1 << 30))
        u2 = F.pmod(F.xxhash64(i, h, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
        return v + F.lit(sigma) * F.sqrt(F.log(u1) * -2.0) * F.cos(u2 * (2 * np.pi))

    return let(h, lambda k: F.transform(x, lambda v, i: noisy(v, i, k)))


def neighbour_pairs(df: DataFrame, ident: str, vec: str, k: int, where: Column | None = None, queries: Column | None = None) -> DataFrame:
    """The k nearest rows of every row, or of those in `queries`, by Euclidean distance (qid, id, dist, rank), self excluded. Ties go to the smaller id."""
    from .neighbours import nearest_rows
    from .ordering import top_k
    from .search import CHUNK_BLOCK, QUERY_BLOCK

    rows = lambda to, c: (df if c is None else df.filter(c)).select(F.col(ident).alias(to), F.col(vec).alias("v"))
    hits = nearest_rows(rows("qid", where if queries is None else queries), rows("id", where), k, (QUERY_BLOCK, CHUNK_BLOCK), euclidean=True)
    return top_k(hits.select("qid", "id", F.abs("score").alias("dist")), ["qid"], [F.col("dist"), F.col("id")], k, "id")


def smote(df: DataFrame, cls: str, ident: str, vec: str, value, n_new: int, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows of one class between a row and one of its k nearest neighbours."""
    c = df.filter(F.col(cls) == F.lit(value)).select(ident, F.col(vec).alias("_v"))
    n = c.count()
    base = hash_ranked(c, [], [ident], seed)
    per = F.lit(n_new // max(n, 1)) + F.when(F.col("rn") <= n_new % max(n, 1), 1).otherwise(0)
    b = base.withColumn("_c", per).filter("_c > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("int"), F.col("_c").cast("int")))).drop("rn", "_c")
    b = b.withColumn("_h", stable_hash(ident, "copy", seed=seed)).withColumn("rank", (hash_int(F.col("_h")) % F.lit(min(k, max(n - 1, 1))) + 1).cast("int"))
    nn = neighbour_pairs(df, ident, vec, k, F.col(cls) == F.lit(value)).select(F.col("qid").alias(ident), "rank", F.col("id").alias("_nid"))
    x = b.join(nn, [ident, "rank"]).join(c.select(F.col(ident).alias("_nid"), F.col("_v").alias("_nv")), "_nid")
    u = hash_unit(F.col("_h"), 9)
    return x.select(ident, "copy", F.lit(value).alias(cls), let(u, lambda t: F.zip_with("_v", "_nv", lambda a, q: a.cast("double") + (q.cast("double") - a.cast("double")) * t)).alias(vec))


def adasyn_quota(df: DataFrame, cls: str, ident: str, vec: str, value, n_new: int, k: int = 5) -> DataFrame:
    """H13 (ADASYN): new rows per minority row, in proportion to its neighbours of other classes."""
    lab = df.select(F.col(ident).alias("id"), F.col(cls).alias("_l"))
    nn = neighbour_pairs(df, ident, vec, k, queries=F.col(cls) == F.lit(value)).join(lab, "id")
    hard = nn.groupBy("qid").agg(F.avg(F.when(F.col("_l") == F.lit(value), 0.0).otherwise(1.0)).alias("r"))
    own = df.filter(F.col(cls) == F.lit(value)).select(F.col(ident).alias("qid"))
    h = own.join(hard, "qid")
    tot = h.agg(F.sum("r").alias("_t"))
    return h.join(F.broadcast(tot)).select(F.col("qid").alias(ident), "r", F.when(F.col("_t") > 0, F.rint(F.col("r") / F.col("_t") * n_new)).otherwise(0).cast("long").alias("n_new"))  # one row


def sampling_manifest(before: DataFrame, after: DataFrame, cls: str, ident: Sequence[str]) -> DataFrame:
    """Counts before and after, synthetic rows, and rows whose source lies outside the partition."""
    b = before.groupBy(cls).agg(F.count("*").alias("n_before"))
    a = after.groupBy(cls).agg(F.count("*").alias("n_after"), F.count_if(F.col("copy") > 0).alias("n_synthetic"))
    out = after.join(before.select(*ident), list(ident), "left_anti").groupBy(cls).agg(F.count("*").alias("n_foreign"))
    x = b.join(a, cls, "full").join(out, cls, "left")
    return x.fillna(0, ["n_before", "n_after", "n_synthetic", "n_foreign"])


