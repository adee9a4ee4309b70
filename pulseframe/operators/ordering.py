"""Order-dependent building blocks that never hold one key's rows in a single task.

A plain window over a key sends every row of that key to one task.  Here the key is
first cut into ordered buckets by a deterministic, monotone expression; bucket totals
(small after map-side combine) are prefix-summed, and the rows are only windowed
inside their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Rows per block once a sequence has been numbered.
BLOCK = 4096


def stable_hash(*cols: str | Column, seed: int = 0) -> Column:
    """Hex digest that orders rows pseudo-randomly and identically on every engine."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_int(h: Column, start: int = 1, digits: int = 8) -> Column:
    """Integer from a slice of a hex digest."""
    return F.conv(F.substring(h, start, digits), 16, 10).cast("long")


def hash_bucket(h: Column) -> Column:
    """First 12 bits of the digest: 4096 equal ordered buckets."""
    return hash_int(h, 1, 3)


def hash_unit(h: Column, start: int = 1) -> Column:
    """Uniform in [0, 1) from 32 bits of the digest."""
    return hash_int(h, start, 8) / F.lit(4294967296.0)


def _offset_table(df: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    totals = df.groupBy(*keys, "_bkt").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    w = W.partitionBy(*keys).orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bkt").alias("_k_bkt"),
        *[F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums per key in `order`.

    `bucket` must be monotone in `order`; keys and bucket must not be null.
    """
    d = df.withColumn("_bkt", bucket)
    off = _offset_table(d, keys, sums)
    cond = F.col("_bkt") == F.col("_k_bkt")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    w = W.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # the join and the window share the partitioning (keys, bucket): one shuffle of the rows
    out = d.join(off, cond, "left")
    for n, e in sums.items():
        out = out.withColumn(n, F.sum(e).over(w) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
    drop = ["_bkt", "_k_bkt", *[f"_k_{k}" for k in keys], *[f"_o_{n}" for n in sums]]
    return out.drop(*drop)


def numbered(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """1-based row number per key, exact, with the key spread over its buckets."""
    return running(df, keys, bucket, order, {name: F.lit(1)})


def time_bucket(col: str | Column, width: int | float) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width)).cast("long")


def neighbourhood(
    df: DataFrame, keys: Sequence[str], index: str, before: int, after: int, block: int = BLOCK
) -> tuple[DataFrame, Sequence[str], Column]:
    """Copy each row to the blocks whose rows can see it.

    Returns the expanded frame, the partition columns for frame windows of up to `before`
    preceding and `after` following rows, and the predicate that keeps each row's own copy.
    At most (before + after) rows per block are duplicated.
    """
    i = F.col(index)
    lo = F.floor((i - F.lit(after)) / F.lit(block))
    hi = F.floor((i + F.lit(before)) / F.lit(block))
    own = F.floor(i / F.lit(block))
    out = df.withColumn("_blk", F.explode(F.sequence(lo, hi)))
    return out, [*keys, "_blk"], F.col("_blk") == own


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    shifts: dict[str, tuple[str, int]],
    index: str = "_i",
) -> DataFrame:
    """lag (offset > 0) and lead (offset < 0) columns over a key of any size."""
    before = max([k for _, k in shifts.values() if k > 0], default=0)
    after = max([-k for _, k in shifts.values() if k < 0], default=0)
    n = numbered(df, keys, bucket, order, index)
    x, part, own = neighbourhood(n, keys, index, before, after)
    w = W.partitionBy(*part).orderBy(index)
    for name, (col, k) in shifts.items():
        x = x.withColumn(name, F.lag(col, k).over(w) if k > 0 else F.lead(col, -k).over(w))
    out = x.filter(own).drop("_blk")
    return out.drop(index) if index == "_i" else out


def logit_bucket(p: str | Column) -> Column:
    """Monotone bucket of a probability, fine near both ends (about 5000 buckets)."""
    c = F.col(p) if isinstance(p, str) else p
    c = c.cast("double")
    z = F.when(c <= 0, F.lit(-40.0)).when(c >= 1, F.lit(40.0)).otherwise(F.log(c / (F.lit(1.0) - c)))
    return F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)) * 64).cast("int")


def group_size_bucket(n: str | Column) -> Column:
    """Monotone decreasing bucket for ordering counts from large to small."""
    c = F.col(n) if isinstance(n, str) else n
    return -F.floor(F.log2(c.cast("double") + 1) * 64).cast("int")


def numeric_bucket(value: str | Column) -> Column:
    """Monotone bucket of any finite number, linear near zero and logarithmic far from it."""
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    mag = F.floor(F.log2(F.abs(c) * 1e6 + 1) * 64).cast("int")
    return F.when(c >= 0, mag).otherwise(-mag - 1)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their half-open range of 0-based ranks [lo, hi) and the group size n."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    x = running(g, keys, numeric_bucket("_v"), [F.col("_v")], {"_hi": F.col("_c")}).withColumn("_lo", F.col("_hi") - F.col("_c"))
    n = g.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    return x.join(n, list(keys)) if keys else x.join(F.broadcast(n))  # one row without keys


def percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per group, from ranks instead of one sorted list."""
    x = value_ranks(df, keys, value)
    aggs = []
    for i, q in enumerate(qs.values()):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        for tag, at in (("f", F.floor(pos)), ("c", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("_lo") <= at) & (at < F.col("_hi")), F.col("_v"))).alias(f"_{tag}{i}"))
    y = x.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    out = []
    for i, (name, q) in enumerate(qs.items()):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        out.append((F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * (pos - F.floor(pos))).alias(name))
    return y.select(*keys, *out)


def quantile_grid(df: DataFrame, keys: Sequence[str], value: str, parts: int) -> DataFrame:
    """Rows (keys, step, quantile) for step = 0..parts, exact and interpolated."""
    x = value_ranks(df, keys, value)
    scale = (F.col("_n") - 1) / F.lit(float(parts))
    pos = F.col("_j") * (F.col("_n") - 1) / F.lit(float(parts))
    # steps whose floor or ceiling position can fall on this value
    first = F.greatest(F.lit(0), F.floor(F.when(scale > 0, (F.col("_lo") - 1) / scale).otherwise(0)))
    last = F.least(F.lit(parts), F.ceil(F.when(scale > 0, F.col("_hi") / scale).otherwise(parts)))
    x = x.filter(first <= last).withColumn("_j", F.explode(F.sequence(first, last)))
    hit = [F.max(F.when((F.col("_lo") <= at) & (at < F.col("_hi")), F.col("_v"))) for at in (F.floor(pos), F.ceil(pos))]
    frac = F.max(pos - F.floor(pos))
    y = x.groupBy(*keys, "_j").agg((hit[0] + (hit[1] - hit[0]) * frac).alias("quantile"))
    return y.withColumnRenamed("_j", "step")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt: str | Column, name: str = "rank", salts: int = 64) -> DataFrame:
    """First k rows per key with their rank; a large key is first cut down in `salts` parts."""
    c = F.col(salt) if isinstance(salt, str) else salt
    x = df.withColumn("_s", F.pmod(F.xxhash64(c), F.lit(salts)))
    x = x.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))).filter(F.col("_r") <= k)
    x = x.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return x.drop("_s", "_r")
