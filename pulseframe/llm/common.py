"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import pinned

__all__ = ["pinned", "table", "crc_mod", "hash_unit", "map_batches", "components", "clean_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key written as text, modulo n."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % n


def hash_unit(*cols: str, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def clean_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet."""
    name = base
    while name in df.columns:
        name += "_"
    return name


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def tidy() -> None:
    """Give memory that is free by now back to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


_CACHES: dict[str, Callable[[], None]] = {}  # of this Python worker: name of a step and what drops its cache


def worker_cache(name: str):
    """One value per worker, kept between the tasks of the step `name`; tasks of other steps drop it."""
    def deco(make):
        cached = lru_cache(maxsize=1)(make)
        _CACHES[name] = cached.cache_clear
        return cached

    return deco


def release(keeps: str = "") -> None:
    """Drop what other steps keep in this worker."""
    for name, drop in _CACHES.items():
        if name != keeps:
            drop()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str = "") -> DataFrame:
    """mapInArrow that leaves no free memory behind in the worker, nor a cache but that of the step `keeps`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        yield from fn(batches)
        tidy()

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (id, component), component the smallest id.

    Alternating large-star and small-star steps: every round is two group minima and joins over
    edges only, written to the shared folder. A vertex with very many edges is aggregated on the
    map side, and the join back to its edges may be split by adaptive execution. Self edges and
    repeated edges do no harm; a null end drops the edge. No rows give no rows.
    """
    cur = pinned(edges.selectExpr("a as u", "b as v").filter("u is not null and v is not null and u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())
    first = cur
    seen = None
    for _ in range(rounds):
        both = cur.union(cur.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").selectExpr("v as u", "m as v")
        large = large.filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").selectExpr("v as u", "m as v").filter("u <> v").union(small_low.selectExpr("u", "m as v"))
        cur = pinned(small.selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = first.select(F.col("v").alias("id")).union(first.select(F.col("u").alias("id"))).distinct()
    return ends.join(cur.selectExpr("u as id", "v as component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def bounded_sample(rows: DataFrame, label: str, key: str, per_class: int, distinct: bool = False) -> DataFrame:
    """About `per_class` rows of each label, chosen by a hash of `key`; all rows of a label that has fewer. Every label counts.

    The number of rows per label is counted first, so the sample of a label does not grow with the input. Rows with
    the same key come in together or not at all; with `distinct` they count as one and come in once.
    """
    n = F.approx_count_distinct(key, 0.02) if distinct else F.count("*")
    counts = pinned(rows.groupBy(F.col(label).alias("_label")).agg((F.lit(float(per_class)) / F.greatest(n, F.lit(1))).alias("_share")))
    shares = F.broadcast(counts) if counts.count() <= 100_000 else counts
    chosen = rows.join(shares, F.col(label).eqNullSafe(F.col("_label"))).filter(hash_unit(key) < F.col("_share")).drop("_label", "_share")
    return chosen.dropDuplicates([label, key]) if distinct else chosen  # reduced on the map side


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows; a part is cut short when it exceeds `size` bytes."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n //= 2
            yield b.slice(at, n)
            at += n


def filter_rows(df: DataFrame, column: str, keep: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Rows for which the worker-side function of the column's values says true; all columns as they were, no shuffle."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = keep()
        for b in slices(batches):
            yield b.filter(pa.array(test(b.column(at).to_pylist()), pa.bool_()))

    return map_batches(df, run, df.schema)


# Ids to drop (a few dozen bytes each) are broadcast up to this many, joined by a shuffle beyond.
BROADCAST_IDS = 4_000_000


def without(df: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """Rows of df without a match in `gone`, which is broadcast only when a count shows that it is small."""
    gone = pinned(gone)
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, on, "left_anti")
