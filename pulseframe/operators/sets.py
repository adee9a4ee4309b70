"""Set operations, completeness assertions and table comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (must be empty)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def drop_conflicts(df: DataFrame, digest: str, label: str) -> tuple[DataFrame, DataFrame]:
    """U4: rows without the groups of equal content but different labels, and the excluded rows."""
    g = df.groupBy(digest).agg((F.min(label) != F.max(label)).alias("_bad")).filter("_bad").select(digest)
    return df.join(g, digest, "left_anti"), df.join(g, digest, "left_semi")


def shared(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values present on both sides (must be empty for disjoint partitions)."""
    return a.select(*cols).intersect(b.select(*cols))


def differences(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (with multiplicity) on one side only."""
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def ids_in_many(df: DataFrame, ident: str, owner: str) -> DataFrame:
    """U8: ids that belong to more than one owner."""
    x = df.select(ident, owner).distinct()
    return x.groupBy(ident).agg(F.count("*").alias("n_owners")).filter("n_owners > 1")


def coverage(catalog: DataFrame, lineage: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Catalog records without lineage or file, and lineage or files without a catalog record.

    A key and the sides it was seen on are one row from the scan on: one shuffle, no sort and no join. A key with a null is equal to none.
    """
    bits = {"catalog": 1, "lineage": 2, "files": 4}
    sides = union_all([t.select(*keys, F.lit(bits[n]).alias("_side")) for n, t in (("catalog", catalog), ("lineage", lineage), ("files", files))])
    seen = sides.groupBy(*keys).agg(F.bit_or("_side").alias("_seen"))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    on = lambda n: F.col("_seen").bitwiseAND(bits[n]) != 0
    lone = lambda have, lack, what: F.when(on(have) & (null | ~on(lack)), F.lit(what))
    problems = F.array(lone("catalog", "lineage", "missing_lineage"), lone("catalog", "files", "missing_file"), lone("lineage", "catalog", "orphan_lineage"), lone("files", "catalog", "orphan_file"))
    return seen.select(*keys, F.explode(F.array_compact(problems)).alias("problem"))


def table_mismatch(expected: DataFrame, actual: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per compared column with its mismatches, plus rows missing on either side."""
    e = expected.select(*keys, *[F.col(c).alias(f"e_{c}") for c in cols], F.lit(1).alias("_e"))
    a = actual.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a"))
    x = e.join(a, list(keys), "full")
    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    n = x.agg(
        F.count_if(F.col("_a").isNull()).alias("missing_rows"), F.count_if(F.col("_e").isNull()).alias("extra_rows"),
        *[F.count_if(both & ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}"))).alias(c) for c in cols])
    return n.unpivot([], ["missing_rows", "extra_rows", *cols], "check", "n_mismatch")


def aligned(frames: dict[str, DataFrame], on: str) -> DataFrame:
    """Several histories joined on a common step."""
    named = [f.select(on, *[F.col(c).alias(f"{n}_{c}") for c in f.columns if c != on]) for n, f in frames.items()]
    return reduce(lambda a, b: a.join(b, on), named)


def relabel(df: DataFrame, label: str, mapping: dict, name: str = "target") -> DataFrame:
    """Rows of the mapped labels with their task label; other rows are left out."""
    from ..functions.ontology import lookup

    return df.filter(F.col(label).isin(list(mapping))).withColumn(name, lookup(mapping, label))


def check(code: str, failed: Column, total: Column) -> Column:
    """One check row as a struct."""
    return F.struct(F.lit(code).alias("code"), F.when(failed > 0, "FAIL").otherwise("PASS").alias("status"), failed.cast("long").alias("count"), total.cast("long").alias("total"))
