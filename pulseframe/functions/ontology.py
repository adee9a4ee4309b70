"""Fixed label maps and the columns that apply them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

# Beat symbol -> canonical class.
BEAT_CLASS = {
    "N": "N", "L": "N", "R": "N", "e": "N", "j": "N",
    "A": "S", "a": "S", "J": "S", "S": "S",
    "V": "V", "E": "V",
    "F": "FUSION",
    "/": "Q_OR_UNKNOWN", "f": "Q_OR_UNKNOWN", "Q": "Q_OR_UNKNOWN",
}
# Symbols that never make a beat.
EXCLUDED_SYMBOLS = ["~", "+", "x", "|"]
# Canonical class -> short class, and the integer code of the short class.
SHORT_CLASS = {"N": "N", "S": "S", "V": "V", "FUSION": "F", "Q_OR_UNKNOWN": "Q"}
CLASS_CODE = {"N": 0, "S": 1, "V": 2, "F": 3, "Q": 4}
# Rhythm mark -> rhythm class; anything else is OTHER_RHYTHM.
RHYTHM_CLASS = {"N": "SINUS", "AFIB": "AFIB", "AFL": "AFL", "J": "JUNCTIONAL"}


def lookup(mapping: dict, key: str | Column) -> Column:
    """Literal map lookup; null for an unknown key."""
    c = F.col(key) if isinstance(key, str) else key
    return F.try_element_at(F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())]), c)


def canonical_class(symbol: str | Column) -> Column:
    return lookup(BEAT_CLASS, symbol)


def short_class(canonical: str | Column) -> Column:
    return lookup(SHORT_CLASS, canonical)


def map_symbols(df: DataFrame, symbol: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """Kept rows with their class, and per-symbol statistics of all rows."""
    kept = df.withColumn("canonical", canonical_class(symbol)).filter(F.col("canonical").isNotNull())
    stats = df.groupBy(F.col(symbol).alias("symbol")).agg(F.count("*").alias("n")).select(
        "symbol",
        "n",
        canonical_class("symbol").alias("canonical"),
        canonical_class("symbol").isNotNull().alias("kept"),
        (canonical_class("symbol").isNull() & ~F.col("symbol").isin(EXCLUDED_SYMBOLS)).alias("unknown"),
    )
    return kept, stats


def rescale_clock(native: str | Column, fs_native: str | Column, fs_target: float = 500.0) -> Column:
    """Native sample index to the target clock, halves to even."""
    n = F.col(native) if isinstance(native, str) else native
    f = F.col(fs_native) if isinstance(fs_native, str) else fs_native
    return F.rint(n.cast("double") * (F.lit(fs_target) / f)).cast("long")


def range_guard(
    df: DataFrame, keys: list[str], peak: str, sig_len: str, max_share: float = 0.01
) -> tuple[DataFrame, DataFrame]:
    """In-range annotations of acceptable records, and the records that are rejected."""
    ok = (F.col(peak) >= 0) & (F.col(peak) < F.col(sig_len))
    share = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("n_out")
    ).withColumn("error", F.col("n_out") / F.col("n") > max_share)
    bad = share.filter("error")
    good = df.filter(ok).join(bad.select(*keys), keys, "left_anti")
    return good, bad
