"""Expressions on numeric array columns (one row = one window or record)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """Evaluate `value` once and pass it to fn.

    A column used inside a lambda may be inlined by the optimizer and computed again for
    every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(x: str | Column) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def mean(x: str | Column) -> Column:
    return total(x) / F.size(_c(x))


def mean_square(x: str | Column) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v * v) / F.size(_c(x))


def power_mean(x: str | Column, centre: Column, k: int) -> Column:
    def about(m: Column) -> Column:
        def step(a: Column, v: Column) -> Column:
            d = v - m
            return a + reduce(lambda p, _: p * d, range(k - 1), d)

        return F.aggregate(_c(x), F.lit(0.0), step) / F.size(_c(x))

    return let(centre, about)


def std(x: str | Column) -> Column:
    """Population standard deviation, two passes."""
    return F.sqrt(power_mean(x, mean(x), 2))


def median(x: str | Column) -> Column:
    n = F.size(_c(x))
    return let(F.array_sort(_c(x)), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def diff(x: str | Column) -> Column:
    c = _c(x)
    n = F.size(c)
    return F.zip_with(F.slice(c, F.lit(2), n - 1), F.slice(c, F.lit(1), n - 1), lambda a, b: a - b)


def dot(x: str | Column, y: str | Column) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def doubles(x: str | Column) -> Column:
    return F.transform(_c(x), lambda v: v.cast("double"))


def window(x: str | Column, start: Column | int, length: Column | int) -> Column:
    """0-based slice."""
    s = F.lit(start) if isinstance(start, int) else start
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(_c(x), (s + 1).cast("int"), n.cast("int"))


def absmax_index(x: str | Column) -> Column:
    """0-based index of the first largest magnitude."""
    return let(F.transform(_c(x), lambda v: F.abs(v)), lambda m: (F.array_position(m, F.array_max(m)) - 1).cast("int"))


def clip_counted(x: str | Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Clipped array and the number of clipped samples."""
    c, lim = _c(x), F.struct(lo.alias("lo"), hi.alias("hi"))
    cut = let(lim, lambda k: F.transform(c, lambda v: F.greatest(k["lo"], F.least(k["hi"], v))))
    return cut, let(lim, lambda k: F.size(F.filter(c, lambda v: (v < k["lo"]) | (v > k["hi"]))))


def symmetric_limit(x: str | Column, share: float, cap: float) -> Column:
    """Largest magnitude of the two tail percentiles of the row's own samples, capped."""
    n = F.size(_c(x))

    def pct(s: Column, q: float) -> Column:
        pos = F.lit(q) * (n - 1)
        lo, hi = F.get(s, F.floor(pos).cast("int")), F.get(s, F.ceil(pos).cast("int"))
        return lo + (hi - lo) * (pos - F.floor(pos))

    return let(F.array_sort(_c(x)), lambda s: F.least(F.lit(cap), F.greatest(F.abs(pct(s, share)), F.abs(pct(s, 1 - share)))))


def zscore(x: str | Column, mu: Column, sd: Column, eps: float = 1e-12) -> Column:
    """P27."""
    return let(F.struct(mu.alias("m"), (sd + F.lit(eps)).alias("s")), lambda k: F.transform(_c(x), lambda v: (v - k["m"]) / k["s"]))


def sentinel(x: str | Column, value: float) -> Column:
    """NaN or null becomes a sentinel."""
    c = _c(x)
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(value))


# Flat-line, saturation and centring limits of a 500-sample window.
FLAT_STD, SATURATION, CENTRE = 0.01, 9.99, (225, 275)


def quality_flags(x: str | Column, centre: tuple[int, int] = CENTRE, flat: float = FLAT_STD, saturation: float = SATURATION) -> dict[str, Column]:
    """Three flags and one label; several flags give MULTIPLE_FLAGS."""
    c = _c(x)
    at = absmax_index(c)
    flags = {
        "flatline": std(c) < flat,
        "saturated": F.exists(c, lambda v: F.abs(v) >= saturation),
        "misaligned": (at < centre[0]) | (at > centre[1]),
    }
    n = sum((f.cast("int") for f in flags.values()), F.lit(0))
    label = F.when(n > 1, "MULTIPLE_FLAGS").when(flags["flatline"], "FLATLINE").when(flags["saturated"], "SATURATED").when(flags["misaligned"], "MISALIGNED").otherwise("OK")
    return {**flags, "quality": label}


def derived_features(df: DataFrame) -> DataFrame:
    """P20: seventeen derived columns of the temporal and morphology features."""
    g, eps = F.col, 1e-9
    vals = F.filter(F.array("rr_prev", "rr_next", "rr_local_mean", "rr_local_std"), lambda v: v > 0)
    s = total(vals)
    entropy = let(s, lambda t: F.when(t > 0, -F.aggregate(vals, F.lit(0.0), lambda a, v: a + v / t * F.log(v / t))).otherwise(0.0))
    return df.withColumns({
        "rr_delta": g("rr_next") - g("rr_prev"),
        "rr_delta_abs": F.abs(g("rr_next") - g("rr_prev")),
        "rr_local_cv": g("rr_local_std") / (g("rr_local_mean") + eps),
        "rr_rmssd_ratio": g("rmssd") / (g("rr_local_mean") + eps),
        "rr_prev_next_ratio": g("rr_prev") / (g("rr_next") + eps),
        "rr_local_entropy": entropy,
        "hr_var": g("rr_local_std") * g("heart_rate"),
        "hr_rmssd": g("heart_rate") * g("rmssd"),
        "qrs_area_per_ms": g("qrs_area") / (g("qrs_width_ms") + eps),
        "st_t_product": g("st_slope_mV_s") * g("t_amplitude"),
        "r_q_ratio": g("r_amplitude") / (g("q_depth") + eps),
        "t_q_ratio": g("t_amplitude") / (g("q_depth") + eps),
        "qrs_ragged_x_ratio": g("qrs_raggedness") * g("rr_ratio"),
        "t_r_x_rr_ratio": g("t_r_ratio") * g("rr_ratio"),
        "log_qrs_width": F.log1p(F.abs("qrs_width_ms")),
        "log_rr_local_std": F.log1p(F.abs("rr_local_std")),
        "log_rmssd": F.log1p(F.abs("rmssd")),
    })


def sample_rows(df: DataFrame, samples: str, index: str = "i", value: str = "x") -> DataFrame:
    """Long form of an array column."""
    return df.select("*", F.posexplode(samples).alias(index, value)).drop(samples)


def global_stats(df: DataFrame, samples: str, by: list[str] = (), clip: float | None = None) -> DataFrame:
    """A3, A4: mean and population std over all samples; a flat set gets std 1, NaN or infinity is an error.

    Each row is reduced to count, sum and sum of squares first, so no sample is shuffled.
    """
    x = doubles(samples) if clip is None else F.transform(doubles(samples), lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), v)))
    bad = F.exists(F.col(samples), lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    r = df.select(*by, F.size(samples).alias("_n"), total(x).alias("_s"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v).alias("_q"), bad.alias("_bad"))
    a = r.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.count_if("_bad").alias("n_bad_rows"))
    mu = F.col("_s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("n") - mu * mu))
    return a.select(*by, "n", "n_bad_rows", mu.alias("mean"), F.when(sd < 1e-12, 1.0).otherwise(sd).alias("std"))
