"""Column functions on probabilities, scores and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-7
LOGIT_CLIP = 30.0


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def logit(p: Column) -> Column:
    q = clip(p, EPS, 1.0 - EPS)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def temperature(p: Column, t: float) -> Column:
    """sigmoid(logit / T), logits limited to +-30."""
    return sigmoid(clip(logit(p) / F.lit(float(t)), -LOGIT_CLIP, LOGIT_CLIP))


def platt(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * logit(p) + F.lit(b))


def beta(p: Column, a: float, b: float, c: float) -> Column:
    return sigmoid(F.lit(a) * F.log(clip(p, EPS, 1.0)) - F.lit(b) * F.log(clip(F.lit(1.0) - p, EPS, 1.0)) + F.lit(c))


def softmax(z: Sequence[Column]) -> list[Column]:
    top = F.greatest(*z)
    e = [F.exp(v - top) for v in z]
    total = sum(e[1:], e[0])
    return [v / total for v in e]


def multiclass(ps: Sequence[Column], method: str, **k) -> list[Column]:
    """Temperature, vector or dirichlet map of class probabilities."""
    lp = [F.log(clip(p, EPS, 1.0)) for p in ps]
    n = len(lp)
    if method == "temperature":
        z = [v / F.lit(float(k["t"])) for v in lp]
    elif method == "vector":
        z = [lp[i] * float(k["w"][i]) + float(k["b"][i]) for i in range(n)]
    elif method == "dirichlet":
        z = [sum((lp[j] * float(k["w"][j][i]) for j in range(n)), F.lit(float(k["b"][i]))) for i in range(n)]
    else:
        z = lp
    return softmax(z)


def log_margin(target: Column, others: Sequence[Column]) -> Column:
    """Log p of the target class minus the best other log p."""
    lp = lambda c: F.log(F.greatest(c, F.lit(1e-12)))
    return lp(target) - F.greatest(*[lp(c) for c in others]) if len(others) > 1 else lp(target) - lp(others[0])


def decide_multilabel(p: Column, threshold: Column | float) -> Column:
    """P30."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(p >= t, 1).otherwise(0)


def decide_last(ps: Sequence[Column], thresholds: Sequence[float]) -> Column:
    """The last class over its threshold; class 0 by default."""
    over = [F.when(p >= t, i) for i, (p, t) in enumerate(zip(ps, thresholds))]
    return F.coalesce(*reversed(over), F.lit(0))


def argmax(ps: Sequence[Column]) -> Column:
    """Index of the first largest value."""
    top = F.greatest(*ps)
    return F.coalesce(*[F.when(p == top, i) for i, p in enumerate(ps)])


def decide_over(ps: Sequence[Column], thresholds: Sequence[float], fallback: int | None = None) -> Column:
    """Most probable class among those over their thresholds; else argmax or a fixed class."""
    masked = [F.when(p >= t, p).otherwise(-1.0) for p, t in zip(ps, thresholds)]
    other = argmax(ps) if fallback is None else F.lit(fallback)
    return F.when(F.greatest(*masked) >= 0, argmax(masked)).otherwise(other)


def cascade(stage1: Column, threshold: float, stage2_label: Column) -> Column:
    """0 below the first threshold, else the second-stage label + 1."""
    return F.when(stage1 >= threshold, stage2_label + 1).otherwise(0)


def ensemble(scores: DataFrame, keys: Sequence[str], p: str, weight: str) -> DataFrame:
    """Weighted mean of the scores of several models."""
    return scores.groupBy(*keys).agg((F.sum(F.col(p) * F.col(weight)) / F.sum(weight)).alias("p"))


def quantize(x: Column, scale: float, zero_point: int) -> Column:
    """Affine int8 of an array column."""
    return F.transform(x, lambda v: clip(F.rint(v / F.lit(scale)) + F.lit(zero_point), -128.0, 127.0).cast("int"))


def dequantize(q: Column, scale: float, zero_point: int) -> Column:
    return F.transform(q, lambda v: (v - F.lit(zero_point)) * F.lit(scale))


def saturated(q: Column) -> Column:
    """Number of quantized values at either end of the range."""
    return F.size(F.filter(q, lambda v: (v == -128) | (v == 127)))


# Fields that must agree for two evaluations to be comparable.
CONTRACT_FIELDS = [
    "evaluator_version", "task_profile", "split_id", "ontology_version", "n_bins", "calibration_method", "threshold_policy", "preprocessing_version",
]


def comparable(pairs: DataFrame, left: str = "a", right: str = "b", fields: Sequence[str] = CONTRACT_FIELDS) -> DataFrame:
    """Status and reasons for rows that hold two contract structs."""
    diff = F.array_compact(F.array(*[
        F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")),
               F.concat(F.lit(f"{f}: "), F.col(f"{left}.{f}").cast("string"), F.lit(" != "), F.col(f"{right}.{f}").cast("string")))
        for f in fields]))
    return pairs.withColumn("reasons", diff).withColumn("status", F.when(F.size("reasons") == 0, "COMPARABLE").otherwise("NON_COMPARABLE"))
