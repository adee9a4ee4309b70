"""Reliability tables, calibration errors and calibrator fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import probability as P
from ..session import pinned
from .metrics import EPS, grid_cell, losses, ratio
from .ordering import BLOCK, logit_bucket, running, shifted


def reliability(df: DataFrame, by: Sequence[str], n_bins: int = 15, p: str = "p", y: str = "y") -> DataFrame:
    """Non-empty equal-width bins, compared with the exact edges, the last one closed."""
    edges = np.linspace(0.0, 1.0, n_bins + 1)
    inside = df.filter((F.col(p) >= 0) & (F.col(p) <= 1))
    cell = F.least(F.lit(n_bins - 1), grid_cell(F.col(p), edges) - 1).cast("int")
    return inside.groupBy(*by, cell.alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("acc"), F.avg(p).alias("conf"))


def errors(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected and maximum calibration error of a reliability table."""
    gap = F.abs(F.col("acc") - F.col("conf"))
    return bins.groupBy(*by).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def report(df: DataFrame, by: Sequence[str] = ("class",), n_bins: int = 15) -> DataFrame:
    """ECE, MCE, Brier, NLL per class."""
    return errors(reliability(df, by, n_bins), by).join(losses(df, by).select(*by, "brier", "nll", "n", "support"), list(by))


def full_bins(df: DataFrame, by: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Reliability with the empty bins kept."""
    r = reliability(df, by, n_bins)
    grid = r.select(*by).distinct().withColumn("bin", F.explode(F.array(*[F.lit(i) for i in range(n_bins)])))
    return grid.join(r, [*by, "bin"], "left").fillna(0, ["n"])


def top_label(df: DataFrame, by: Sequence[str], ps: Sequence[str], y: str = "y_true", n_bins: int = 10) -> DataFrame:
    """ECE and MCE of the top label and the multi-class Brier score."""
    cols = [F.col(c) for c in ps]
    brier = sum(((c - F.when(F.col(y) == i, 1.0).otherwise(0.0)) * (c - F.when(F.col(y) == i, 1.0).otherwise(0.0)) for i, c in enumerate(cols)), F.lit(0.0))
    x = df.select(*by, F.greatest(*cols).alias("p"), F.when(P.argmax(cols) == F.col(y), 1).otherwise(0).alias("y"), brier.alias("_b"))
    e = errors(reliability(x, by, n_bins), by)
    b = x.groupBy(*by).agg(F.avg("_b").alias("brier"))
    return e.join(b, list(by)) if by else e.join(F.broadcast(b))  # one row


def per_true_class(df: DataFrame, ps: Sequence[str], y: str = "y_true") -> DataFrame:
    """Brier and mean confidence of the rows of each true class; zero when absent."""
    cols = [F.col(c) for c in ps]
    own = F.coalesce(*[F.when(F.col(y) == i, c) for i, c in enumerate(cols)])
    a = df.groupBy(F.col(y).alias("class")).agg(F.avg((F.lit(1.0) - own) * (F.lit(1.0) - own)).alias("brier"), F.avg(F.greatest(*cols)).alias("confidence"))
    grid = df.sparkSession.range(len(ps)).select(F.col("id").cast("int").alias("class"))
    return grid.join(a, "class", "left").fillna(0.0)


# ---- fitting ----------------------------------------------------------------------------

def _nll(z: Column, y: Column) -> Column:
    z = P.clip(z, -P.LOGIT_CLIP, P.LOGIT_CLIP)
    return F.avg(F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z))))


def _search(df: DataFrame, loss_at, lo: float, hi: float, passes: int = 9, points: int = 8) -> float:
    """Minimum of a one-parameter loss: each pass evaluates all points in one aggregate."""
    a, b = np.log(lo), np.log(hi)
    for _ in range(passes):
        ts = np.exp(np.linspace(a, b, points))
        row = df.agg(*[loss_at(float(t)).alias(f"l{i}") for i, t in enumerate(ts)]).head()
        i = int(np.argmin([row[f"l{j}"] for j in range(points)]))
        a, b = np.log(ts[max(0, i - 1)]), np.log(ts[min(points - 1, i + 1)])
    return float(np.exp((a + b) / 2))


def fit_temperature(df: DataFrame, p: str = "p", y: str = "y", bounds: tuple[float, float] = (0.05, 20.0)) -> float:
    """Scalar temperature of lowest NLL over samples and labels."""
    z = P.logit(F.col(p))
    return _search(df, lambda t: _nll(z / t, F.col(y)), *bounds)


def _logistic(df: DataFrame, feats: Sequence[Column], y: str, c: float, family: str = "binomial"):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = df.select(*[f.alias(f"f{i}") for i, f in enumerate(feats)], F.col(y).cast("double").alias("label"))
    x = VectorAssembler(inputCols=[f"f{i}" for i in range(len(feats))], outputCol="features").transform(x)
    n = df.count()
    # the usual inverse-strength C becomes a penalty on the mean loss
    return LogisticRegression(regParam=1.0 / (c * n), standardization=False, maxIter=100, tol=1e-7, family=family).fit(x)


BINARY_METHODS = ("identity", "temperature", "platt", "beta", "isotonic")
MULTICLASS_METHODS = ("identity", "temperature", "vector", "dirichlet")


def _column(fn):
    """A calibrator that is a column expression, as a function of a frame."""
    return lambda df, p, name: df.withColumn(name, fn(F.col(p)))


def fit_binary(df: DataFrame, method: str, p: str = "p", y: str = "y"):
    """Fit one binary calibrator; returns (parameters, function(frame, score column, new column))."""
    c = F.col(p)
    if method == "identity":
        return {}, _column(lambda q: q)
    if method == "temperature":
        t = fit_temperature(df, p, y, (1e-3, 100.0))
        return {"t": t}, _column(lambda q: P.sigmoid(P.logit(q) / t))
    if method == "platt":
        m = _logistic(df, [P.logit(c)], y, 1.0)
        a, b = float(m.coefficients[0]), float(m.intercept)
        return {"a": a, "b": b}, _column(lambda q: P.platt(q, a, b))
    if method == "beta":
        m = _logistic(df, [F.log(P.clip(c, EPS, 1.0)), -F.log(P.clip(F.lit(1.0) - c, EPS, 1.0))], y, 1.0)
        a, b, k = float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept)
        return {"a": a, "b": b, "c": k}, _column(lambda q: P.beta(q, a, b, k))
    if method == "isotonic":
        steps = pinned(isotonic_steps(df, [], p, y))
        return {"steps": steps}, lambda x, q, name: apply_isotonic(x, steps, [], q, name)
    raise ValueError(method)


def _convex(x: pd.DataFrame) -> pd.DataFrame:
    """Corners of the lower convex hull of points ordered by w."""
    w, s = x["_w"].to_numpy("float64"), x["_s"].to_numpy("float64")
    keep: list[int] = []
    for i in range(len(x)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (s[b] - s[a]) * (w[i] - w[a]) < (s[i] - s[a]) * (w[b] - w[a]):
                break
            keep.pop()
        keep.append(i)
    return x.iloc[keep]


def isotonic_steps(df: DataFrame, by: Sequence[str], p: str = "p", y: str = "y", cuts: int = 64) -> DataFrame:
    """Isotonic regression of a 0/1 outcome on a probability, as a table of steps per key.

    The fit is the slope of the greatest convex minorant of (rows so far, positives so far). Blocks of
    ordered scores keep the corners of their own minorant. For each of `cuts` slopes the corner
    that minimises positives - slope * rows lies on the whole minorant; these corners cut it
    into pieces, each the minorant of the block corners between its ends. Rows without score or
    outcome take no part. Columns: step (place of its last score), before (that of the step below),
    x_lo, x_hi, value, n, and x_up, value_up of the step above (null at the top).
    """
    by = list(by)
    g = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("_x")).agg(
        F.count("*").alias("_n"), F.sum(F.col(y).cast("long")).alias("_y"))
    bucket, order = logit_bucket("_x"), [F.col("_x")]
    g = shifted(g, by, bucket, order, {"_next": ("_x", -1)}, index="_at").withColumnRenamed("_at", "_i")
    g = running(g, by, bucket, order, {"_w": F.col("_n"), "_s": F.col("_y")}).select(*by, "_i", "_x", "_next", "_w", "_s")
    zero = F.lit(0).cast("long")
    start = g.filter("_i = 1").select(*by, zero.alias("_i"), F.lit(None).cast("double").alias("_x"), F.col("_x").alias("_next"), zero.alias("_w"), zero.alias("_s"))
    points = g.unionByName(start)

    def corners(x: DataFrame, part: str) -> DataFrame:
        return x.groupBy(*by, part).applyInPandas(lambda pdf: _convex(pdf.sort_values("_i")), x.schema)

    low = pinned(corners(points.withColumn("_block", F.floor(F.col("_i") / F.lit(BLOCK))), "_block"))
    w = W.partitionBy(*by, "_block").orderBy("_i")
    slope = lambda t: (F.col(t) - F.lag(t).over(w))
    edge = low.withColumn("_in", slope("_s") / slope("_w"))
    edge = edge.withColumn("_out", F.lead("_in").over(w))
    grid = edge.filter("_in is not null").groupBy(*by).agg(F.array_distinct(F.percentile_approx("_in", [i / (cuts + 1) for i in range(1, cuts + 1)], 10000)).alias("_grid"))
    seen = _on(edge, grid, by, "left").withColumn("_t", F.explode(F.filter("_grid", lambda t: (t > F.coalesce("_in", F.lit(float("-inf")))) & (t <= F.coalesce("_out", F.lit(float("inf")))))))
    at = seen.groupBy(*by, "_t").agg(F.min(F.struct((F.col("_s") - F.col("_t") * F.col("_w")).alias("v"), "_i")).getField("_i").alias("_i"))
    at = at.groupBy(*by).agg(F.collect_set("_i").alias("_cuts"))  # at most `cuts` numbers
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_i")))
    x = _on(low, at, by, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<bigint>")))
    x = x.withColumn("_piece", F.explode(F.when(F.array_contains("_cuts", F.col("_i")), F.array(below, below + 1)).otherwise(F.array(below))))
    x = pinned(corners(x.drop("_block", "_cuts"), "_piece"))
    w = W.partitionBy(*by, "_piece").orderBy("_i")
    last = lambda c: F.lag(c).over(w)
    step = x.select(
        *by, F.col("_i").alias("step"), last("_i").alias("before"), last("_next").alias("x_lo"), F.col("_x").alias("x_hi"),
        ((F.col("_s") - last("_s")) / (F.col("_w") - last("_w"))).alias("value"), (F.col("_w") - last("_w")).alias("n"), F.col("_next").alias("x_up"),
    ).filter("before is not null")
    step = pinned(step)
    up = step.select(*by, F.col("before").alias("step"), F.col("value").alias("value_up"))
    return step.join(up, [*by, "step"], "left")


def _on(df: DataFrame, one: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Join a table of one row per key; without keys it is one row."""
    return df.join(one, list(by), how) if by else df.join(F.broadcast(one), how=how, on=F.lit(True))


def apply_isotonic(df: DataFrame, steps: DataFrame, by: Sequence[str], p: str = "p", name: str = "calibrated") -> DataFrame:
    """Fitted value of every row: flat inside a step, a line between steps, the end values outside.

    A range join on (key, score bucket): a step is copied to the buckets it reaches, one more than
    its borders cross, so copies number at most steps plus buckets. A null score, or a key without a fit, gives null.
    """
    ends = F.sequence(
        F.when(F.col("before") == 0, logit_bucket(F.lit(0.0))).otherwise(logit_bucket("x_lo")),
        F.when(F.col("x_up").isNull(), logit_bucket(F.lit(1.0))).otherwise(logit_bucket("x_up")),
    )
    keys = {k: f"_k{i}" for i, k in enumerate(by)}
    s = steps.select(*[F.col(k).alias(n) for k, n in keys.items()], "before", *[F.col(c).alias(f"_{c}") for c in ("x_lo", "x_hi", "x_up", "value", "value_up")], F.explode(ends).alias("_b"))
    s = s.withColumnRenamed("before", "_before")
    q = F.col("_q")
    on = (F.col("_bq") == F.col("_b")) & ((F.col("_before") == 0) | (q >= F.col("_x_lo"))) & (F.col("_x_up").isNull() | (q < F.col("_x_up")))
    for k, n in keys.items():
        on = on & (F.col(k) == F.col(n))
    x = df.withColumns({"_q": F.col(p).cast("double"), "_bq": logit_bucket(p)}).join(s, on, "left")
    line = F.col("_value") + (F.col("_value_up") - F.col("_value")) * (q - F.col("_x_hi")) / (F.col("_x_up") - F.col("_x_hi"))
    fit = F.when((q <= F.col("_x_hi")) | F.col("_x_up").isNull(), F.col("_value")).otherwise(line)
    return x.withColumn(name, fit).select(*df.columns, name)


def select_binary(df: DataFrame, p: str = "p", y: str = "y", methods: Sequence[str] = BINARY_METHODS, min_positives: int = 50):
    """The calibrator of lowest NLL on the calibration rows, and all scores.

    A fit is (parameters, function of a frame and two column names that adds the calibrated
    probability). The isotonic fit is left out below `min_positives` positives.
    """
    df = pinned(df.select(p, y))  # read many times by the fits
    if "isotonic" in methods and df.filter(F.col(y) == 1).count() < min_positives:
        methods = [m for m in methods if m != "isotonic"]
    fits = {m: fit_binary(df, m, p, y) for m in methods}
    x = df
    for m, (_, transform) in fits.items():
        x = transform(x, p, f"_{m}")
    q = lambda m: P.clip(F.col(f"_{m}"), EPS, 1.0 - EPS)
    row = x.agg(*[(-F.avg(F.when(F.col(y) == 1, F.log(q(m))).otherwise(F.log(F.lit(1.0) - q(m))))).alias(m) for m in fits]).head()
    scores = row.asDict()
    best = min(scores, key=lambda m: scores[m])
    return best, fits[best], scores


def _multinomial(df: DataFrame, ps: Sequence[str], y: str):
    m = _logistic(df, [F.log(P.clip(F.col(c), EPS, 1.0)) for c in ps], y, 1e6, "multinomial")
    return m.coefficientMatrix.toArray(), m.interceptVector.toArray()


def _as_map(method: str, w: np.ndarray, b: np.ndarray) -> dict:
    return {"w": np.diag(w).tolist() if method == "vector" else w.T.tolist(), "b": b.tolist()}


def fit_multiclass(df: DataFrame, method: str, ps: Sequence[str], y: str = "y_true") -> dict:
    if method == "temperature":
        own = lambda t: F.coalesce(*[F.when(F.col(y) == i, q) for i, q in enumerate(P.multiclass([F.col(c) for c in ps], "temperature", t=t))])
        return {"t": _search(df, lambda t: -F.avg(F.log(P.clip(own(t), EPS, 1.0))), 1e-3, 100.0)}
    if method in ("vector", "dirichlet"):
        return _as_map(method, *_multinomial(df, ps, y))
    return {}


def select_multiclass(df: DataFrame, ps: Sequence[str], y: str = "y_true", methods: Sequence[str] = MULTICLASS_METHODS):
    """The multi-class calibrator of lowest NLL."""
    df = pinned(df.select(*ps, y))  # read many times by the fits
    fits = {m: fit_multiclass(df, m, ps, y) for m in methods if m not in ("vector", "dirichlet")}
    if {"vector", "dirichlet"} & set(methods):
        w, b = _multinomial(df, ps, y)  # one fit serves both maps
        fits.update({m: _as_map(m, w, b) for m in ("vector", "dirichlet") if m in methods})
    cols = [F.col(c) for c in ps]

    def loss(m: str) -> Column:
        own = F.coalesce(*[F.when(F.col(y) == i, q) for i, q in enumerate(P.multiclass(cols, m, **fits[m]))])
        return -F.avg(F.log(P.clip(own, EPS, 1.0)))

    scores = df.agg(*[loss(m).alias(m) for m in fits]).head().asDict()
    best = min(scores, key=lambda m: scores[m])
    return best, fits[best], scores


def macro_row(rep: DataFrame) -> DataFrame:
    return rep.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("ece", "mce", "brier", "nll")])


def share_by_group(df: DataFrame, group: str, cls: str) -> DataFrame:
    """Class shares inside each group."""
    n = df.groupBy(group, cls).agg(F.count("*").alias("n"))
    return n.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy(group))))
