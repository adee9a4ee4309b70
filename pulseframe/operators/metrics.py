"""Classification statistics from prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordering import logit_bucket, percentiles, running


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    out = F.when(b != 0, a / b)
    return out if empty is None else out.otherwise(F.lit(empty))


def f1_of(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, p * r * 2 / (p + r)).otherwise(0.0)


def mean_of(cols: Sequence[Column]) -> Column:
    return sum(cols[1:], cols[0]) / float(len(cols))


# ---- confusion --------------------------------------------------------------------------

def pair_counts(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Counts of (true, predicted) pairs; every later table is computed from these few rows."""
    return df.groupBy(*by, F.col(y).alias("t"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def _one_vs_rest(pairs: DataFrame, by: Sequence[str], n_classes: int) -> DataFrame:
    x = pairs.withColumn("class", F.explode(F.array(*[F.lit(c) for c in range(n_classes)])))
    c = F.col("class")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    return x.groupBy(*by, "class").agg(
        total((F.col("t") == c) & (F.col("p") == c)).alias("tp"),
        total((F.col("t") == c) & (F.col("p") != c)).alias("fn"),
        total((F.col("t") != c) & (F.col("p") == c)).alias("fp"),
        total((F.col("t") != c) & (F.col("p") != c)).alias("tn"),
    )


def class_report(pairs: DataFrame, by: Sequence[str], n_classes: int, digits: int | None = 4) -> DataFrame:
    """A8 per class: counts, sensitivity, precision, FPR, specificity, F1."""
    x = _one_vs_rest(pairs, by, n_classes)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    x = x.withColumns({"se": ratio(tp, tp + fn), "ppv": ratio(tp, tp + fp), "fpr": ratio(fp, fp + tn), "spe": ratio(tn, tn + fp)})
    x = x.withColumn("f1", f1_of(F.col("se"), F.col("ppv")))
    if digits is not None:
        x = x.withColumns({c: F.round(c, digits) for c in ("se", "ppv", "fpr", "spe", "f1")})
    return x


# Default acceptance limits (classes N S V F Q).
DEFAULT_GATE = {"acc": 0.93, "f1_macro": 0.85, "mcc": 0.80, "fpr_global": 0.05, "se": {0: 0.96, 1: 0.75, 2: 0.90, 3: 0.60, 4: 0.70}}


def global_report(pairs: DataFrame, by: Sequence[str], n_classes: int, gate: dict | None = None) -> DataFrame:
    """A8 global: accuracy, macro F1 of the rounded class values, MCC, global FPR and the verdict."""
    gate = gate or {**DEFAULT_GATE, "se": {c: v for c, v in DEFAULT_GATE["se"].items() if c < n_classes}}
    rep = class_report(pairs, by, n_classes)
    limits = F.create_map(*[v for c, m in gate["se"].items() for v in (F.lit(c), F.lit(m))]) if gate["se"] else None
    short = F.lit(False) if limits is None else F.coalesce(F.col("se") < F.try_element_at(limits, F.col("class")), F.lit(False))
    # totals per class give accuracy and the multi-class correlation
    t, q = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    g = rep.groupBy(*by).agg(
        F.sum("tp").alias("_c"),
        F.max(F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("_s"),
        F.sum(t * q).alias("_tq"), F.sum(t * t).alias("_tt"), F.sum(q * q).alias("_qq"),
        F.sum("fp").alias("_fp"), F.sum("tn").alias("_tn"),
        F.avg("f1").alias("f1_macro"),
        F.max(short).alias("_short"),
    )
    s = F.col("_s").cast("double")
    den = F.sqrt((s * s - F.col("_qq")) * (s * s - F.col("_tt")))
    g = g.withColumns({
        "acc": ratio(F.col("_c"), F.col("_s")),
        "mcc": ratio(F.col("_c") * s - F.col("_tq"), den),
        "fpr_global": ratio(F.col("_fp"), F.col("_fp") + F.col("_tn")),
    })
    ok = (
        (F.col("acc") > gate["acc"]) & (F.col("f1_macro") > gate["f1_macro"]) & (F.col("mcc") > gate["mcc"])
        & (F.col("fpr_global") < gate["fpr_global"]) & ~F.col("_short")
    )
    return g.withColumn("passed", ok).select(*by, *[F.round(c, 4).alias(c) for c in ("acc", "f1_macro", "mcc", "fpr_global")], "passed")


def metric_rows(rep: DataFrame, glob: DataFrame, by: Sequence[str], names: Sequence[str], prefix: str = "") -> DataFrame:
    """Evaluation tables as metric rows (namespace, name, class_name, value)."""
    wide = glob.withColumn("passed", F.col("passed").cast("double"))
    cols = ["acc", "f1_macro", "mcc", "fpr_global", "passed"]
    g = wide.unpivot(list(by), cols, "name", "value").select(*by, F.lit("global").alias("namespace"), "name", F.lit(None).cast("string").alias("class_name"), "value")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("class") + 1)
    cc = ["tp", "fn", "fp", "tn", "se", "ppv", "fpr", "spe", "f1"]
    c = rep.withColumns({k: F.col(k).cast("double") for k in cc}).withColumn("class_name", label)
    c = c.unpivot([*by, "class_name"], cc, "name", "value").select(*by, F.lit("per_class").alias("namespace"), "name", "class_name", "value")
    return g.unionByName(c).withColumn("name", F.concat(F.lit(prefix), F.col("name")))


def gate_alerts(glob: DataFrame, by: Sequence[str], stage: str = "") -> DataFrame:
    """One warning per evaluation that failed its gate."""
    return glob.filter(~F.col("passed")).select(
        *by, F.lit("warning").alias("severity"), F.lit("qg_failure").alias("category"),
        F.lit(f"{stage} gate not met".strip()).alias("message"), F.lit(0.0).alias("metric_value"))


def normalized_confusion(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each true class that goes to each prediction."""
    w = W.partitionBy(*by, "t")
    return pairs.withColumn("share", F.col("n") / (F.sum("n").over(w) + F.lit(1e-9)))


def confusion_summary(pairs: DataFrame, by: Sequence[str], n_classes: int) -> DataFrame:
    """Recall, true precision and the column maximum of the normalized matrix."""
    simple = normalized_confusion(pairs, by).groupBy(*by, F.col("p").alias("class")).agg(F.max("share").alias("precision_simplified"))
    rep = class_report(pairs, by, n_classes, digits=None).select(*by, "class", F.col("se").alias("recall"), F.col("ppv").alias("precision"))
    return rep.join(simple, [*by, "class"], "left").fillna(0.0, ["precision_simplified"])


def group_recall(df: DataFrame, group: str, n_classes: int, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Recall per class inside each group, null where the class is absent, and the group size."""
    n = pair_counts(df, [group], y, p)
    hit = [
        ratio(F.sum(F.when((F.col("t") == c) & (F.col("p") == c), F.col("n")).otherwise(0)),
              F.sum(F.when(F.col("t") == c, F.col("n")).otherwise(0)), None).alias(f"recall_{c}")
        for c in range(n_classes)
    ]
    return n.groupBy(group).agg(*hit, F.sum("n").alias("support"))


def binary_counts(df: DataFrame, by: Sequence[str], decision: Column, y: str = "y") -> DataFrame:
    """Counts of a binary decision per group."""
    pos = F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count_if(pos & decision).alias("tp"), F.count_if(~pos & decision).alias("fp"),
        F.count_if(~pos & ~decision).alias("tn"), F.count_if(pos & ~decision).alias("fn"))


def prf(df: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1_of(p, r))


def at_thresholds(df: DataFrame, thresholds: dict[str, float], cls: str = "class", p: str = "p") -> DataFrame:
    """A10: precision, recall and F1 per class at its own threshold."""
    t = F.try_element_at(F.create_map(*[F.lit(v) for kv in thresholds.items() for v in kv]), F.col(cls))
    return prf(binary_counts(df.withColumn("threshold", t), [cls, "threshold"], F.col(p) >= F.col("threshold")))


EPS = 1e-7


def losses(df: DataFrame, by: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Binary cross-entropy, Brier score and support per group."""
    q = F.greatest(F.lit(EPS), F.least(F.lit(1.0 - EPS), F.col(p)))
    return df.groupBy(*by).agg(
        (-F.avg(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(F.lit(1.0) - q)))).alias("nll"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
        F.sum(y).alias("support"), F.count("*").alias("n"))


# ---- ranking curves ---------------------------------------------------------------------

def score_groups(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Positives and negatives per distinct score: the input of every curve."""
    return df.groupBy(*keys, F.col(p).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))


def curve(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Cumulative counts, precision and recall at every distinct threshold, high to low."""
    g = score_groups(df, keys, p, y)
    x = running(g, keys, -logit_bucket("score"), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})
    tot = g.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    x = x.join(tot, list(keys)) if keys else x.join(F.broadcast(tot))  # one row without keys
    return x.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("n_pos"), 1.0))


def auroc_ap(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Area under ROC and average precision with tied scores; null when undefined."""
    c = curve(df, keys, p, y)
    # each score group: its negatives lie below all earlier positives and tie with its own
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    ap = F.sum(F.col("pos") * F.col("precision"))
    return c.groupBy(*keys).agg(area.alias("_a"), ap.alias("_p"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")).select(
        *keys, "n_pos", "n_neg",
        ratio(F.col("_a"), F.col("n_pos") * F.col("n_neg"), None).alias("auc_roc"),
        ratio(F.col("_p"), F.col("n_pos"), None).alias("auc_pr"))


def multilabel_report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Support, AUROC, AP, precision, recall and F1 per class."""
    a = auroc_ap(df, ["class"]).drop("n_neg").withColumnRenamed("n_pos", "support")
    return a.join(prf(binary_counts(df, ["class"], F.col("p") >= threshold)), "class")


def macro(report: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unweighted means that skip nulls."""
    return report.agg(*[F.avg(c).alias(f"macro_{c}") for c in cols])


def ap_reference(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average precision against prevalence."""
    a = auroc_ap(df, keys)
    prev = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    lift = F.col("auc_pr") - prev
    verdict = F.when(lift > 1e-12, "ABOVE_PREVALENCE_REFERENCE").when(lift < -1e-12, "BELOW_PREVALENCE_REFERENCE").otherwise("NEAR_PREVALENCE_REFERENCE")
    return a.select(*keys, "auc_pr", prev.alias("prevalence"), lift.alias("lift"), verdict.alias("verdict"))


# ---- threshold search -------------------------------------------------------------------

def grid_cell(p: Column, grid: np.ndarray) -> Column:
    """How many values of an even, ascending grid are <= p, compared with the exact grid values."""
    g = F.array(*[F.lit(float(v)) for v in grid])
    n, step = len(grid), float(grid[1] - grid[0])
    k = F.least(F.lit(n), F.greatest(F.lit(0), F.floor((p - float(grid[0])) / step).cast("int") + 1))
    up = (k < n) & (F.get(g, k) <= p)
    down = (k > 0) & (F.get(g, k - 1) > p)
    return F.when(up, k + 1).when(down, k - 1).otherwise(k)


def counts_on_grid(df: DataFrame, keys: Sequence[str], grid: np.ndarray, p: str = "p", y: str = "y") -> DataFrame:
    """TP, FP, TN, FN at every grid threshold from one histogram of the scores."""
    h = df.groupBy(*keys, grid_cell(F.col(p), grid).alias("cell")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    ids = F.array(*[F.lit(i) for i in range(1, len(grid) + 1)])
    x = h.withColumn("i", F.explode(ids))
    above = F.col("cell") >= F.col("i")
    x = x.groupBy(*keys, "i").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"), F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"))
    return x.withColumn("threshold", F.get(F.array(*[F.lit(float(v)) for v in grid]), F.col("i") - 1))


def _binary_scores(x: DataFrame) -> DataFrame:
    """Both-class F1 and the global figures of a two-class decision."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    pr, rc = ratio(tp, tp + fp), ratio(tp, tp + fn)
    npv, spe = ratio(tn, tn + fn), ratio(tn, tn + fp)
    d = lambda c: c.cast("double")
    mcc = ratio(d(tp) * tn - d(fp) * fn, F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn)))
    return x.withColumns({
        "precision": pr, "recall": rc, "spe": spe, "f1": f1_of(pr, rc), "f1_neg": f1_of(npv, spe),
        "acc": (tp + tn) / (tp + tn + fp + fn), "mcc": mcc,
        # both classes count every sample once, so the pooled rate is errors / all
        "fpr_global": (fp + fn) / (tp + tn + fp + fn)}).withColumn("f1_macro", (F.col("f1") + F.col("f1_neg")) / 2.0)


def _pick(x: DataFrame, keys: Sequence[str], score: list[Column], cols: Sequence[str]) -> DataFrame:
    """Best row per key: highest score tuple, lowest threshold on ties."""
    best = F.max(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)], (-F.col("threshold")).alias("nt"), *cols)).alias("m")
    return x.groupBy(*keys).agg(best).select(*keys, (-F.col("m.nt")).alias("threshold"), *[F.col(f"m.{c}").alias(c) for c in cols])


def best_gated_threshold(df: DataFrame, keys: Sequence[str], gate: dict) -> DataFrame:
    """Grid search where passing the gate comes first, macro F1 second."""
    x = _binary_scores(counts_on_grid(df, keys, np.arange(0.01, 1.0, 0.01)))
    f1m = F.round((F.round("f1", 4) + F.round("f1_neg", 4)) / 2.0, 4)
    ok = (F.col("acc") > gate["acc"]) & (F.col("f1_macro") > gate["f1_macro"]) & (F.col("mcc") > gate["mcc"]) & (F.col("fpr_global") < gate["fpr_global"])
    x = x.withColumns({"passed": ok, "f1_macro": f1m})
    return _pick(x, keys, [F.col("passed"), F.col("f1_macro")], ["passed", "f1_macro"])


def youden_threshold(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold of the largest sensitivity + specificity - 1."""
    x = _binary_scores(counts_on_grid(df, keys, np.arange(0.01, 1.0, 0.01)))
    return _pick(x.withColumn("j", F.round(F.col("recall") + F.col("spe") - 1.0, 12)), keys, [F.col("j")], ["j"])


def constrained_threshold(df: DataFrame, keys: Sequence[str], recall: float = 0.30, precision: float = 0.25, f1_neg: float = 0.90) -> DataFrame:
    """Best macro F1 subject to floors."""
    x = _binary_scores(counts_on_grid(df, keys, np.arange(0.05, 0.95, 0.01)))
    x = x.filter((F.col("recall") >= recall) & (F.col("precision") >= precision) & (F.col("f1_neg") >= f1_neg))
    x = x.withColumn("f1_macro", F.round("f1_macro", 12))
    return _pick(x, keys, [F.col("f1_macro")], ["f1_macro", "recall", "precision", "f1_neg"])


def grid_best_f1(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best F1 on 0.05, 0.10, .. 0.95; 0.5 when no threshold scores above zero."""
    x = _binary_scores(counts_on_grid(df, keys, np.arange(0.05, 0.96, 0.05)))
    best = _pick(x.withColumn("f1", F.round("f1", 12)), keys, [F.col("f1")], ["f1"])
    return best.withColumn("threshold", F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.5))


def max_f1_threshold(df: DataFrame, keys: Sequence[str], min_recall: float | None = None, legacy: bool = False) -> DataFrame:
    """Threshold of the best F1 on the precision-recall curve, optionally with a recall floor.

    Without a threshold that meets the floor, the one of highest recall is taken. `legacy`
    returns the next lower threshold, as an off-by-one reading of the curve does.
    """
    c = curve(df, keys)
    f1 = F.round(F.col("precision") * F.col("recall") * 2 / (F.col("precision") + F.col("recall") + 1e-9), 12)
    c = c.select(*keys, F.col("score").alias("threshold"), "recall", f1.alias("f1"))
    ok = F.lit(True) if min_recall is None else F.col("recall") >= min_recall
    pick = F.max(F.struct(ok.alias("ok"), F.when(ok, F.col("f1")).otherwise(F.col("recall")).alias("s"), (-F.col("threshold")).alias("nt"), "f1", "recall")).alias("m")
    best = c.groupBy(*keys).agg(pick).select(*keys, (-F.col("m.nt")).alias("threshold"), F.col("m.f1").alias("f1"), F.col("m.recall").alias("recall"))
    if not legacy:
        return best
    low = c.select(*keys, F.col("threshold").alias("_t")).join(best, list(keys)).filter(F.col("_t") < F.col("threshold"))
    low = low.groupBy(*keys).agg(F.max("_t").alias("_t"))
    return best.join(low, list(keys), "left").withColumn("threshold", F.coalesce("_t", "threshold")).drop("_t")


def cost_threshold(df: DataFrame, keys: Sequence[str], cost_fn: float, cost_fp: float, parts: int = 200) -> DataFrame:
    """Lowest expected cost over 0.5 and the score quantiles."""
    from .ordering import quantile_grid

    g = score_groups(df, keys).withColumn("cand", F.lit(0))
    q = quantile_grid(df, keys, "p", parts).select(*keys, F.col("quantile").alias("score"))
    half = g.select(*keys).distinct().withColumn("score", F.lit(0.5))
    cand = q.unionByName(half).distinct().select(*keys, "score", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit(1).alias("cand"))
    u = g.unionByName(cand)
    x = running(u, keys, -logit_bucket("score"), [F.desc("score"), F.col("cand")], {"tp": F.col("pos"), "fp": F.col("neg")})
    tot = g.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    x = x.filter("cand = 1").join(tot, list(keys))
    cost = F.round((F.lit(cost_fn) * (F.col("n_pos") - F.col("tp")) + F.lit(cost_fp) * F.col("fp")) / F.col("n"), 12)
    m = F.min(F.struct(cost.alias("cost"), F.col("score").alias("threshold"))).alias("m")
    return x.groupBy(*keys).agg(m).select(*keys, "m.threshold", "m.cost")


def coordinate_search(df: DataFrame, probs: Sequence[str], y: str = "y_true", step: float = 0.05, fallback: int = 1, rounds: int = 3) -> tuple[dict[int, float], float]:
    """Per-class thresholds by coordinate ascent of macro F1.

    A decision depends on a row only through the grid cell of each probability and their
    order, so the search runs on the counts of those combinations (bounded by the grid,
    not by the data) instead of on the rows.
    """
    grid = np.unique(np.append(np.arange(0.05, 1.0, step), 0.5))
    k = len(probs)
    edges = F.array(*[F.lit(float(v)) for v in grid])
    below = lambda c: F.size(F.filter(edges, lambda t: t <= F.col(c)))
    cells = [below(c).alias(f"c{i}") for i, c in enumerate(probs)]
    rank = [sum((F.when((F.col(o) > F.col(c)) | ((F.col(o) == F.col(c)) & F.lit(j < i)), 1).otherwise(0) for j, o in enumerate(probs)), F.lit(0)).alias(f"r{i}") for i, c in enumerate(probs)]
    h = df.groupBy(F.col(y).alias("t"), *cells, *rank).agg(F.count("*").alias("n")).toPandas()
    c = h[[f"c{i}" for i in range(k)]].to_numpy()
    r = h[[f"r{i}" for i in range(k)]].to_numpy()
    t, n = h["t"].to_numpy(), h["n"].to_numpy().astype(float)
    at = {float(v): i + 1 for i, v in enumerate(grid)}

    def score(thr: dict[int, float]) -> float:
        above = np.column_stack([c[:, i] >= at[thr[i]] for i in range(k)])
        pred = np.where(above.any(axis=1), np.where(above, r, k).argmin(axis=1), fallback)
        f = []
        for i in range(k):
            tp = n[(pred == i) & (t == i)].sum()
            den = n[pred == i].sum() + n[t == i].sum()
            f.append(round(2 * tp / den, 4) if den else 0.0)
        return round(float(np.mean(f)), 4)

    best = {i: 0.5 for i in range(k)}
    top = score(best)
    for _ in range(rounds):
        improved = False
        for i in range(k):
            for v in at:
                s = score({**best, i: v})
                if s > top:
                    best, top, improved = {**best, i: v}, s, True
        if not improved:
            break
    return best, top


# ---- distributions, drift, audits -------------------------------------------------------

def distribution(df: DataFrame, by: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Mean, population std, median, min, max, p10, p90 of a bounded metric table."""
    v = F.col(value)
    out = {
        "mean": F.avg(v), "std": F.stddev_pop(v), "median": F.percentile(v, F.lit(0.5)), "min": F.min(v), "max": F.max(v),
        "p10": F.percentile(v, F.lit(0.1)), "p90": F.percentile(v, F.lit(0.9))}
    return df.groupBy(*by).agg(*[F.coalesce(e, F.lit(0.0)).alias(prefix + n) for n, e in out.items()])


def drift(batch: DataFrame, fitted: DataFrame, feature: str = "feature", value: str = "value", limits: tuple[float, float] = (0.1, 0.15)) -> DataFrame:
    """Drift of each feature against its fitted mean and scale, and the verdict over all."""
    b = batch.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    x = b.join(fitted, feature).select(
        feature, (F.abs(F.col("_m") - F.col("mean")) / F.col("scale")).alias("mean_drift"), (F.abs(F.col("_s") - F.col("scale")) / F.col("scale")).alias("scale_drift"))
    ok = x.agg(F.coalesce(F.bool_and((F.col("mean_drift") < limits[0]) & (F.col("scale_drift") < limits[1])), F.lit(False)).alias("all_safe"))
    return x.join(F.broadcast(ok))  # one row


def feature_statistics(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Count, missing, mean, sample std, quartiles, IQR, min, max."""
    v = F.when(~F.isnan(value), F.col(value))
    a = df.groupBy(*by).agg(
        F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    q = percentiles(df.filter(~F.isnan(value)), by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return a.join(q, list(by), "left").withColumn("iqr", F.col("q3") - F.col("q1"))


def mutual_information(df: DataFrame, feature: str, value: str, label: str, bins: int = 20) -> DataFrame:
    """Mutual information of a binned feature with each label against the rest, natural log.

    One count per feature, bin and label serves all labels; rows without label or value take no part.
    """
    x = df.filter(F.col(label).isNotNull() & F.col(value).isNotNull())
    lim = x.groupBy(feature).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    cell = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width))).otherwise(0)
    h = x.join(lim, feature).groupBy(feature, cell.alias("_b"), label).agg(F.count("*").alias("_n"))
    cells = h.groupBy(feature, "_b").agg(F.sum("_n").alias("_px"), F.map_from_entries(F.collect_list(F.struct(label, "_n"))).alias("_in"))
    totals = h.groupBy(feature, label).agg(F.sum("_n").alias("_py"))
    t = F.sum("_py").over(W.partitionBy(feature))
    y = cells.join(totals.withColumn("_t", t), feature).withColumn("_n", F.coalesce(F.try_element_at("_in", F.col(label)), F.lit(0)))
    part = lambda n, py: F.when(n > 0, n / F.col("_t") * F.log(n * F.col("_t") / (F.col("_px") * py))).otherwise(0.0)
    both = part(F.col("_n"), F.col("_py")) + part(F.col("_px") - F.col("_n"), F.col("_t") - F.col("_py"))
    return y.groupBy(feature, label).agg(F.sum(both).alias("mi"))


def guarded_corr(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson correlation, null where either series does not vary."""
    return df.groupBy(*by).agg(
        F.when((F.stddev_pop(a) > 1e-8) & (F.stddev_pop(b) > 1e-8), F.corr(a, b)).alias("corr"), F.count("*").alias("n"))


def record_concentration(df: DataFrame, record: str, label: str, classes: Sequence[str], target: str) -> DataFrame:
    """Class counts per record, shares of the target class and their cumulative share."""
    from .ordering import group_size_bucket, hash_bucket, stable_hash

    n = df.groupBy(record).agg(F.count("*").alias("total"), *[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes])
    t = f"n_{target}"
    all_t = n.agg(F.sum(t).alias("_all"))
    # order: count descending, then a stable hash of the record
    h = stable_hash(record)
    x = n.withColumn("_h", h)
    bucket = group_size_bucket(t) * 4096 + hash_bucket(F.col("_h"))
    # only rows with equal counts may be ordered by hash, so the bucket keeps small counts apart
    x = running(x, [], F.when(F.col(t) <= 40, bucket).otherwise(group_size_bucket(t) * 4096), [F.desc(t), F.col("_h")], {"_cum": F.col(t)})
    x = x.join(F.broadcast(all_t))  # one row
    pct = lambda a, b: F.round(F.when(b > 0, a * 100.0 / b).otherwise(0.0), 4)
    return x.select(
        record, "total", *[f"n_{c}" for c in classes], pct(F.col(t), F.col("total")).alias("pct_within"), pct(F.col(t), F.col("_all")).alias("pct_of_all"),
        pct(F.col("_cum"), F.col("_all")).alias("pct_cumulative"))


def concentration_index(df: DataFrame, n: str) -> DataFrame:
    """Herfindahl index and largest share of positive counts."""
    x = df.filter(F.col(n) > 0)
    s = x.agg(F.sum(n).alias("_s"), F.sum(F.col(n).cast("double") * F.col(n)).alias("_q"), F.max(n).alias("_m"), F.count("*").alias("n_groups"))
    return s.select("n_groups", F.col("_s").alias("total"), (F.col("_q") / (F.col("_s").cast("double") * F.col("_s"))).alias("herfindahl"), (F.col("_m") / F.col("_s")).alias("top_share"))
