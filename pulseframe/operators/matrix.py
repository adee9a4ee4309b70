"""Experiment matrices: one row per candidate, fold and seed; ranking, gates and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .metrics import auroc_ap, class_report, distribution, pair_counts, percentiles, ratio


def cell_metrics(pred: DataFrame, by: Sequence[str], ps: Sequence[str], names: Sequence[str], target: int) -> DataFrame:
    """F1 per class, macro F1, and precision, recall, AP of the target class per cell."""
    rep = class_report(pair_counts(pred, by), by, len(names), digits=None)
    at = lambda c, col: F.max(F.when(F.col("class") == c, F.col(col)))
    t = names[target]
    wide = rep.groupBy(*by).agg(
        *[at(i, "f1").alias(f"F1_{n}") for i, n in enumerate(names)], F.avg("f1").alias("macro_F1"),
        at(target, "ppv").alias(f"precision_{t}"), at(target, "se").alias(f"recall_{t}"),
        (at(target, "tp") + at(target, "fn")).alias(f"{t}_support"))
    one = pred.select(*by, F.col(ps[target]).alias("p"), F.when(F.col("y_true") == target, 1).otherwise(0).alias("y"))
    ap = auroc_ap(one, by).select(*by, F.coalesce("auc_pr", F.lit(0.0)).alias(f"AP_{t}"))
    return wide.join(ap, list(by))


def scope_f1(pred: DataFrame, by: Sequence[str], scopes: dict[str, Column], target: int) -> DataFrame:
    """Sample count, support and target F1 of named row sets, in one pass over the rows."""
    t, p = F.col("y_true") == target, F.col("y_pred") == target
    parts = []
    for s, c in scopes.items():
        parts += [F.count_if(c).alias(f"n_{s}"), F.count_if(c & t).alias(f"support_{s}"), F.count_if(c & t & p).alias(f"_tp_{s}"), F.count_if(c & p).alias(f"_pp_{s}")]
    x = pred.groupBy(*by).agg(*parts)
    f = {f"F1_{s}": ratio(F.col(f"_tp_{s}") * 2, F.col(f"support_{s}") + F.col(f"_pp_{s}")) for s in scopes}
    return x.withColumns(f).drop(*[f"_{k}_{s}" for s in scopes for k in ("tp", "pp")])


def group_metrics(pred: DataFrame, group: str, target: int) -> DataFrame:
    """Per record or patient support, predictions and F1 of the target class."""
    t, p = F.col("y_true") == target, F.col("y_pred") == target
    x = pred.groupBy(group).agg(F.count("*").alias("n_samples"), F.count_if(t).alias("support"), F.count_if(p).alias("predicted"), F.count_if(t & p).alias("_tp"))
    return x.withColumn("f1", ratio(F.col("_tp") * 2, F.col("support") + F.col("predicted"))).drop("_tp")


def candidate_summary(cells: DataFrame, metrics: Sequence[str], target: str) -> DataFrame:
    """Distributions per candidate, runs and folds with a zero target F1."""
    d = None
    for m in metrics:
        x = distribution(cells, ["candidate"], m, f"{m}_")
        d = x if d is None else d.join(x, "candidate")
    z = cells.groupBy("candidate").agg(
        F.count("*").alias("run_count"), F.count_if(F.col(target) == 0).alias("zero_runs"),
        F.countDistinct(F.when(F.col(target) == 0, F.col("fold"))).alias("zero_folds"))
    return z.join(d, "candidate")


def paired(cells: DataFrame, control: str, metric: str) -> DataFrame:
    """Gain of every candidate over the control at the same fold and seed."""
    c = cells.filter(F.col("candidate") == control).select("fold", "seed", F.col(metric).alias("_c"))
    x = cells.filter(F.col("candidate") != control).join(c, ["fold", "seed"])
    return x.select("candidate", "fold", "seed", (F.col(metric) - F.col("_c")).alias("delta"))


def rank_candidates(summary: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Lexicographic ranking; the table has one row per candidate of the configuration."""
    return summary.withColumn("rank", F.row_number().over(W.orderBy(*keys, F.col("candidate"))))


def robust_gain(summary: DataFrame, material: float, min_macro: float) -> DataFrame:
    """A candidate replaces the control only if gain, macro F1 and the paired CI agree."""
    ok = (F.col("outside_gain") >= material) & (F.col("macro_F1_mean") >= min_macro) & (F.col("ci95_low") > 0) & (F.col("mean_delta") > F.col("std_delta"))
    return summary.withColumn("robust", F.coalesce(ok, F.lit(False)))


def seed_average(pred: DataFrame, sample: str, ps: Sequence[str], n_seeds: int) -> tuple[DataFrame, DataFrame]:
    """Mean probabilities over seeds with argmax, and the samples whose identity is broken."""
    x = pred.groupBy(sample).agg(
        F.min("patient_id").alias("patient_id"), F.min("y_true").alias("y_true"), *[F.avg(c).alias(c) for c in ps],
        F.count("*").alias("_n"), (F.min("patient_id") != F.max("patient_id")).alias("_p"), (F.min("y_true") != F.max("y_true")).alias("_y"))
    bad = F.col("_p") | F.col("_y") | (F.col("_n") != n_seeds)
    from ..functions.probability import argmax

    # a mean depends on the order of its rows in the last digits; classes that are equal to 12 digits are ties, and the first wins
    good = x.filter(~bad).withColumn("y_pred", argmax([F.round(c, 12) for c in ps])).drop("_n", "_p", "_y")
    return good, x.filter(bad).select(sample, F.col("_n").alias("n"))


def instability(pred: DataFrame, sample: str, p: str) -> DataFrame:
    """Spread of a probability over seeds; its percentiles and the label disagreement rate."""
    s = pred.groupBy(sample).agg((F.max(p) - F.min(p)).alias("spread"), (F.min("y_pred") != F.max("y_pred")).cast("double").alias("differs"))
    q = percentiles(s, [], "spread", {"median": 0.5, "p90": 0.9, "p95": 0.95})
    a = s.agg(F.count("*").alias("n"), F.avg("spread").alias("mean"), F.max("spread").alias("max"), F.avg("differs").alias("any_seed_disagreement"))
    return a.join(F.broadcast(q))  # one row each


def pairwise_disagreement(pred: DataFrame, sample: str, classes: int) -> DataFrame:
    """Mean share of seed pairs that disagree, from label counts per sample."""
    n = pred.groupBy(sample).agg(F.count("*").alias("n"), *[F.count_if(F.col("y_pred") == c).alias(f"c{c}") for c in range(classes)])
    same = sum((F.col(f"c{c}") * (F.col(f"c{c}") - 1) for c in range(classes)), F.lit(0))
    pairs = F.col("n") * (F.col("n") - 1)
    return n.agg(F.avg(F.when(pairs > 0, F.lit(1.0) - same / pairs)).alias("pairwise_disagreement"))


def gate_table(folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Patient-wise, stability and calibration gates per key and whether everything of it may be published.

    Fixed values: mean F1 limits S 0.55, V 0.70, F 0.50, macro 0.45.
    """
    a = folds.groupBy(*by).agg(
        F.avg("F1_S").alias("s"), F.avg("F1_V").alias("v"), F.avg("F1_F").alias("f"), F.avg("macro_F1").alias("macro"),
        F.stddev_pop("F1_F").alias("f_std"), F.min("F1_F").alias("f_min"), F.avg("log_loss").alias("ll"), F.avg("brier").alias("br"))
    rows = [
        ("patientwise", (F.col("f") >= 0.50) & (F.col("f_min") >= 0.0) & (F.col("macro") >= 0.45) & (F.col("s") >= 0.55) & (F.col("v") >= 0.70), False, F.col("macro")),
        ("stability", F.lit(True), False, F.col("f_std")),
        ("calibration", F.lit(True), False, F.col("ll")),
        ("smoke", (F.col("s") >= 0.55) & (F.col("v") >= 0.70) & (F.col("f") >= 0.50) & (F.col("macro") >= 0.45), True, F.col("macro")),
    ]
    g = a.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), ok.alias("passed"), F.lit(d).alias("diagnostic"), v.alias("value")) for n, ok, d, v in rows])))
    # four rows a key
    return g.withColumn("can_publish", F.bool_and(F.col("passed") | F.col("diagnostic")).over(W.partitionBy(*by)))


def with_limits(folds: DataFrame, max_std: float | None, max_log_loss: float | None, max_brier: float | None, by: Sequence[str] = ()) -> DataFrame:
    """Optional limits of the stability and calibration gates."""
    a = folds.groupBy(*by).agg(F.stddev_pop("F1_F").alias("f_std"), F.avg("log_loss").alias("mean_log_loss"), F.avg("brier").alias("mean_brier"))
    chk = lambda c, lim: F.lit(True) if lim is None else ~(F.col(c) > lim)
    return a.withColumn("stability", chk("f_std", max_std)).withColumn("calibration", chk("mean_log_loss", max_log_loss) & chk("mean_brier", max_brier))


def best_fold(folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best macro F1 among passing folds of a key, else the best penalized score.

    Fixed values: F1 limits S 0.55, V 0.70, F 0.50 and macro 0.45; penalty weight 2.
    """
    ok = (F.col("F1_S") >= 0.55) & (F.col("F1_V") >= 0.70) & (F.col("F1_F") >= 0.50) & (F.col("macro_F1") >= 0.45)
    short = lambda c, lim: F.greatest(F.lit(0.0), F.lit(lim) - F.col(c))
    pen = short("F1_S", 0.55) + short("F1_V", 0.70) + short("F1_F", 0.50)
    score = F.when(ok, F.col("macro_F1")).otherwise(F.col("macro_F1") - pen * 2.0)
    m = F.max(F.struct(ok.alias("passed"), F.round(score, 12).alias("score"), (-F.col("fold")).alias("nf"))).alias("m")
    return folds.groupBy(*by).agg(m).select(*by, (-F.col("m.nf")).alias("fold"), "m.passed", "m.score")


def collapse_class(pred: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Why the target class fails in a fold, from its true rows and the per-seed F1."""
    m = cells.groupBy(*by).agg(F.max("F1_F").alias("_hi"), F.min("F1_F").alias("_lo"))
    x = pred.filter("y_true = 2").groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("y_pred") == c).alias(f"_n{c}") for c in range(3)],
        F.avg(F.when(F.col("margin") < 0, 1.0).otherwise(0.0)).alias("_neg"))
    s, v, f = F.col("_n0"), F.col("_n1"), F.col("_n2")
    why = (
        F.when(F.col("n").isNull(), "NO_TRAIN_SUPPORT")
        .when((F.col("_hi") > 0) & (F.col("_lo") == 0), "OPTIMIZATION_COLLAPSE")
        .when((v > s) & (v > f), "F_TO_V_CONFUSION").when((s > v) & (s > f), "F_TO_S_CONFUSION")
        .when(F.col("_neg") >= 0.75, "REPRESENTATION_OVERLAP").otherwise("INCONCLUSIVE"))
    return m.join(x, list(by), "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), why.alias("reason"))


def hypothesis_verdict(summary: DataFrame, baseline: str, target_f1: float, material: float, min_macro: float) -> DataFrame:
    """Target met, material gain outside the named groups and macro gate per candidate."""
    b = summary.filter(F.col("candidate") == baseline).select(F.col("F1_outside_mean").alias("_b"))
    x = summary.filter(F.col("candidate") != baseline).join(F.broadcast(b))  # one row
    x = x.withColumns({
        "target_met": F.col("F1_F_mean") >= target_f1, "material_gain": F.col("F1_outside_mean") - F.col("_b") >= material, "macro_gate": F.col("macro_F1_mean") >= min_macro})
    ok = F.col("target_met") & F.col("material_gain") & F.col("macro_gate")
    return x.select("candidate", "target_met", "material_gain", "macro_gate", F.when(ok, "SUPPORTED").otherwise("NOT_SUFFICIENT").alias("result"))


def reconcile(new: DataFrame, old: DataFrame, key: str = "metric", tol: float = 1e-6) -> DataFrame:
    """Differences of two metric tables, including metrics present on one side only."""
    x = new.select(key, F.col("value").alias("new")).join(old.select(key, F.col("value").alias("old")), key, "full")
    return x.withColumn("difference", F.abs(F.col("new") - F.col("old"))).withColumn("agrees", F.coalesce(F.col("difference") <= tol, F.lit(False)))


def history_summary(h: DataFrame, by: Sequence[str], epoch: str, value: str, mode: str = "max") -> DataFrame:
    """Best epoch, first and last value, number of decreases, spread and linear trend."""
    from .ordering import shifted

    x = shifted(h, by, F.floor(F.col(epoch) / 4096), [F.col(epoch)], {"_pv": (value, 1)})
    sign = 1 if mode == "max" else -1
    best = F.max(F.struct((F.col(value) * sign).alias("v"), (-F.col(epoch)).alias("e")))
    return x.groupBy(*by).agg(
        (-best["e"]).alias("best_epoch"), (best["v"] * sign).alias("best_value"),
        F.min_by(value, epoch).alias("first"), F.max_by(value, epoch).alias("last"),
        F.count_if(F.col(value) < F.col("_pv")).alias("decreases"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.coalesce(F.regr_slope(value, epoch), F.lit(0.0)).alias("trend"))


def run_comparison(runs: DataFrame, issues: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run with issue counts by severity."""
    n = issues.groupBy(run).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "warning", "info")])
    return runs.join(n, run, "left").fillna(0, ["n_critical", "n_warning", "n_info"])


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max, mean, std of the finite values and counts of NaN and infinite ones."""
    x = df.unpivot([], [c for c in columns], "column", "v").withColumn("v", F.col("v").cast("double"))
    inf = F.abs("v") == F.lit(float("inf"))
    ok = F.when(~F.isnan("v") & ~inf, F.col("v"))
    return x.groupBy("column").agg(
        F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"),
        F.count_if(F.isnan("v")).alias("nan_count"), F.count_if(inf).alias("inf_count"))


def two_stage(df: DataFrame, y: str, stage1: str, threshold: float, stage2_pred: str) -> dict[str, DataFrame]:
    """Binary, three-class and integrated four-class rows."""
    from ..functions.probability import cascade

    s1 = F.when(F.col(stage1) >= threshold, 1).otherwise(0)
    binary = df.select(F.when(F.col(y) == 0, 0).otherwise(1).alias("y_true"), s1.alias("y_pred"))
    three = df.filter(F.col(y).isin(1, 2, 3)).select((F.col(y) - 1).alias("y_true"), F.col(stage2_pred).alias("y_pred"))
    four = df.filter(F.col(y) != 4).select(F.col(y).alias("y_true"), cascade(F.col(stage1), threshold, F.col(stage2_pred)).alias("y_pred"))
    return {"stage1": binary, "stage2": three, "integrated": four}


def fold_losses(pred: DataFrame, by: Sequence[str], ps: Sequence[str]) -> DataFrame:
    """Multi-class log loss and mean one-vs-rest Brier score per cell."""
    own = F.coalesce(*[F.when(F.col("y_true") == i, F.col(c)) for i, c in enumerate(ps)])
    br = [(F.col(c) - F.when(F.col("y_true") == i, 1.0).otherwise(0.0)) for i, c in enumerate(ps)]
    mean_sq = sum((b * b for b in br), F.lit(0.0)) / float(len(ps))
    return pred.groupBy(*by).agg((-F.avg(F.log(F.greatest(own, F.lit(1e-12))))).alias("log_loss"), F.avg(mean_sq).alias("brier"))


