"""Evaluation, calibration, threshold, bootstrap and matrix queries over labelled documents."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from ..functions import probability as P
from ..operators import calibration as C, matrix as X, metrics as M, resampling as RS
from . import bindings as B
from .registry import Registry

R = Registry()
PS = ["p0", "p1", "p2"]
NAMES = ["S", "V", "F"]
CELL = ["fold", "seed"]


def rounded(df, digits: int = 6, skip: tuple = ()):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float") and c not in skip})


BASE = f"WITH {B.PREDICTION_SQL}"
LONG = f"WITH {B.PREDICTION_SQL}, {B.MULTILABEL_SQL}"
CM = f"""{BASE},
 cm AS (SELECT fold, seed, y_true AS t, y_pred AS p, count(*) AS n FROM scored GROUP BY ALL),
 ovr AS (SELECT fold, seed, class, CAST(sum(CASE WHEN t = class AND p = class THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN t = class AND p <> class THEN n ELSE 0 END) AS BIGINT) AS fn,
   CAST(sum(CASE WHEN t <> class AND p = class THEN n ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN t <> class AND p <> class THEN n ELSE 0 END) AS BIGINT) AS tn
   FROM cm, (SELECT unnest([0, 1, 2]) AS class) GROUP BY fold, seed, class),
 rr AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS se, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS ppv,
   CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END AS fpr, CASE WHEN fp + tn > 0 THEN tn::DOUBLE / (fp + tn) ELSE 0 END AS spe FROM ovr),
 rep AS (SELECT *, CASE WHEN se + ppv > 0 THEN 2 * se * ppv / (se + ppv) ELSE 0 END AS f1 FROM rr)"""
GLOB = f"""{CM},
 gg AS (SELECT fold, seed, sum(tp) AS c, max(tp + fn + fp + tn)::DOUBLE AS s, sum((tp + fn) * (tp + fp)) AS tq, sum((tp + fn) * (tp + fn)) AS tt, sum((tp + fp) * (tp + fp)) AS qq,
   sum(fp)::DOUBLE AS sfp, sum(tn) AS stn, avg(round(f1, 4)) AS f1m, bool_or(round(se, 4) < 0.1) AS short FROM rep GROUP BY ALL),
 gl AS (SELECT fold, seed, round(c / s, 4) AS acc, round(f1m, 4) AS f1_macro,
   round(CASE WHEN sqrt((s*s - qq) * (s*s - tt)) <> 0 THEN (c*s - tq) / sqrt((s*s - qq) * (s*s - tt)) ELSE 0 END, 4) AS mcc, round(sfp / (sfp + stn), 4) AS fpr_global,
   (c / s > 0.3 AND f1m > 0.3 AND CASE WHEN sqrt((s*s - qq) * (s*s - tt)) <> 0 THEN (c*s - tq) / sqrt((s*s - qq) * (s*s - tt)) ELSE 0 END > 0.0 AND sfp / (sfp + stn) < 0.5 AND NOT short) AS passed FROM gg)"""
GATE = {"acc": 0.3, "f1_macro": 0.3, "mcc": 0.0, "fpr_global": 0.5, "se": {0: 0.1, 1: 0.1, 2: 0.1}}


def _pairs(spark, sf):
    return M.pair_counts(B.scored(spark, sf), CELL)


@R.add("a8_class_report", f"{CM} SELECT fold, seed, class, tp, fn, fp, tn, round(se, 4) AS se, round(ppv, 4) AS ppv, round(fpr, 4) AS fpr, round(spe, 4) AS spe, round(f1, 4) AS f1 FROM rep")
def a8(spark, sf):
    return M.class_report(_pairs(spark, sf), CELL, 3)


@R.add("a8_global_report", f"{GLOB} SELECT * FROM gl")
def a8g(spark, sf):
    return M.global_report(_pairs(spark, sf), CELL, 3, GATE)


@R.add("a7_metric_rows", f"""{GLOB},
 g AS (UNPIVOT (SELECT fold, seed, acc, f1_macro, mcc, fpr_global, passed::INT::DOUBLE AS passed FROM gl) ON acc, f1_macro, mcc, fpr_global, passed INTO NAME name VALUE value),
 c AS (UNPIVOT (SELECT fold, seed, ['S','V','F'][class + 1] AS class_name, tp::DOUBLE AS tp, fn::DOUBLE AS fn, fp::DOUBLE AS fp, tn::DOUBLE AS tn, round(se, 4) AS se, round(ppv, 4) AS ppv, round(fpr, 4) AS fpr, round(spe, 4) AS spe, round(f1, 4) AS f1 FROM rep)
   ON tp, fn, fp, tn, se, ppv, fpr, spe, f1 INTO NAME name VALUE value)
SELECT fold, seed, 'global' AS namespace, 'ev_' || name AS name, NULL AS class_name, value FROM g UNION ALL SELECT fold, seed, 'per_class', 'ev_' || name, class_name, value FROM c""")
def a7(spark, sf):
    p = _pairs(spark, sf)
    return M.metric_rows(M.class_report(p, CELL, 3), M.global_report(p, CELL, 3, GATE), CELL, NAMES, "ev_")


@R.add("a7_gate_alerts", f"{GLOB} SELECT fold, seed, 'warning' AS severity, 'qg_failure' AS category, 'stage2 gate not met' AS message, 0.0::DOUBLE AS metric_value FROM gl WHERE NOT passed")
def a7b(spark, sf):
    return M.gate_alerts(M.global_report(_pairs(spark, sf), CELL, 3, GATE), CELL, "stage2")


CURVE = f"""{LONG},
 g AS (SELECT class, p AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM multilabel GROUP BY ALL),
 tot AS (SELECT class, sum(pos) AS np, sum(neg) AS nn FROM g GROUP BY 1),
 cv AS (SELECT g.*, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, np, nn FROM g JOIN tot USING (class) WINDOW w AS (PARTITION BY g.class ORDER BY score DESC)),
 auc AS (SELECT class, sum(neg * (tp - pos / 2.0)) / (max(np) * max(nn)) AS auc_roc, sum(pos * tp::DOUBLE / (tp + fp)) / max(np) AS auc_pr, max(np) AS np, max(nn) AS nn FROM cv GROUP BY 1)"""


@R.add("w5_auroc_ap", f"{CURVE} SELECT class, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg, round(auc_roc, 6) AS auc_roc, round(auc_pr, 6) AS auc_pr FROM auc")
def w5(spark, sf):
    return rounded(M.auroc_ap(B.multilabel(spark, sf), ["class"]))


@R.add("w6_pr_curve", f"{CURVE} SELECT class, round(score, 9) AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / np, 6) AS recall FROM cv")
def w6(spark, sf):
    c = M.curve(B.multilabel(spark, sf), ["class"])
    return c.select("class", F.round("score", 9).alias("score"), "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


PRF_SQL = """SELECT class, count(*) FILTER (y = 1 AND {d}) AS tp, count(*) FILTER (y = 0 AND {d}) AS fp, count(*) FILTER (y = 0 AND NOT ({d})) AS tn, count(*) FILTER (y = 1 AND NOT ({d})) AS fn FROM multilabel GROUP BY 1"""
PRF_COLS = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


@R.add("a9_multilabel_report", f"{CURVE}, b AS ({PRF_SQL.format(d='p >= 0.4')}) SELECT class, CAST(np AS BIGINT) AS support, round(auc_roc, 6) AS auc_roc, round(auc_pr, 6) AS auc_pr, tp, fp, tn, fn, {PRF_COLS} FROM auc JOIN b USING (class)")
def a9(spark, sf):
    return rounded(M.multilabel_report(B.multilabel(spark, sf), 0.4))


@R.add("a9_macro", f"{CURVE} SELECT round(avg(auc_roc), 6) AS macro_auc_roc, round(avg(auc_pr), 6) AS macro_auc_pr FROM auc")
def a9m(spark, sf):
    return rounded(M.macro(M.auroc_ap(B.multilabel(spark, sf), ["class"]), ["auc_roc", "auc_pr"]))


@R.add("a10_class_thresholds", f"""{LONG}, b AS ({PRF_SQL.format(d="p >= CASE class WHEN 'quality' THEN 0.3 ELSE 0.45 END")}) SELECT class, CASE class WHEN 'quality' THEN 0.3::DOUBLE ELSE 0.45::DOUBLE END AS threshold, tp, fp, tn, fn, {PRF_COLS} FROM b""")
def a10(spark, sf):
    return rounded(M.at_thresholds(B.multilabel(spark, sf), {"quality": 0.3, "toxic": 0.45}))


LOSS_SQL = "SELECT class, -avg(CASE WHEN y = 1 THEN ln(greatest(1e-7, least(1 - 1e-7, p))) ELSE ln(1.0 - greatest(1e-7, least(1 - 1e-7, p))) END) AS nll, avg((p - y) * (p - y)) AS brier, CAST(sum(y) AS BIGINT) AS support, count(*) AS n FROM multilabel GROUP BY 1"


@R.add("a11_losses", f"{LONG}, l AS ({LOSS_SQL}) SELECT class, round(nll, 6) AS nll, round(brier, 6) AS brier, support, n FROM l")
def a11(spark, sf):
    return rounded(M.losses(B.multilabel(spark, sf), ["class"]))


def bins_sql(n: int, src: str = "multilabel", by: str = "class") -> str:
    return f"""SELECT {by}, least({n - 1}, CAST(list_sum(list_transform(range(1, {n}), lambda i: (p >= i * (1.0::DOUBLE / {n}::DOUBLE))::INT)) AS INT)) AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM {src} GROUP BY ALL"""


@R.add("a12_reliability", f"{LONG}, r AS ({bins_sql(15)}) SELECT class, bin, n, round(acc, 6) AS acc, round(conf, 6) AS conf FROM r")
def a12(spark, sf):
    return rounded(C.reliability(B.multilabel(spark, sf), ["class"]))


@R.add("a12_calibration_report", f"""{LONG}, r AS ({bins_sql(15)}), e AS (SELECT class, sum(n * abs(acc - conf)) / sum(n) AS ece, max(abs(acc - conf)) AS mce FROM r GROUP BY 1), l AS ({LOSS_SQL})
SELECT class, round(ece, 6) AS ece, round(mce, 6) AS mce, round(brier, 6) AS brier, round(nll, 6) AS nll, n, support FROM e JOIN l USING (class)""")
def a12b(spark, sf):
    return rounded(C.report(B.multilabel(spark, sf)))


@R.add("a13_stratum_ece", f"""{LONG}, m AS (SELECT * FROM multilabel WHERE fold <> 0), r AS ({bins_sql(15, 'm')}) SELECT class, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, round(max(abs(acc - conf)), 6) AS mce FROM r GROUP BY 1""")
def a13(spark, sf):
    m = B.multilabel(spark, sf).filter("fold <> 0")
    return rounded(C.errors(C.reliability(m, ["class"]), ["class"]))


@R.add("a14_full_bins", f"""{LONG}, r AS ({bins_sql(10)}), k AS (SELECT DISTINCT class FROM multilabel), b AS (SELECT class, CAST(bin AS INTEGER) AS bin FROM k, (SELECT unnest(range(0, 10)) AS bin))
SELECT b.class, b.bin, coalesce(r.n, 0) AS n, round(acc, 6) AS acc, round(conf, 6) AS conf FROM b LEFT JOIN r ON r.class = b.class AND r.bin = b.bin""")
def a14(spark, sf):
    return rounded(C.full_bins(B.multilabel(spark, sf), ["class"]))


def grid_sql(start: str, n: int, step: str, src: str = "multilabel", by: str = "class") -> str:
    return f"""grid AS (SELECT {start}::DOUBLE + i * {step}::DOUBLE AS thr FROM (SELECT unnest(range(0, {n})) AS i)),
 k AS (SELECT {by}, thr, count(*) FILTER (y = 1 AND p >= thr) AS tp, count(*) FILTER (y <> 1 AND p >= thr) AS fp, count(*) FILTER (y <> 1 AND NOT p >= thr) AS tn, count(*) FILTER (y = 1 AND NOT p >= thr) AS fn FROM {src}, grid GROUP BY ALL),
 s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS rc, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS spe,
   CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END AS f1n, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS acc,
   CASE WHEN (tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp::DOUBLE*tn - fp::DOUBLE*fn) / sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END AS mcc FROM k)"""


@R.add("a14_grid_best_f1", f"""{LONG}, {grid_sql('0.05', 19, '0.05')} SELECT class, round(CASE WHEN max(f1) > 0 THEN arg_max(thr, row(round(f1, 12), -thr)) ELSE 0.5 END, 6) AS threshold, round(max(f1), 6) AS f1 FROM s GROUP BY 1""")
def a14b(spark, sf):
    return rounded(M.grid_best_f1(B.multilabel(spark, sf), ["class"]))


@R.add("a15_top_label", f"""{BASE}, tl AS (SELECT seed, greatest(p0, p1, p2) AS p, (y_true = y_pred)::INT AS y, (p0 - (y_true = 0)::INT) ** 2 + (p1 - (y_true = 1)::INT) ** 2 + (p2 - (y_true = 2)::INT) ** 2 AS b FROM scored),
 r AS ({bins_sql(10, 'tl', 'seed')}), e AS (SELECT seed, sum(n * abs(acc - conf)) / sum(n) AS ece, max(abs(acc - conf)) AS mce FROM r GROUP BY 1)
SELECT seed, round(ece, 6) AS ece, round(mce, 6) AS mce, round(brier, 6) AS brier FROM e JOIN (SELECT seed, avg(b) AS brier FROM tl GROUP BY 1) USING (seed)""")
def a15(spark, sf):
    return rounded(C.top_label(B.scored(spark, sf), ["seed"], PS))


@R.add("a15_per_true_class", f"""{BASE} SELECT y_true AS class, round(avg((1 - CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) ** 2), 6) AS brier, round(avg(greatest(p0, p1, p2)), 6) AS confidence FROM scored GROUP BY 1""")
def a15b(spark, sf):
    return rounded(C.per_true_class(B.scored(spark, sf), PS))


@R.add("a16_group_recall", f"""{BASE} SELECT patient_id, {', '.join(f"round(count(*) FILTER (y_true = {c} AND y_pred = {c})::DOUBLE / nullif(count(*) FILTER (y_true = {c}), 0), 6) AS recall_{c}" for c in range(3))}, count(*) AS support FROM scored GROUP BY 1""")
def a16(spark, sf):
    return rounded(M.group_recall(B.scored(spark, sf), "patient_id", 3))


@R.add("a17_confusion_norm", f"""{CM}, nm AS (SELECT *, n / (sum(n) OVER (PARTITION BY fold, seed, t) + 1e-9) AS share FROM cm)
SELECT rep.fold, rep.seed, rep.class, round(se, 6) AS recall, round(ppv, 6) AS precision, round(coalesce((SELECT max(share) FROM nm WHERE nm.fold = rep.fold AND nm.seed = rep.seed AND nm.p = rep.class), 0), 6) AS precision_simplified FROM rep""")
def a17(spark, sf):
    return rounded(M.confusion_summary(_pairs(spark, sf), CELL, 3))


@R.add("a18_feature_drift", f"""WITH {B.FEATURE_SQL}, f AS (SELECT dim, avg(value) AS m, stddev_pop(value) AS s FROM feature WHERE label < 5 GROUP BY 1), b AS (SELECT dim, avg(value) AS m, stddev_pop(value) AS s FROM feature WHERE label >= 5 GROUP BY 1),
 d AS (SELECT CAST(b.dim AS INTEGER) AS feature, abs(b.m - f.m) / f.s AS mean_drift, abs(b.s - f.s) / f.s AS scale_drift FROM b JOIN f USING (dim))
SELECT feature, round(mean_drift, 6) AS mean_drift, round(scale_drift, 6) AS scale_drift, (SELECT bool_and(mean_drift < 0.1 AND scale_drift < 0.15) FROM d) AS all_safe FROM d""")
def a18(spark, sf):
    x = B.features(spark, sf).withColumnRenamed("dim", "feature")
    fitted = x.filter("label < 5").groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"))
    return rounded(M.drift(x.filter("label >= 5"), fitted))


# ---- thresholds -------------------------------------------------------------------------

@R.add("a25_gated_threshold", f"""{LONG}, {grid_sql('0.01', 99, '0.01')}, z AS (SELECT *, round((round(f1, 4) + round(f1n, 4)) / 2, 4) AS fm, (acc > 0.5 AND (f1 + f1n) / 2 > 0.4 AND mcc > 0.01 AND 1 - acc < 0.5) AS ok FROM s)
SELECT class, round(arg_max(thr, row(ok, fm, -thr)), 6) AS threshold, max(ok) AS passed, arg_max(fm, row(ok, fm, -thr)) AS f1_macro FROM z GROUP BY 1""")
def a25(spark, sf):
    return rounded(M.best_gated_threshold(B.multilabel(spark, sf), ["class"], {"acc": 0.5, "f1_macro": 0.4, "mcc": 0.01, "fpr_global": 0.5}))


@R.add("a25_youden", f"{LONG}, {grid_sql('0.01', 99, '0.01')} SELECT class, round(arg_max(thr, row(round(rc + spe - 1, 12), -thr)), 6) AS threshold, round(max(rc + spe - 1), 6) AS j FROM s GROUP BY 1")
def a25y(spark, sf):
    return rounded(M.youden_threshold(B.multilabel(spark, sf), ["class"]))


F1C = f"{CURVE}, f AS (SELECT class, score, tp::DOUBLE / np AS recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / np) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / np + 1e-9), 12) AS f1 FROM cv)"


@R.add("a25_max_f1", f"{F1C} SELECT class, round(arg_max(score, row(f1, -score)), 9) AS threshold, round(max(f1), 6) AS f1, round(arg_max(recall, row(f1, -score)), 6) AS recall FROM f GROUP BY 1")
def a25f(spark, sf):
    return rounded(M.max_f1_threshold(B.multilabel(spark, sf), ["class"]), 6, ("threshold",)).withColumn("threshold", F.round("threshold", 9))


@R.add("a25_min_recall", f"{F1C} SELECT class, round(arg_max(score, row(f1, -score)), 9) AS threshold, round(max(f1), 6) AS f1, round(arg_max(recall, row(f1, -score)), 6) AS recall FROM f WHERE recall >= 0.6 GROUP BY 1")
def a25r(spark, sf):
    return rounded(M.max_f1_threshold(B.multilabel(spark, sf), ["class"], min_recall=0.6), 6, ("threshold",)).withColumn("threshold", F.round("threshold", 9))


@R.add("a25_cost", f"""{LONG}, qs AS (SELECT class, unnest(quantile_cont(p, list_transform(range(0, 201), lambda i: i / 200.0::DOUBLE))) AS thr FROM multilabel GROUP BY 1 UNION ALL SELECT DISTINCT class, 0.5 FROM multilabel),
 k AS (SELECT m.class, thr, round((5.0 * count(*) FILTER (y = 1 AND p < thr) + 1.0 * count(*) FILTER (y = 0 AND p >= thr)) / count(*), 12) AS cost FROM multilabel m JOIN (SELECT DISTINCT * FROM qs) q ON q.class = m.class GROUP BY ALL)
SELECT class, round(arg_min(thr, row(cost, thr)), 6) AS threshold, round(min(cost), 6) AS cost FROM k GROUP BY 1""")
def a25c(spark, sf):
    return rounded(M.cost_threshold(B.multilabel(spark, sf), ["class"], 5.0, 1.0))


@R.add("a25_coordinate")
def a25k(spark, sf):
    s = B.scored(spark, sf)
    thr, top = M.coordinate_search(s, PS)
    return M.class_report(M.pair_counts(s.withColumn("y_pred", P.decide_over([F.col(c) for c in PS], [thr[i] for i in range(3)], 1))), [], 3).withColumn("f1_macro", F.lit(top))


@R.add("a54_constrained_threshold", f"""{LONG}, {grid_sql('0.05', 90, '((0.05::DOUBLE + 0.01::DOUBLE) - 0.05::DOUBLE)')} SELECT class, round(arg_max(thr, row(round((f1 + f1n) / 2, 12), -thr)), 6) AS threshold, round(max((f1 + f1n) / 2), 6) AS f1_macro,
 round(arg_max(rc, row(round((f1 + f1n) / 2, 12), -thr)), 6) AS recall, round(arg_max(pr, row(round((f1 + f1n) / 2, 12), -thr)), 6) AS precision, round(arg_max(f1n, row(round((f1 + f1n) / 2, 12), -thr)), 6) AS f1_neg
 FROM s WHERE rc >= 0.2 AND pr >= 0.1 AND f1n >= 0.3 GROUP BY 1""")
def a54(spark, sf):
    return rounded(M.constrained_threshold(B.multilabel(spark, sf), ["class"], 0.2, 0.1, 0.3))


# ---- decisions --------------------------------------------------------------------------



def _c():
    return [F.col(p) for p in PS]


@R.add("p28_probability_maps", f"""{BASE}, z AS (SELECT sample_id, seed, ln(p0 / (1 - p0)) AS z, ln(p0) / 0.7 AS a, ln(p1) / 0.7 AS b, ln(p2) / 0.7 AS c, p0 FROM scored)
SELECT sample_id, seed, round(1 / (1 + exp(-greatest(-30, least(30, z / 1.7)))), 9) AS temperature, round(1 / (1 + exp(-(0.8 * z + 0.1))), 9) AS platt,
 round(1 / (1 + exp(-(1.1 * ln(p0) - 0.9 * ln(1 - p0) + 0.05))), 9) AS beta, round(exp(a) / (exp(a) + exp(b) + exp(c)), 9) AS softmax0 FROM z""")
def p28(spark, sf):
    s = B.scored(spark, sf)
    p = F.col("p0")
    return rounded(s.select("sample_id", "seed", P.temperature(p, 1.7).alias("temperature"), P.platt(p, 0.8, 0.1).alias("platt"), P.beta(p, 1.1, 0.9, 0.05).alias("beta"),
                            P.multiclass(_c(), "temperature", t=0.7)[0].alias("softmax0")), 9)


@R.add("p29_margin", f"{BASE} SELECT sample_id, seed, round(ln(p2) - greatest(ln(p0), ln(p1)), 9) AS margin FROM scored")
def p29(spark, sf):
    return rounded(B.scored(spark, sf).select("sample_id", "seed", P.log_margin(F.col("p2"), [F.col("p0"), F.col("p1")]).alias("margin")), 9)


@R.add("p30_p32_decisions", f"""{BASE} SELECT sample_id, seed, CASE WHEN p0 >= 0.4 THEN 1 ELSE 0 END AS multilabel, CASE WHEN p2 >= 0.35 THEN 2 WHEN p1 >= 0.3 THEN 1 ELSE 0 END AS last_over,
 CASE WHEN p0 >= 0.4 OR p1 >= 0.3 OR p2 >= 0.35 THEN CASE WHEN p0 >= 0.4 AND p0 >= CASE WHEN p1 >= 0.3 THEN p1 ELSE -1 END AND p0 >= CASE WHEN p2 >= 0.35 THEN p2 ELSE -1 END THEN 0
   WHEN p1 >= 0.3 AND p1 >= CASE WHEN p2 >= 0.35 THEN p2 ELSE -1 END THEN 1 ELSE 2 END ELSE CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END END AS most_over FROM scored""")
def p30(spark, sf):
    t = [0.4, 0.3, 0.35]
    return B.scored(spark, sf).select("sample_id", "seed", P.decide_multilabel(F.col("p0"), 0.4).alias("multilabel"), P.decide_last(_c(), t).alias("last_over"), P.decide_over(_c(), t).alias("most_over"))


@R.add("p33_cascade", f"{BASE} SELECT sample_id, seed, CASE WHEN 1 - p0 >= 0.6 THEN y_pred + 1 ELSE 0 END AS label FROM scored")
def p33(spark, sf):
    return B.scored(spark, sf).select("sample_id", "seed", P.cascade(F.lit(1.0) - F.col("p0"), 0.6, F.col("y_pred")).alias("label"))


@R.add("p34_ensemble", f"{BASE} SELECT sample_id, round(sum(p0 * (seed + 1) / 10.0) / sum((seed + 1) / 10.0), 9) AS p FROM scored GROUP BY 1")
def p34(spark, sf):
    s = B.scored(spark, sf).withColumn("w", (F.col("seed") + 1) / 10.0)
    return rounded(P.ensemble(s, ["sample_id"], "p0", "w"), 9)


@R.add("p35_quantize", """WITH q AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(greatest(-128, least(127, round_even(CAST(v AS DOUBLE) / 0.002::DOUBLE, 0) + 3)) AS INT)) AS q FROM embeddings)
SELECT vec_id, CAST(len(list_filter(q, lambda v: v = -128 OR v = 127)) AS INT) AS n_saturated, CAST(list_sum(q) AS BIGINT) AS q_sum, round(list_sum(list_transform(q, lambda v: (v - 3) * 0.002::DOUBLE)), 6) AS x_sum FROM q""")
def p35(spark, sf):
    e = B.table(spark, sf, "embeddings").select("vec_id", P.quantize(F.transform("embedding", lambda v: v.cast("double")), 0.002, 3).alias("q"))
    return e.select("vec_id", P.saturated("q").alias("n_saturated"), F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + v).alias("q_sum"),
                    F.round(F.aggregate(P.dequantize(F.col("q"), 0.002, 3), F.lit(0.0), lambda a, v: a + v), 6).alias("x_sum"))


@R.add("p36_comparable", f"""WITH {B.RUN_SQL}, c AS (SELECT experiment_id, 'v' || fold_idx AS ev, run_type AS task FROM run)
SELECT a.experiment_id, CASE WHEN a.ev = b.ev AND a.task = b.task THEN 'COMPARABLE' ELSE 'NON_COMPARABLE' END AS status,
 concat_ws('; ', CASE WHEN a.ev <> b.ev THEN 'evaluator_version: ' || a.ev || ' != ' || b.ev END, CASE WHEN a.task <> b.task THEN 'task_profile: ' || a.task || ' != ' || b.task END) AS reasons
FROM (SELECT experiment_id, min(ev) AS ev, min(task) AS task FROM c GROUP BY 1) a JOIN (SELECT experiment_id, max(ev) AS ev, max(task) AS task FROM c GROUP BY 1) b USING (experiment_id)""")
def p36(spark, sf):
    c = B.run(spark, sf).select("experiment_id", F.concat(F.lit("v"), F.col("fold_idx")).alias("ev"), F.col("run_type").alias("task"))
    side = lambda f: F.struct(f("ev").alias("evaluator_version"), f("task").alias("task_profile"))
    x = c.groupBy("experiment_id").agg(side(F.min).alias("a"), side(F.max).alias("b"))
    return P.comparable(x, fields=["evaluator_version", "task_profile"]).select("experiment_id", "status", F.array_join("reasons", "; ").alias("reasons"))


# ---- bootstrap --------------------------------------------------------------------------

def _f1_macro(t: np.ndarray, p: np.ndarray, w: np.ndarray) -> float:
    f = []
    for c in range(3):
        tp = w[(t == c) & (p == c)].sum()
        d = w[t == c].sum() + w[p == c].sum()
        f.append(2 * tp / d if d else 0.0)
    return float(np.mean(f))


@R.add("a19_confusion_ci")
def a19(spark, sf):
    r = RS.confusion_ci(M.pair_counts(B.scored(spark, sf), ["seed"]), ["seed"], _f1_macro, 500)
    return RS.interval(r, ["seed"], "value")


@R.add("a19_auroc_ci")
def a19b(spark, sf):
    return RS.interval(RS.curve_ci(B.multilabel(spark, sf)), ["class"], "auc_roc")


CELLS_SQL = f"{CM}, cells AS (SELECT fold, seed, CAST(seed AS VARCHAR) AS candidate, avg(f1) AS macro_F1, max(CASE WHEN class = 2 THEN f1 END) AS F1_F, max(CASE WHEN class = 0 THEN f1 END) AS F1_S, max(CASE WHEN class = 1 THEN f1 END) AS F1_V FROM rep GROUP BY fold, seed)"


def _cells(spark, sf):
    """Cells with the seed acting as candidate: paired by fold."""
    c = X.cell_metrics(B.scored(spark, sf), CELL, PS, NAMES, 2)
    return c.withColumn("candidate", F.col("seed").cast("string"))


def _paired(spark, sf):
    return X.paired(_cells(spark, sf).withColumn("seed", F.lit(0)), "0", "macro_F1")


@R.add("j7_paired_gain", f"{CELLS_SQL} SELECT a.candidate, a.fold, 0 AS seed, round(a.macro_F1 - b.macro_F1, 9) AS delta FROM cells a JOIN cells b ON b.fold = a.fold AND b.candidate = '0' WHERE a.candidate <> '0'")
def j7(spark, sf):
    return rounded(_paired(spark, sf), 9)


@R.add("a20_paired_bootstrap", f"""{CELLS_SQL}, d AS (SELECT row_number() OVER (ORDER BY a.candidate, a.fold) - 1 AS i, a.macro_F1 - b.macro_F1 AS delta FROM cells a JOIN cells b ON b.fold = a.fold AND b.candidate = '0' WHERE a.candidate <> '0'),
 dr AS (SELECT r, CAST('0x' || substr(md5(r || '|' || j || '|42'), 1, 8) AS BIGINT) % (SELECT count(*) FROM d) AS idx FROM (SELECT unnest(range(0, 1000)) AS r), (SELECT unnest(range(0, (SELECT count(*) FROM d))) AS j)),
 m AS (SELECT r, avg(delta) AS m FROM dr JOIN d ON d.i = dr.idx GROUP BY 1)
SELECT round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.5), 6) AS median_delta, round(stddev_pop(delta), 6) AS std_delta, round(avg((delta > 0)::INT), 6) AS win_fraction,
 (SELECT round(quantile_cont(m, 0.025), 6) FROM m) AS ci95_low, (SELECT round(quantile_cont(m, 0.975), 6) FROM m) AS ci95_high FROM d""")
def a20(spark, sf):
    return rounded(RS.paired_bootstrap(_paired(spark, sf), ["candidate", "fold"], repetitions=1000))


POISSON_SQL = "CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(np.cumsum([np.exp(-1.0) / np.prod(range(1, k + 1)) if k else np.exp(-1.0) for k in range(13)]).tolist())) + " ELSE 13 END"


@R.add("a21_cluster_bootstrap", f"""{BASE}, c AS (SELECT patient_id, {', '.join(f"count(*) FILTER (seed = {s} AND y_true = 2 AND y_pred = 2) AS tp{s}, count(*) FILTER (seed = {s} AND y_true <> 2 AND y_pred = 2) AS fp{s}, count(*) FILTER (seed = {s} AND y_true = 2 AND y_pred <> 2) AS fn{s}" for s in (0, 1))} FROM scored GROUP BY 1),
 u AS (SELECT c.*, r, CAST('0x' || substr(md5(patient_id || '|' || r || '|42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM c, (SELECT unnest(range(0, 200)) AS r)),
 w AS (SELECT *, {POISSON_SQL} AS w FROM u),
 s AS (SELECT r, sum(w*tp0) AS tp0, sum(w*fp0) AS fp0, sum(w*fn0) AS fn0, sum(w*tp1) AS tp1, sum(w*fp1) AS fp1, sum(w*fn1) AS fn1 FROM w GROUP BY 1),
 d AS (SELECT 2.0*tp1 / (2*tp1+fp1+fn1) - 2.0*tp0 / (2*tp0+fp0+fn0) AS delta FROM s)
SELECT round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, count(*) AS n_effective FROM d""")
def a21(spark, sf):
    s = B.scored(spark, sf)
    return rounded(RS.interval(RS.cluster_f1_delta(s.filter("seed = 0"), s.filter("seed = 1"), "patient_id", 2), [], "delta"))


@R.add("a21_unmatched", f"""{BASE}, a AS (SELECT patient_id, count(*) AS n_a FROM scored WHERE seed = 0 AND fold <> 1 GROUP BY 1), b AS (SELECT patient_id, count(*) AS n_b FROM scored WHERE seed = 1 AND fold <> 2 GROUP BY 1)
SELECT patient_id, CASE WHEN n_b IS NULL THEN 'a' ELSE 'b' END AS side, coalesce(n_a, n_b) AS n FROM a FULL JOIN b USING (patient_id) WHERE n_a IS NULL OR n_b IS NULL""")
def a21_unmatched(spark, sf):
    s = B.scored(spark, sf)
    return RS.unmatched_clusters(s.filter("seed = 0 and fold <> 1"), s.filter("seed = 1 and fold <> 2"), "patient_id")


# ---- matrix -----------------------------------------------------------------------------

def dist_sql(v: str, prefix: str) -> str:
    q = lambda p: f"round(quantile_cont({v}, {p}), 6)"
    return f"round(avg({v}), 6) AS {prefix}mean, round(stddev_pop({v}), 6) AS {prefix}std, {q(0.5)} AS {prefix}median, round(min({v}), 6) AS {prefix}min, round(max({v}), 6) AS {prefix}max, {q(0.1)} AS {prefix}p10, {q(0.9)} AS {prefix}p90"


@R.add("a22_a23_candidate_summary", f"{CELLS_SQL} SELECT candidate, count(*) AS run_count, count(*) FILTER (F1_F = 0) AS zero_runs, count(DISTINCT CASE WHEN F1_F = 0 THEN fold END) AS zero_folds, {dist_sql('F1_F', 'F1_F_')}, {dist_sql('macro_F1', 'macro_F1_')} FROM cells GROUP BY 1")
def a23(spark, sf):
    return rounded(X.candidate_summary(_cells(spark, sf), ["F1_F", "macro_F1"], "F1_F"))


@R.add("a24_cell_metrics", f"""{CM}, ap AS (SELECT fold, seed, p2 AS score, count(*) FILTER (y_true = 2) AS pos, count(*) AS n FROM scored GROUP BY ALL),
 cu AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS pp FROM ap WINDOW w AS (PARTITION BY fold, seed ORDER BY score DESC)),
 av AS (SELECT fold, seed, coalesce(sum(pos * tp::DOUBLE / pp) / nullif(sum(pos), 0), 0) AS AP_F FROM cu GROUP BY ALL)
SELECT fold, seed, {', '.join(f"round(max(CASE WHEN class = {i} THEN f1 END), 6) AS F1_{n}" for i, n in enumerate(NAMES))}, round(avg(f1), 6) AS macro_F1, round(max(CASE WHEN class = 2 THEN ppv END), 6) AS precision_F,
 round(max(CASE WHEN class = 2 THEN se END), 6) AS recall_F, max(CASE WHEN class = 2 THEN tp + fn END) AS F_support, round(max(AP_F), 6) AS AP_F FROM rep JOIN av USING (fold, seed) GROUP BY ALL""")
def a24(spark, sf):
    return rounded(X.cell_metrics(B.scored(spark, sf), CELL, PS, NAMES, 2))


SCOPES = {"src3": "patient_id = 'src3'", "src7": "patient_id = 'src7'", "outside": "patient_id NOT IN ('src3', 'src7')"}
SCOPE_SQL = ", ".join(
    f"count(*) FILTER ({c}) AS n_{s}, count(*) FILTER ({c} AND y_true = 2) AS support_{s}, round(coalesce(2.0 * count(*) FILTER ({c} AND y_true = 2 AND y_pred = 2) / nullif(count(*) FILTER ({c} AND y_true = 2) + count(*) FILTER ({c} AND y_pred = 2), 0), 0), 6) AS F1_{s}"
    for s, c in SCOPES.items())


@R.add("a24_scopes", f"{BASE} SELECT seed, {SCOPE_SQL} FROM scored GROUP BY 1")
def a24s(spark, sf):
    return rounded(X.scope_f1(B.scored(spark, sf), ["seed"], {k: F.expr(v) for k, v in SCOPES.items()}, 2))


@R.add("a24_group_metrics", f"""{BASE} SELECT patient_id, count(*) AS n_samples, count(*) FILTER (y_true = 2) AS support, count(*) FILTER (y_pred = 2) AS predicted,
 round(coalesce(2.0 * count(*) FILTER (y_true = 2 AND y_pred = 2) / nullif(count(*) FILTER (y_true = 2) + count(*) FILTER (y_pred = 2), 0), 0), 6) AS f1 FROM scored GROUP BY 1""")
def a24g(spark, sf):
    return rounded(X.group_metrics(B.scored(spark, sf), "patient_id", 2))


@R.add("a26_seed_average", f"""{BASE}, a AS (SELECT sample_id, min(patient_id) AS patient_id, min(y_true) AS y_true, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM scored GROUP BY 1)
SELECT sample_id, patient_id, y_true, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2, CASE WHEN round(p0, 12) >= round(p1, 12) AND round(p0, 12) >= round(p2, 12) THEN 0 WHEN round(p1, 12) >= round(p2, 12) THEN 1 ELSE 2 END AS y_pred FROM a""")
def a26(spark, sf):
    return rounded(X.seed_average(B.scored(spark, sf), "sample_id", PS, 3)[0], 9)


@R.add("a27_instability", f"""{BASE}, s AS (SELECT sample_id, max(p2) - min(p2) AS v, (min(y_pred) <> max(y_pred))::INT AS d FROM scored GROUP BY 1)
SELECT count(*) AS n, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(avg(d), 6) AS any_seed_disagreement, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM s""")
def a27(spark, sf):
    return rounded(X.instability(B.scored(spark, sf), "sample_id", "p2"))


@R.add("a27_pairwise", f"""{BASE}, p AS (SELECT a.sample_id, avg((a.y_pred <> b.y_pred)::INT) AS d FROM scored a JOIN scored b ON a.sample_id = b.sample_id AND a.seed < b.seed GROUP BY 1) SELECT round(avg(d), 6) AS pairwise_disagreement FROM p""")
def a27p(spark, sf):
    return rounded(X.pairwise_disagreement(B.scored(spark, sf), "sample_id", 3))


FL_SQL = f"""{CELLS_SQL}, fl AS (SELECT fold, seed, -avg(ln(CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS log_loss,
 avg(((p0 - (y_true = 0)::INT) ** 2 + (p1 - (y_true = 1)::INT) ** 2 + (p2 - (y_true = 2)::INT) ** 2) / 3) AS brier FROM scored GROUP BY ALL),
 ff AS (SELECT cells.*, log_loss, brier FROM cells JOIN fl USING (fold, seed))"""


def _folds(spark, sf):
    s = B.scored(spark, sf)
    return X.cell_metrics(s, CELL, PS, NAMES, 2).join(X.fold_losses(s, CELL, PS), CELL)


@R.add("a40_gates", f"""{FL_SQL}, a AS (SELECT seed, avg(F1_S) AS s, avg(F1_V) AS v, avg(F1_F) AS f, avg(macro_F1) AS m, stddev_pop(F1_F) AS sd, min(F1_F) AS mn, avg(log_loss) AS ll FROM ff GROUP BY seed),
 g AS (SELECT seed, 'patientwise' AS gate, (f >= 0.5 AND mn >= 0 AND m >= 0.45 AND s >= 0.55 AND v >= 0.7) AS passed, false AS diagnostic, m AS value FROM a UNION ALL SELECT seed, 'stability', true, false, sd FROM a
  UNION ALL SELECT seed, 'calibration', true, false, ll FROM a UNION ALL SELECT seed, 'smoke', (s >= 0.55 AND v >= 0.7 AND f >= 0.5 AND m >= 0.45), true, m FROM a)
SELECT seed, gate, passed, diagnostic, round(value, 6) AS value, bool_and(passed OR diagnostic) OVER (PARTITION BY seed) AS can_publish FROM g""")
def a40(spark, sf):
    return rounded(X.gate_table(_folds(spark, sf), ["seed"]))


@R.add("a40_limits", f"{FL_SQL} SELECT seed, round(stddev_pop(F1_F), 6) AS f_std, round(avg(log_loss), 6) AS mean_log_loss, round(avg(brier), 6) AS mean_brier, stddev_pop(F1_F) <= 0.2 AS stability, (avg(log_loss) <= 2.0 AND avg(brier) <= 0.1) AS calibration FROM ff GROUP BY seed")
def a40b(spark, sf):
    return rounded(X.with_limits(_folds(spark, sf), 0.2, 2.0, 0.1, ["seed"]))


@R.add("a41_best_fold", f"""{FL_SQL}, k AS (SELECT seed, fold, (F1_S >= 0.55 AND F1_V >= 0.7 AND F1_F >= 0.5 AND macro_F1 >= 0.45) AS ok, macro_F1, 2 * (greatest(0, 0.55 - F1_S) + greatest(0, 0.7 - F1_V) + greatest(0, 0.5 - F1_F)) AS pen FROM ff)
SELECT seed, fold, ok AS passed, round(CASE WHEN ok THEN macro_F1 ELSE macro_F1 - pen END, 6) AS score FROM k QUALIFY row_number() OVER (PARTITION BY seed ORDER BY ok DESC, round(CASE WHEN ok THEN macro_F1 ELSE macro_F1 - pen END, 12) DESC, fold) = 1""")
def a41(spark, sf):
    return rounded(X.best_fold(_folds(spark, sf), ["seed"]))


@R.add("a46_reconcile", f"""{CELLS_SQL}, n AS (SELECT 'F1_' || fold AS metric, F1_F AS v FROM cells WHERE seed = 0 AND fold < 4), o AS (SELECT 'F1_' || fold AS metric, round(F1_F, 3) AS v FROM cells WHERE seed = 0 AND fold > 0)
SELECT metric, round(n.v, 6) AS new, round(o.v, 6) AS old, round(abs(n.v - o.v), 6) AS difference, coalesce(abs(n.v - o.v) <= 0.0004, false) AS agrees FROM n FULL JOIN o USING (metric)""")
def a46(spark, sf):
    c = _cells(spark, sf).filter("seed = 0").withColumn("metric", F.concat(F.lit("F1_"), F.col("fold")))
    new = c.filter("fold < 4").select("metric", F.col("F1_F").alias("value"))
    old = c.filter("fold > 0").select("metric", F.round("F1_F", 3).alias("value"))
    return rounded(X.reconcile(new, old, tol=0.0004))


@R.add("a47_collapse", f"""{CELLS_SQL}, m AS (SELECT fold, max(F1_F) AS hi, min(F1_F) AS lo FROM cells GROUP BY 1),
 x AS (SELECT fold, count(*) AS n, count(*) FILTER (y_pred = 0) AS s, count(*) FILTER (y_pred = 1) AS v, count(*) FILTER (y_pred = 2) AS f, avg((ln(p2) - greatest(ln(p0), ln(p1)) < 0)::INT) AS neg FROM scored WHERE y_true = 2 GROUP BY 1)
SELECT m.fold, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'NO_TRAIN_SUPPORT' WHEN hi > 0 AND lo = 0 THEN 'OPTIMIZATION_COLLAPSE' WHEN v > s AND v > f THEN 'F_TO_V_CONFUSION' WHEN s > v AND s > f THEN 'F_TO_S_CONFUSION'
 WHEN neg >= 0.75 THEN 'REPRESENTATION_OVERLAP' ELSE 'INCONCLUSIVE' END AS reason FROM m LEFT JOIN x USING (fold)""")
def a47(spark, sf):
    s = B.scored(spark, sf).withColumn("margin", P.log_margin(F.col("p2"), [F.col("p0"), F.col("p1")]))
    return X.collapse_class(s, _cells(spark, sf), ["fold"])


TWO_SQL = f"""{BASE}, b AS (SELECT CASE WHEN sample_id % 7 = 0 THEN 4 WHEN sample_id % 3 = 0 THEN 0 ELSE y_true + 1 END AS y, 1 - p0 AS s1, y_pred AS s2 FROM scored),
 u AS (SELECT 'stage1' AS part, (y <> 0)::INT AS t, (s1 >= 0.6)::INT AS p FROM b UNION ALL SELECT 'stage2', y - 1, s2 FROM b WHERE y IN (1, 2, 3) UNION ALL SELECT 'integrated', y, CASE WHEN s1 >= 0.6 THEN s2 + 1 ELSE 0 END FROM b WHERE y <> 4)"""


@R.add("a48_two_stage", f"{TWO_SQL} SELECT part, t, p, count(*) AS n FROM u GROUP BY ALL")
def a48(spark, sf):
    i = F.col("sample_id")
    b = B.scored(spark, sf).select(F.when(i % 7 == 0, 4).when(i % 3 == 0, 0).otherwise(F.col("y_true") + 1).alias("y"), (F.lit(1.0) - F.col("p0")).alias("s1"), F.col("y_pred").alias("s2"))
    out = None
    for part, rows in X.two_stage(b, "y", "s1", 0.6, "s2").items():
        n = M.pair_counts(rows).select(F.lit(part).alias("part"), "t", "p", "n")
        out = n if out is None else out.unionByName(n)
    return out


@R.add("a49_a50_history", f"""WITH {B.METRIC_SQL}, h AS (SELECT run_id % 50 AS series, run_id AS epoch, round(avg(value), 12) AS v FROM metric GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY epoch) AS pv FROM h)
SELECT series, arg_max(epoch, row(v, -epoch)) AS best_epoch, round(max(v), 6) AS best_value, round(arg_min(v, epoch), 6) AS first, round(arg_max(v, epoch), 6) AS last, count(*) FILTER (v < pv) AS decreases,
 round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(coalesce(regr_slope(v, epoch), 0), 9) AS trend FROM l GROUP BY 1""")
def a49(spark, sf):
    h = B.metric(spark, sf).groupBy((F.col("run_id") % 50).alias("series"), F.col("run_id").alias("epoch")).agg(F.round(F.avg("value"), 12).alias("v"))
    x = X.history_summary(h, ["series"], "epoch", "v")
    return rounded(x, 6, ("trend",)).withColumn("trend", F.round("trend", 9))


@R.add("a51_run_comparison", f"""WITH {B.RUN_SQL}, {B.ALERT_SQL} SELECT r.id AS run_id, r.status, {', '.join(f"(SELECT count(*) FROM alert a WHERE a.run_id = r.id AND a.severity = '{s}') AS n_{s}" for s in ('critical', 'warning', 'info'))} FROM run r""")
def a51(spark, sf):
    return X.run_comparison(B.run(spark, sf).select(F.col("id").alias("run_id"), "status"), B.alert(spark, sf))


@R.add("a52_ap_reference", f"""{CURVE}, z AS (SELECT class, auc_pr, np::DOUBLE / (np + nn) AS prev FROM auc) SELECT class, round(auc_pr, 6) AS auc_pr, round(prev, 6) AS prevalence, round(auc_pr - prev, 6) AS lift,
 CASE WHEN auc_pr - prev > 1e-12 THEN 'ABOVE_PREVALENCE_REFERENCE' WHEN auc_pr - prev < -1e-12 THEN 'BELOW_PREVALENCE_REFERENCE' ELSE 'NEAR_PREVALENCE_REFERENCE' END AS verdict FROM z""")
def a52(spark, sf):
    return rounded(M.ap_reference(B.multilabel(spark, sf), ["class"]))


@R.add("a52_column_statistics", """WITH u AS (UNPIVOT (SELECT l_quantity AS quantity, CASE WHEN l_linenumber = 3 THEN 'nan'::DOUBLE WHEN l_linenumber = 5 THEN 'inf'::DOUBLE ELSE l_extendedprice END AS price FROM lineitem) ON quantity, price INTO NAME "column" VALUE v)
SELECT "column", min(v) FILTER (isfinite(v)) AS min, max(v) FILTER (isfinite(v)) AS max, round(avg(v) FILTER (isfinite(v)), 4) AS mean, round(stddev_pop(CASE WHEN isfinite(v) THEN v END), 4) AS std, count(*) FILTER (isnan(v)) AS nan_count, count(*) FILTER (isinf(v)) AS inf_count FROM u GROUP BY 1""")
def a52b(spark, sf):
    n = F.col("l_linenumber")
    x = B.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"),
        F.when(n == 3, F.lit(float("nan"))).when(n == 5, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")).alias("price"))
    return X.column_statistics(x, ["quantity", "price"]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


def _ranked_summary(spark, sf):
    c = X.candidate_summary(_cells(spark, sf), ["F1_F", "macro_F1", "precision_F", "recall_F"], "F1_F")
    s = X.scope_f1(B.scored(spark, sf), CELL, {"outside": F.expr(SCOPES["outside"])}, 2)
    o = s.groupBy(F.col("seed").cast("string").alias("candidate")).agg(F.avg("F1_outside").alias("F1_outside_mean"))
    return c.join(o, "candidate")


SUM_SQL = f"""{CM}, cells AS (SELECT fold, seed, avg(f1) AS macro_F1, max(CASE WHEN class = 2 THEN f1 END) AS F1_F, max(CASE WHEN class = 2 THEN ppv END) AS pr, max(CASE WHEN class = 2 THEN se END) AS rc FROM rep GROUP BY ALL),
 sc AS (SELECT fold, seed, coalesce(2.0 * count(*) FILTER (y_true = 2 AND y_pred = 2) / nullif(count(*) FILTER (y_true = 2) + count(*) FILTER (y_pred = 2), 0), 0) AS f FROM scored WHERE {SCOPES['outside']} GROUP BY ALL),
 so AS (SELECT seed, avg(coalesce(f, 0)) AS o FROM cells LEFT JOIN sc USING (fold, seed) GROUP BY 1),
 sm AS (SELECT CAST(seed AS VARCHAR) AS candidate, avg(F1_F) AS f, stddev_pop(F1_F) AS sd, avg(macro_F1) AS m, count(DISTINCT CASE WHEN F1_F = 0 THEN fold END) AS zf, avg(pr) AS pr, avg(rc) AS rc, max(o) AS o FROM cells JOIN so USING (seed) GROUP BY 1)"""


@R.add("w13_candidate_rank", f"{SUM_SQL} SELECT candidate, CAST(row_number() OVER (ORDER BY f DESC, o DESC, zf, m DESC, sd, abs(pr - rc), candidate) AS INTEGER) AS rank, round(f, 6) AS f1 FROM sm")
def w13(spark, sf):
    keys = [F.desc("F1_F_mean"), F.desc("F1_outside_mean"), F.col("zero_folds"), F.desc("macro_F1_mean"), F.col("F1_F_std"), F.abs(F.col("precision_F_mean") - F.col("recall_F_mean"))]
    return X.rank_candidates(_ranked_summary(spark, sf), keys).select("candidate", "rank", F.round("F1_F_mean", 6).alias("f1"))


@R.add("a53_verdict", f"""{SUM_SQL} SELECT candidate, f >= 0.45 AS target_met, o - (SELECT o FROM sm WHERE candidate = '0') >= 0.0 AS material_gain, m >= 0.3 AS macro_gate,
 CASE WHEN f >= 0.45 AND o - (SELECT o FROM sm WHERE candidate = '0') >= 0.0 AND m >= 0.3 THEN 'SUPPORTED' ELSE 'NOT_SUFFICIENT' END AS result FROM sm WHERE candidate <> '0'""")
def a53(spark, sf):
    return X.hypothesis_verdict(_ranked_summary(spark, sf), "0", 0.45, 0.0, 0.3)


# ---- feature audits ---------------------------------------------------------------------

STAT_SQL = """count(value) AS count, 0::BIGINT AS missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
 round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr"""


@R.add("a30_feature_statistics", f"WITH {B.FEATURE_SQL} SELECT CAST(dim AS INTEGER) AS dim, {STAT_SQL} FROM feature GROUP BY 1")
def a30(spark, sf):
    return rounded(M.feature_statistics(B.features(spark, sf), ["dim"]))


@R.add("a30_class_statistics", f"WITH {B.FEATURE_SQL} SELECT CAST(dim AS INTEGER) AS dim, label, {STAT_SQL} FROM feature GROUP BY ALL")
def a30b(spark, sf):
    return rounded(M.feature_statistics(B.features(spark, sf), ["dim", "label"]))


@R.add("a31_mutual_information", f"""WITH {B.FEATURE_SQL}, r AS (SELECT dim, min(value) AS lo, max(value) AS hi FROM feature WHERE label IS NOT NULL GROUP BY 1),
 x AS (SELECT f.dim, least(19, floor((value - lo) / ((hi - lo) / 20.0::DOUBLE))) AS b, label FROM feature f JOIN r ON r.dim = f.dim WHERE label IS NOT NULL),
 h AS (SELECT x.dim, b, c.label, (x.label = c.label)::INT AS y, count(*) AS n FROM x, (SELECT DISTINCT label FROM x) c GROUP BY ALL),
 w AS (SELECT *, sum(n) OVER (PARTITION BY dim, label) AS t, sum(n) OVER (PARTITION BY dim, label, b) AS px, sum(n) OVER (PARTITION BY dim, label, y) AS py FROM h)
SELECT CAST(dim AS INTEGER) AS dim, label, round(sum(n::DOUBLE / t * ln(n::DOUBLE * t / (px * py))), 6) AS mi FROM w GROUP BY dim, label""")
def a31(spark, sf):
    return rounded(M.mutual_information(B.features(spark, sf), "dim", "value", "label"))


@R.add("a32_correlation", """SELECT l_returnflag, CASE WHEN stddev_pop(l_quantity) > 1e-8 AND stddev_pop(l_extendedprice) > 1e-8 THEN round(corr(l_quantity, l_extendedprice), 6) END AS corr, count(*) AS n FROM lineitem GROUP BY 1""")
def a32(spark, sf):
    return rounded(M.guarded_corr(B.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@R.add("a28_w4_concentration", f"""WITH {B.BEATS_SQL}, n AS (SELECT record_id, count(*) AS total, {', '.join(f"count(*) FILTER (label = '{c}') AS n_{c}" for c in 'SVF')} FROM beats GROUP BY 1),
 c AS (SELECT *, sum(n_F) OVER (ORDER BY n_F DESC, md5(record_id || '|0') ROWS UNBOUNDED PRECEDING) AS cum, sum(n_F) OVER () AS a FROM n)
SELECT record_id, total, n_S, n_V, n_F, round(n_F * 100.0::DOUBLE / total, 4) AS pct_within, round(n_F * 100.0::DOUBLE / a, 4) AS pct_of_all, round(cum * 100.0::DOUBLE / a, 4) AS pct_cumulative FROM c""")
def a28(spark, sf):
    return M.record_concentration(B.beats(spark, sf), "record_id", "label", ["S", "V", "F"], "F")


@R.add("a28_herfindahl", f"""WITH {B.BEATS_SQL}, n AS (SELECT record_id, count(*) AS c FROM beats WHERE label = 'F' GROUP BY 1)
SELECT count(*) AS n_groups, CAST(sum(c) AS BIGINT) AS total, round(sum(c::DOUBLE * c) / (sum(c)::DOUBLE * sum(c)), 9) AS herfindahl, round(max(c)::DOUBLE / sum(c), 9) AS top_share FROM n""")
def a28h(spark, sf):
    n = B.beats(spark, sf).filter("label = 'F'").groupBy("record_id").agg(F.count("*").alias("c"))
    return rounded(M.concentration_index(n, "c"), 9)


@R.add("a45_evaluation_bundle", f"""{CURVE}, r AS ({bins_sql(15)}), e AS (SELECT class, sum(n * abs(acc - conf)) / sum(n) AS ece, max(abs(acc - conf)) AS mce FROM r GROUP BY 1), l AS ({LOSS_SQL}), b AS ({PRF_SQL.format(d='p >= 0.5')}),
 f AS (SELECT class, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / np) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / np + 1e-9), 12) AS f1, score FROM cv), t AS (SELECT class, arg_max(score, row(f1, -score)) AS threshold FROM f GROUP BY 1)
SELECT auc.class, l.support, l.n, round(auc_roc, 6) AS auc_roc, round(auc_pr, 6) AS auc_pr, {PRF_COLS}, round(ece, 6) AS ece, round(mce, 6) AS mce, round(brier, 6) AS brier, round(nll, 6) AS nll, round(threshold, 9) AS threshold, 'RETROSPECTIVE' AS protocol
FROM auc JOIN e USING (class) JOIN l USING (class) JOIN b USING (class) JOIN t USING (class)""")
def a45(spark, sf):
    from .evaluation import evaluation_bundle

    x = evaluation_bundle(B.multilabel(spark, sf))
    return rounded(x, 6, ("threshold",)).withColumn("threshold", F.round("threshold", 9))


TASKS_SQL = f"""{BASE}, task AS (SELECT seed, sample_id, 'quality' AS class, CAST(quality AS INTEGER) AS y, p0 AS p FROM scored UNION ALL SELECT seed, sample_id, 'toxic', CAST(toxic AS INTEGER), p1 FROM scored)"""
ISO_SQL = f"""{TASKS_SQL}, d AS (SELECT seed, class, p AS x, count(*) AS n, sum(y) AS s FROM task GROUP BY ALL),
 c AS (SELECT *, row_number() OVER o AS i, sum(n) OVER o AS cn, sum(s) OVER o AS cs FROM d WINDOW o AS (PARTITION BY seed, class ORDER BY x ROWS UNBOUNDED PRECEDING)),
 lo AS (SELECT b.seed, b.class, b.i, min((b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.seed, a.class, a.i ORDER BY b.i DESC ROWS UNBOUNDED PRECEDING) AS v
  FROM c a JOIN c b ON a.seed = b.seed AND a.class = b.class AND a.i <= b.i),
 hi AS (SELECT seed, class, i, max(v) AS v FROM lo GROUP BY ALL),
 fit AS (SELECT c.*, round(hi.v, 9) AS value FROM c JOIN hi ON c.seed = hi.seed AND c.class = hi.class AND c.i = hi.i)"""


def _tasks(spark, sf):
    """Two binary tasks per sample, for every seed."""
    return B.scored(spark, sf).select("seed", "sample_id", F.expr("stack(2, 'quality', cast(quality as int), p0, 'toxic', cast(toxic as int), p1) as (class, y, p)"))


@R.add("a36_isotonic_steps", f"{ISO_SQL} SELECT seed, class, value, round(min(x), 9) AS x_lo, round(max(x), 9) AS x_hi, CAST(sum(n) AS BIGINT) AS n FROM fit GROUP BY seed, class, value")
def a36i(spark, sf):
    steps = C.isotonic_steps(_tasks(spark, sf), ["seed", "class"]).withColumn("value", F.round("value", 9))
    x = steps.groupBy("seed", "class", "value").agg(F.min("x_lo").alias("x_lo"), F.max("x_hi").alias("x_hi"), F.sum("n").alias("n"))
    return rounded(x, 9)


@R.add("a36_isotonic_applied", f"{ISO_SQL} SELECT t.seed, t.sample_id, t.class, value AS calibrated FROM task t JOIN fit ON t.seed = fit.seed AND t.class = fit.class AND t.p = fit.x")
def a36a(spark, sf):
    t, by = _tasks(spark, sf), ["seed", "class"]
    x = C.apply_isotonic(t, C.isotonic_steps(t, by), by)
    return x.select("seed", "sample_id", "class", F.round("calibrated", 9).alias("calibrated"))


@R.add("a36_binary_calibrator")
def a36(spark, sf):
    """One selection per seed and task; their number is that of the table's seeds times two."""
    tasks, out = _tasks(spark, sf), []
    for seed, cls in [(s, c) for s in B.SEEDS for c in ("quality", "toxic")]:
        m = tasks.filter((F.col("seed") == seed) & (F.col("class") == cls))
        best, (_, transform), scores = C.select_binary(m)
        m = transform(m, "p", "_fit").withColumn("p", P.clip(F.col("_fit"), 0.0, 1.0))
        out.append(C.errors(C.reliability(m, ["seed", "class"]), ["seed", "class"]).withColumn("method", F.lit(best)).withColumn("nll", F.lit(scores[best])))
    return reduce(lambda a, b: a.unionByName(b), out)


@R.add("a36_multiclass_calibrator")
def a36m(spark, sf):
    """One selection per seed."""
    rows, out = B.scored(spark, sf), []
    for seed in B.SEEDS:
        s = rows.filter(F.col("seed") == seed)
        best, params, scores = C.select_multiclass(s, PS)
        q = P.multiclass([F.col(c) for c in PS], best, **params)
        x = C.per_true_class(s.withColumns(dict(zip(PS, q))), PS)
        out.append(x.withColumn("seed", F.lit(seed)).withColumn("method", F.lit(best)).withColumn("nll", F.lit(scores[best])))
    return reduce(lambda a, b: a.unionByName(b), out)


