"""Timeline, named, summary and security queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import security as Sec, tracking as T
from ..session import shared_folder
from . import bindings as B
from .registry import Registry

R = Registry()
ORDER = ["recorded_at", "step", "l_partkey", "l_suppkey", "l_extendedprice"]
ORDER_SQL = "recorded_at, step, l_partkey, l_suppkey, l_extendedprice, value"

TL_SQL = f"""WITH {B.TRACKING_SQL},
 mm AS (SELECT run_id, max(CASE WHEN name = 'accuracy' THEN value END) AS final_accuracy, max(CASE WHEN name = 'loss' THEN value END) AS final_loss,
   coalesce(max(CASE WHEN lower(name) = 'f1_macro' THEN value END), max(CASE WHEN lower(name) = 'f1-macro' THEN value END)) AS final_f1_macro,
   max(CASE WHEN lower(name) = 'auc_roc' THEN value END) AS final_auc_roc FROM metric WHERE namespace = 'global' GROUP BY run_id),
 aa AS (SELECT run_id, count(DISTINCT CASE WHEN severity = 'critical' THEN id END) AS critical_alerts,
   count(DISTINCT CASE WHEN severity = 'warning' THEN id END) AS warning_alerts, count(DISTINCT CASE WHEN severity = 'info' THEN id END) AS info_alerts FROM alert GROUP BY run_id),
 timeline AS (SELECT r.id AS run_id, e.id AS experiment_id, e.name AS experiment_name, e.stage, e.owner_id,
   coalesce(json_extract_string(r.extra, '$.model_name'), json_extract_string(e.extra, '$.model_name'), e.name) AS model_name,
   r.run_type, r.status, r.start_time AS run_start, r.end_time AS finished_at,
   round((epoch_us(r.end_time) - epoch_us(r.start_time)) / 1e6, 2) AS duration_seconds,
   final_accuracy, final_loss, final_f1_macro, final_auc_roc,
   CAST(json_extract_string(e.extra, '$.baseline_accuracy') AS DOUBLE) AS baseline_accuracy, CAST(json_extract_string(e.extra, '$.baseline_loss') AS DOUBLE) AS baseline_loss,
   CAST(json_extract_string(e.extra, '$.baseline_f1_macro') AS DOUBLE) AS baseline_f1_macro, CAST(json_extract_string(e.extra, '$.baseline_auc_roc') AS DOUBLE) AS baseline_auc_roc,
   final_f1_macro - CAST(json_extract_string(e.extra, '$.baseline_f1_macro') AS DOUBLE) AS f1_macro_delta,
   coalesce(critical_alerts, 0) AS critical_alerts, coalesce(warning_alerts, 0) AS warning_alerts, coalesce(info_alerts, 0) AS info_alerts,
   CASE WHEN r.status = 'failed' THEN 'FAILED' WHEN coalesce(critical_alerts, 0) > 0 THEN 'UNSTABLE'
     WHEN final_f1_macro < CAST(json_extract_string(e.extra, '$.baseline_f1_macro') AS DOUBLE) THEN 'REGRESSION' ELSE 'HEALTHY' END AS health_status
  FROM experiment e JOIN run r ON r.experiment_id = e.id LEFT JOIN mm ON mm.run_id = r.id LEFT JOIN aa ON aa.run_id = r.id)"""

TL_COLS = """run_id, experiment_id, experiment_name, stage, owner_id, model_name, run_type, status, epoch_us(run_start) // 1000000 AS run_start,
 epoch_us(finished_at) // 1000000 AS finished_at, duration_seconds, final_accuracy, final_loss, final_f1_macro, final_auc_roc,
 baseline_accuracy, baseline_loss, baseline_f1_macro, baseline_auc_roc, round(f1_macro_delta, 6) AS f1_macro_delta,
 critical_alerts, warning_alerts, info_alerts, health_status"""


def tables(spark, sf):
    return {"experiment": B.experiment(spark, sf), "run": B.run(spark, sf), "metric": B.metric(spark, sf), "alert": B.alert(spark, sf)}


def _tl(spark, sf):
    return T.timeline(**tables(spark, sf))


def _shown(df):
    return df.withColumns({
        "run_start": F.unix_seconds("run_start"), "finished_at": F.unix_seconds("finished_at"),
        "f1_macro_delta": F.round("f1_macro_delta", 6)})


@R.add("j1_a1_timeline", f"{TL_SQL} SELECT {TL_COLS} FROM timeline")
def timeline(spark, sf):
    return _shown(_tl(spark, sf))


@R.add("t1_timeline_page", f"""{TL_SQL} SELECT {TL_COLS}, (SELECT count(*) FROM timeline WHERE final_f1_macro >= 0.02) AS total FROM timeline
 WHERE final_f1_macro >= 0.02 ORDER BY run_start DESC NULLS LAST, run_id DESC LIMIT 1000""")
def t1(spark, sf):
    return _shown(T.timeline_page(_tl(spark, sf), T.TimelineFilter(min_f1_macro=0.02, limit=1000)))


@R.add("p9_timeline_filter", f"""{TL_SQL} SELECT {TL_COLS} FROM timeline WHERE stage = 'stage1' AND status = 'completed' AND health_status = 'HEALTHY'
 AND run_type = 'train' AND run_start >= TIMESTAMP '1996-01-01' AND run_start <= TIMESTAMP '2001-06-30' AND final_f1_macro >= 0.01 AND critical_alerts <= 2""")
def p9(spark, sf):
    from datetime import datetime

    f = T.TimelineFilter(stage="stage1", status="completed", health_status="HEALTHY", run_type="train", date_from=datetime(1996, 1, 1),
                         date_to=datetime(2001, 6, 30), min_f1_macro=0.01, max_critical_alerts=2)
    return _shown(f.apply(_tl(spark, sf)))


@R.add("p23_json_fields", f"""WITH {B.TRACKING_SQL}
SELECT r.id AS run_id, coalesce(json_extract_string(r.extra, '$.model_name'), json_extract_string(e.extra, '$.model_name'), e.name) AS model_name,
 CAST(json_extract_string(e.extra, '$.baseline_f1_macro') AS DOUBLE) AS baseline FROM run r JOIN experiment e ON e.id = r.experiment_id""")
def p23(spark, sf):
    e = B.experiment(spark, sf).select(F.col("id").alias("experiment_id"), F.col("extra").alias("ee"), "name")
    return B.run(spark, sf).join(e, "experiment_id").select(
        F.col("id").alias("run_id"),
        F.coalesce(T.json_text("extra", "model_name"), T.json_text("ee", "model_name"), "name").alias("model_name"),
        T.json_number("ee", "baseline_f1_macro").alias("baseline"))


@R.add("p24_p25_health_mix", f"""{TL_SQL} SELECT stage, health_status, count(*) AS n, round(avg(duration_seconds), 2) AS mean_seconds FROM timeline GROUP BY ALL""")
def p24(spark, sf):
    return _tl(spark, sf).groupBy("stage", "health_status").agg(F.count("*").alias("n"), F.round(F.avg("duration_seconds"), 2).alias("mean_seconds"))


@R.add("t2_list_alerts", f"""WITH {B.TRACKING_SQL} SELECT id, run_id, severity, category, metric_value, resolved FROM alert
 WHERE severity = 'critical' AND NOT resolved ORDER BY recorded_at DESC, id DESC LIMIT 100""")
def t2(spark, sf):
    x = T.where(B.alert(spark, sf), {"severity": "critical", "category": None, "resolved": False}, [F.desc("recorded_at"), F.desc("id")], 100)
    return x.drop("recorded_at")


@R.add("t3_capped_rows", f"""WITH {B.METRIC_SQL} SELECT run_id, step, value, l_partkey, (SELECT count(*) FROM metric) > 1000 AS truncated FROM metric
 ORDER BY run_id, step, l_partkey, l_suppkey, l_extendedprice, value LIMIT 1000""")
def t3(spark, sf):
    m = B.metric(spark, sf)
    x = T.capped(m, [F.col(c) for c in ("run_id", "step", "l_partkey", "l_suppkey", "l_extendedprice", "value")])
    return x.select("run_id", "step", "value", "l_partkey", "truncated")


def _nq(spark, sf):
    return T.NamedQueries(**tables(spark, sf))


@R.add("t5_last_failed_runs", f"""WITH {B.TRACKING_SQL} SELECT r.id AS run_id, e.name AS experiment_name, r.run_type, r.status, epoch_us(r.start_time) AS start_us, count(*) OVER () > 1000 AS truncated
 FROM run r JOIN experiment e ON e.id = r.experiment_id WHERE r.status = 'failed' ORDER BY r.start_time DESC, r.id DESC LIMIT 1000""")
def t5a(spark, sf):
    return _nq(spark, sf).last_failed_runs().select("run_id", "experiment_name", "run_type", "status", F.unix_micros("start_time").alias("start_us"), "truncated")


@R.add("t5_runs_by_stage", f"""WITH {B.TRACKING_SQL} SELECT r.id AS run_id, e.name AS experiment_name, e.stage, r.run_type, r.status, count(*) OVER () > 1000 AS truncated
 FROM run r JOIN experiment e ON e.id = r.experiment_id WHERE e.stage = 'stage2' ORDER BY r.start_time DESC, r.id DESC LIMIT 1000""")
def t5b(spark, sf):
    return _nq(spark, sf).runs_by_stage("stage2").drop("start_time")


@R.add("t5_alerts_by_severity", f"""WITH {B.TRACKING_SQL} SELECT a.id, a.severity, a.category, r.id AS run_id, e.name AS experiment_name, count(*) OVER () > 1000 AS truncated
 FROM alert a LEFT JOIN run r ON r.id = a.run_id LEFT JOIN experiment e ON e.id = r.experiment_id WHERE a.severity = 'warning'
 ORDER BY a.recorded_at DESC, a.id DESC LIMIT 1000""")
def t5c(spark, sf):
    return _nq(spark, sf).alerts_by_severity("warning").drop("recorded_at")


@R.add("t5_timeline", f"{TL_SQL} SELECT {TL_COLS}, count(*) OVER () > 1000 AS truncated FROM timeline ORDER BY timeline.run_start DESC, run_id DESC LIMIT 1000")
def t5d(spark, sf):
    return _shown(_nq(spark, sf).timeline())


@R.add("t5_timeline_health", f"{TL_SQL} SELECT {TL_COLS}, count(*) OVER () > 1000 AS truncated FROM timeline WHERE health_status = 'REGRESSION' ORDER BY timeline.run_start DESC, run_id DESC LIMIT 1000")
def t5e(spark, sf):
    return _shown(_nq(spark, sf).timeline_health("REGRESSION"))


@R.add("t5_metrics_of_run", f"""WITH {B.TRACKING_SQL} SELECT namespace, name, value, step, count(*) OVER () > 1000 AS truncated FROM metric WHERE run_id = 7 AND run_id IN (SELECT id FROM run)
 ORDER BY namespace, name, step, value LIMIT 1000""")
def t5f(spark, sf):
    return _nq(spark, sf).metrics_for_run(7)


@R.add("t8_ad_hoc_secured", f"""WITH {B.TRACKING_SQL} SELECT e.stage, r.status, count(*) AS n, false AS truncated FROM experiment e JOIN run r ON r.experiment_id = e.id
 WHERE e.owner_id = 'BUILDING' AND r.fold_idx = 2 GROUP BY ALL""")
def t8(spark, sf):
    return Sec.ad_hoc(
        spark,
        "SELECT e.stage, r.status, count(*) AS n FROM experiment e JOIN run r ON r.experiment_id = e.id WHERE r.fold_idx = :fold GROUP BY ALL",
        lambda s: tables(s, sf), user="BUILDING", args={"fold": 2})


@R.add("r1_owner_runs", f"""WITH {B.TRACKING_SQL} SELECT a.severity, count(*) AS n FROM alert a JOIN run r ON r.id = a.run_id JOIN experiment e ON e.id = r.experiment_id
 WHERE e.owner_id = 'MACHINERY' GROUP BY 1""")
def r1(spark, sf):
    return Sec.secure_tables(tables(spark, sf), "MACHINERY", ["viewer"])["alert"].groupBy("severity").agg(F.count("*").alias("n"))


@R.add("r2_audit_row", f"""WITH {B.TRACKING_SQL}, f AS (SELECT count(*) AS row_count FROM run r JOIN experiment e ON e.id = r.experiment_id WHERE e.owner_id = 'BUILDING' AND r.status = 'failed')
SELECT substr(sha256('BUILDING:failed_runs:status=failed'), 1, 32) AS query_id, 'BUILDING' AS user, 'failed_runs' AS source, 'status=failed' AS params, row_count, 'ok' AS status, true AS dated, 1::BIGINT AS n FROM f
UNION ALL SELECT substr(sha256('BUILDING:ad_hoc:sql=SELECT * FROM other'), 1, 32), 'BUILDING', 'ad_hoc', 'sql=SELECT * FROM other', 0, 'rejected', true, 1""")
def r2(spark, sf):
    """A named query and a refused ad-hoc query, read back from the audit log."""
    log = f"{shared_folder(spark)}/audit"
    Sec.audited(lambda: Sec.secure_tables(tables(spark, sf), "BUILDING")["run"].filter("status = 'failed'"), log, "BUILDING", "failed_runs", {"status": "failed"})
    sql = "SELECT * FROM other"
    try:
        Sec.audited(lambda: Sec.ad_hoc(spark, sql, lambda s: tables(s, sf), user="BUILDING"), log, "BUILDING", "ad_hoc", {"sql": sql})
    except Sec.NotAllowed:
        pass
    x = spark.read.json(log)
    return x.groupBy("query_id", "user", "source", "params", "row_count", "status", F.col("recorded_at").isNotNull().alias("dated")).agg(F.countDistinct("audit_id").alias("n"))


@R.add("a5_best_metric", f"""WITH {B.TRACKING_SQL} SELECT r.experiment_id, max(m.value) AS best_value FROM metric m JOIN run r ON r.id = m.run_id
 WHERE m.name = 'F1_macro' AND m.namespace = 'global' GROUP BY 1""")
def a5(spark, sf):
    return T.best_metric(B.metric(spark, sf), B.run(spark, sf), "F1_macro")


@R.add("a6_experiment_summary", f"""WITH {B.TRACKING_SQL} SELECT e.id AS experiment_id, e.name, e.stage,
 (SELECT count(*) FROM run r WHERE r.experiment_id = e.id) AS n_runs,
 (SELECT count(*) FROM alert a JOIN run r ON r.id = a.run_id WHERE r.experiment_id = e.id AND NOT a.resolved) AS n_alerts,
 (SELECT max(m.value) FROM metric m JOIN run r ON r.id = m.run_id WHERE r.experiment_id = e.id AND m.name = 'F1_macro' AND m.namespace = 'global') AS best_value
 FROM experiment e""")
def a6(spark, sf):
    return T.experiment_summary(**tables(spark, sf))


@R.add("j17_nested_runs", f"""WITH {B.TRACKING_SQL} SELECT r.id AS run_id, r.experiment_id, r.run_type, r.status, 0::BIGINT AS page,
 (SELECT string_agg(m.name || ':' || m.namespace || ':' || CAST(m.value AS VARCHAR), ';' ORDER BY m.name, m.namespace, m.value) FROM metric m WHERE m.run_id = r.id) AS metrics FROM run r""")
def j17(spark, sf):
    x = T.nested_runs(B.run(spark, sf), B.metric(spark, sf), ORDER)
    item = F.transform("metrics", lambda m: F.concat_ws(":", m["name"], m["namespace"], m["value"].cast("string")))
    return x.withColumn("metrics", F.when(F.col("metrics").isNotNull(), F.array_join(item, ";")))


@R.add("w7_representative_run", f"""WITH {B.TRACKING_SQL} SELECT experiment_id, id AS run_id FROM run
 QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY CASE run_type WHEN 'train' THEN 1 WHEN 'test' THEN 2 ELSE 3 END, start_time, id) = 1""")
def w7(spark, sf):
    return T.representative_run(B.run(spark, sf))


def _base(spark, sf):
    e = B.experiment(spark, sf).select(F.col("id").alias("experiment_id"), "extra")
    r = B.run(spark, sf).select(F.col("id").alias("run_id"), "experiment_id").join(e, "experiment_id")
    return r.select("run_id", *[T.json_number("extra", f"baseline_{b}").alias(f"baseline_{b}") for b in T.BASELINES])


W8_SQL = f"""WITH {B.TRACKING_SQL},
 m AS (SELECT run_id, lower(name) AS metric,
   coalesce(arg_max(CASE WHEN namespace = 'global' THEN value END, CASE WHEN namespace = 'global' THEN row({ORDER_SQL}) END),
            arg_min(CASE WHEN namespace <> 'global' THEN value END, CASE WHEN namespace <> 'global' THEN row({ORDER_SQL}) END)) AS value
   FROM metric WHERE namespace <> 'history' AND lower(name) IN ('accuracy', 'loss', 'f1_macro', 'auc_roc') GROUP BY 1, 2),
 g AS (SELECT r.id AS run_id, n.metric, CAST(json_extract_string(e.extra, '$.baseline_' || n.metric) AS DOUBLE) AS baseline
   FROM run r JOIN experiment e ON e.id = r.experiment_id CROSS JOIN (SELECT unnest(['accuracy','loss','f1_macro','auc_roc','precision','recall']) AS metric) n),
 mt AS (SELECT g.run_id, g.metric, round(m.value, 6) AS value, round(g.baseline, 6) AS baseline, round(m.value - g.baseline, 6) AS delta
   FROM g LEFT JOIN m ON m.run_id = g.run_id AND m.metric = g.metric),
 hh AS (SELECT *, row({ORDER_SQL}) AS k FROM metric WHERE namespace = 'history' AND name IN ('loss', 'val_loss')),
 lg AS (SELECT run_id, count(*) FILTER (name = 'loss') AS nl, count(*) FILTER (name = 'val_loss') AS nv,
   arg_min(value, row(step, k)) FILTER (name = 'val_loss') - arg_min(value, row(step, k)) FILTER (name = 'loss') AS g0,
   arg_max(value, row(step, k)) FILTER (name = 'val_loss') - arg_max(value, row(step, k)) FILTER (name = 'loss') AS g1 FROM hh GROUP BY 1)"""


@R.add("w8_metric_table", f"{W8_SQL} SELECT * FROM mt")
def w8(spark, sf):
    return T.metric_table(B.metric(spark, sf), _base(spark, sf), ORDER)


@R.add("w9_loss_gaps", f"""{W8_SQL} SELECT run_id, round(g0, 6) AS first_gap, round(g1, 6) AS last_gap, coalesce(nl = nv AND nl > 0 AND g1 > g0 * 1.5, false) AS overfit FROM lg""")
def w9(spark, sf):
    x = T.loss_gaps(B.metric(spark, sf), ORDER)
    return x.withColumns({c: F.round(c, 6) for c in ("first_gap", "last_gap")})


@R.add("x6_experiment_cards", f"""{W8_SQL},
 rep AS (SELECT r.*, e.name, e.stage FROM run r JOIN experiment e ON e.id = r.experiment_id
   QUALIFY row_number() OVER (PARTITION BY r.experiment_id ORDER BY CASE run_type WHEN 'train' THEN 1 WHEN 'test' THEN 2 ELSE 3 END, start_time, r.id) = 1),
 al AS (SELECT run_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (category = 'performance_drop') AS d, count(*) FILTER (category = 'qg_failure') AS q FROM alert GROUP BY 1),
 z AS (SELECT rep.experiment_id, rep.id AS run_id, rep.name, rep.stage, rep.status, rep.run_type, coalesce(al.n, 0) AS n_alerts, coalesce(al.c, 0) AS n_critical,
   coalesce(al.d, 0) AS d, coalesce(al.q, 0) AS q, mt.value AS f1_macro, mt.delta AS f1_delta, coalesce(nl = nv AND nl > 0 AND g1 > g0 * 1.5, false) AS overfit,
   CASE WHEN rep.status = 'failed' THEN 'FAILED' WHEN coalesce(al.c, 0) > 0 THEN 'UNSTABLE' WHEN mt.delta < 0 THEN 'REGRESSION' ELSE 'HEALTHY' END AS health_status
   FROM rep JOIN mt ON mt.run_id = rep.id AND mt.metric = 'f1_macro' LEFT JOIN al ON al.run_id = rep.id LEFT JOIN lg ON lg.run_id = rep.id)
SELECT experiment_id, run_id, n_alerts, n_critical, f1_macro, f1_delta, health_status,
 list_aggregate(list_sort(list_distinct([stage, status, run_type, health_status])), 'string_agg', ',') AS tags,
 coalesce(nullif(concat_ws(',', CASE WHEN status = 'failed' THEN 'find_cause' END, CASE WHEN status = 'failed' AND d > 0 THEN 'review_model' END,
  CASE WHEN status = 'failed' AND q > 0 THEN 'adjust_thresholds' END, CASE WHEN status <> 'failed' AND overfit THEN 'overfit' END,
  CASE WHEN status <> 'failed' AND f1_delta < 0 THEN 'regression' END, CASE WHEN status <> 'failed' AND f1_delta > 0 THEN 'new_baseline' END), ''), 'monitor') AS advice,
 'Experiment ' || name || ' (' || stage || ') ended ' || status || CASE WHEN f1_macro IS NOT NULL THEN ', F1-macro ' || printf('%.4f', f1_macro) ELSE '' END ||
  CASE WHEN n_alerts > 0 THEN ' (' || n_alerts || ' alerts, ' || n_critical || ' critical)' ELSE '' END AS summary
FROM z""")
def x6(spark, sf):
    return T.experiment_cards(**tables(spark, sf), order=ORDER)


@R.add("a43_progress", f"""WITH {B.TRACKING_SQL}, c AS (SELECT CASE status WHEN 'completed' THEN 'done' ELSE status END AS state,
  (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS seconds FROM run)
SELECT count(*) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'failed') AS failed,
 round(avg(seconds) FILTER (state = 'done'), 2) AS mean_seconds, 0::BIGINT AS queued,
 round(avg(seconds) FILTER (state = 'done') * count(*) FILTER (state = 'running') / 4, 0) AS eta_seconds FROM c""")
def a43(spark, sf):
    c = B.run(spark, sf).select(
        F.when(F.col("status") == "completed", "done").otherwise(F.col("status")).alias("state"), T.duration_seconds().alias("seconds"))
    return T.progress(c, 4).withColumns({"mean_seconds": F.round("mean_seconds", 2), "eta_seconds": F.round("eta_seconds", 0)})


@R.add("u7_matrix_gaps", f"""WITH {B.TRACKING_SQL}, n AS (SELECT experiment_id, fold_idx, run_type, count(*) AS n FROM run GROUP BY ALL),
 w AS (SELECT e::BIGINT AS experiment_id, f::INTEGER AS fold_idx, t AS run_type FROM (SELECT id AS e FROM experiment), (SELECT unnest(range(0, 6)) AS f), (SELECT unnest(['train', 'test']) AS t))
SELECT * FROM (SELECT experiment_id, fold_idx, run_type, CASE WHEN n.n IS NULL THEN 'missing' WHEN w.run_type IS NULL THEN 'unexpected' WHEN n.n > 1 THEN 'duplicate' END AS problem,
 coalesce(n.n, 0) AS n FROM (SELECT *, 1 AS one FROM w) w FULL JOIN n USING (experiment_id, fold_idx, run_type)) WHERE problem IS NOT NULL""")
def u7(spark, sf):
    declared = B.experiment(spark, sf).select(F.col("id").alias("experiment_id"))
    dims = {"fold_idx": list(range(6)), "run_type": ["train", "test"]}
    return T.matrix_gaps(B.run(spark, sf).select("experiment_id", *dims), dims, declared)
