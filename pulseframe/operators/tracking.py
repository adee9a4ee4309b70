"""Experiment tracking: consolidated timeline, pages, named queries, summaries."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .ordering import hash_bucket, numbered, stable_hash

BASELINES = ["accuracy", "loss", "f1_macro", "auc_roc"]
MAX_PAGE = 1000


def json_text(col: str | Column, key: str) -> Column:
    return F.get_json_object(col, f"$.{key}")


def json_number(col: str | Column, key: str) -> Column:
    """Numeric field of a JSON column; text that is not a number gives null."""
    return json_text(col, key).try_cast("double")


def duration_seconds(start: str = "start_time", end: str = "end_time") -> Column:
    """Seconds between two timestamps, two decimals, null while open."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 2)


def health(status: Column, critical: Column, f1: Column, baseline: Column) -> Column:
    """P25: FAILED, then UNSTABLE, then REGRESSION, else HEALTHY."""
    return (
        F.when(status == "failed", "FAILED")
        .when(critical > 0, "UNSTABLE")
        .when(f1 < baseline, "REGRESSION")
        .otherwise("HEALTHY")
    )


def run_metrics(metric: DataFrame) -> DataFrame:
    """Best global value per run of the metrics that the timeline shows, one row per run."""
    g = metric.filter("namespace = 'global'")
    low = F.lower("name")

    def best(cond: Column) -> Column:
        return F.max(F.when(cond, F.col("value")))

    return g.groupBy("run_id").agg(
        best(F.col("name") == "accuracy").alias("final_accuracy"),
        best(F.col("name") == "loss").alias("final_loss"),
        F.coalesce(best(low == "f1_macro"), best(low == "f1-macro")).alias("final_f1_macro"),
        best(low == "auc_roc").alias("final_auc_roc"),
    )


def run_alerts(alert: DataFrame) -> DataFrame:
    """Distinct alerts per run and severity; the ids are deduplicated before the pivot."""
    ids = alert.filter("run_id is not null").select("run_id", "severity", "id").distinct()
    return ids.groupBy("run_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_alerts") for s in ("critical", "warning", "info")]
    )


def timeline(experiment: DataFrame, run: DataFrame, metric: DataFrame, alert: DataFrame) -> DataFrame:
    """One row per run. Children are aggregated first, so nothing fans out."""
    e = experiment.select(
        F.col("id").alias("experiment_id"),
        F.col("name").alias("experiment_name"),
        "stage",
        "owner_id",
        json_text("extra", "model_name").alias("_em"),
        *[json_number("extra", f"baseline_{b}").alias(f"baseline_{b}") for b in BASELINES],
    )
    r = run.select(
        F.col("id").alias("run_id"),
        "experiment_id",
        "run_type",
        "status",
        F.col("start_time").alias("run_start"),
        F.col("end_time").alias("finished_at"),
        duration_seconds().alias("duration_seconds"),
        json_text("extra", "model_name").alias("_rm"),
    )
    x = r.join(e, "experiment_id").join(run_metrics(metric), "run_id", "left").join(run_alerts(alert), "run_id", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("critical_alerts", "warning_alerts", "info_alerts")}
    return x.withColumns(counts).select(
        "run_id", "experiment_id", "experiment_name", "stage", "owner_id",
        F.coalesce("_rm", "_em", "experiment_name").alias("model_name"),
        "run_type", "status", "run_start", "finished_at", "duration_seconds",
        "final_accuracy", "final_loss", "final_f1_macro", "final_auc_roc",
        *[f"baseline_{b}" for b in BASELINES],
        (F.col("final_f1_macro") - F.col("baseline_f1_macro")).alias("f1_macro_delta"),
        *counts,
        health(F.col("status"), F.col("critical_alerts"), F.col("final_f1_macro"), F.col("baseline_f1_macro")).alias("health_status"),
    )


# Columns a page may be sorted by.
SORTABLE = [
    "run_id", "experiment_id", "experiment_name", "stage", "model_name", "run_type", "status", "run_start",
    "finished_at", "duration_seconds", "final_accuracy", "final_loss", "final_f1_macro", "final_auc_roc",
    "baseline_accuracy", "baseline_loss", "baseline_f1_macro", "baseline_auc_roc", "f1_macro_delta",
    "critical_alerts", "warning_alerts", "info_alerts", "health_status",
]


@dataclass(frozen=True)
class TimelineFilter:
    """Optional predicates and the page of a timeline query."""

    stage: str | None = None
    status: str | None = None
    health_status: str | None = None
    run_type: str | None = None
    model_name: str | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    min_f1_macro: float | None = None
    max_critical_alerts: int | None = None
    limit: int = 100
    offset: int = 0
    sort_by: str = "run_start"
    sort_desc: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= MAX_PAGE or self.offset < 0:
            raise ValueError("page out of range")
        if self.sort_by not in SORTABLE:
            raise ValueError(f"cannot sort by {self.sort_by}")
        if self.date_from and self.date_to and self.date_to < self.date_from:
            raise ValueError("date_to before date_from")

    def apply(self, df: DataFrame) -> DataFrame:
        for f in fields(self)[:5]:
            v = getattr(self, f.name)
            if v is not None:
                df = df.filter(F.col(f.name) == v)
        tests = [
            (self.date_from, lambda v: F.col("run_start") >= F.lit(v)),
            (self.date_to, lambda v: F.col("run_start") <= F.lit(v)),
            (self.min_f1_macro, lambda v: F.col("final_f1_macro") >= v),
            (self.max_critical_alerts, lambda v: F.col("critical_alerts") <= v),
        ]
        for v, test in tests:
            if v is not None:
                df = df.filter(test(v))
        return df


def timeline_page(tl: DataFrame, flt: TimelineFilter) -> DataFrame:
    """Sorted page with the total number of matching rows in every row."""
    hits = flt.apply(tl)
    total = hits.agg(F.count("*").alias("total"))
    key = F.col(flt.sort_by).desc_nulls_last() if flt.sort_desc else F.col(flt.sort_by).asc_nulls_first()
    page = hits.orderBy(key, F.desc("run_id")).offset(flt.offset).limit(flt.limit)
    return page.join(F.broadcast(total))  # total is one row


def where(df: DataFrame, equals: dict[str, object], order: list[Column], limit: int | None = None) -> DataFrame:
    """List query; predicates whose value is None are left out."""
    for c, v in equals.items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def capped(df: DataFrame, order: list[Column], cap: int = MAX_PAGE) -> DataFrame:
    """At most `cap` rows, each with a flag telling that more exist."""
    return flagged(df.orderBy(*order).limit(cap + 1), cap)


def flagged(head: DataFrame, cap: int) -> DataFrame:
    """The first `cap` of at most cap + 1 rows, with a flag telling that there was one more; the source is read once."""
    n = F.count(F.lit(1)).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # over cap + 1 rows at most
    return head.select("*", (n > cap).alias("truncated")).limit(cap)


class NamedQueries:
    """T5: the six catalogued questions as typed functions; `truncated` tells that more rows than the cap exist."""

    def __init__(self, experiment: DataFrame, run: DataFrame, metric: DataFrame, alert: DataFrame, cap: int = MAX_PAGE):
        self.e, self.r, self.m, self.a, self.cap = experiment, run, metric, alert, cap

    def _runs(self) -> DataFrame:
        e = self.e.select(F.col("id").alias("experiment_id"), F.col("name").alias("experiment_name"), "stage")
        return self.r.withColumnRenamed("id", "run_id").join(e, "experiment_id")

    def _latest(self, df: DataFrame, by: str, tie: str) -> DataFrame:
        return capped(df, [F.desc(by), F.desc(tie)], self.cap)

    def last_failed_runs(self) -> DataFrame:
        x = self._runs().filter("status = 'failed'")
        return self._latest(x.select("run_id", "experiment_name", "run_type", "status", "start_time", "end_time"), "start_time", "run_id")

    def runs_by_stage(self, stage: str) -> DataFrame:
        x = self._runs().filter(F.col("stage") == stage)
        return self._latest(x.select("run_id", "experiment_name", "stage", "run_type", "status", "start_time"), "start_time", "run_id")

    def alerts_by_severity(self, severity: str) -> DataFrame:
        e = self.e.select(F.col("id").alias("experiment_id"), F.col("name").alias("experiment_name"))
        r = self.r.select(F.col("id").alias("run_id"), "experiment_id")
        # the page is cut first, then decorated: the joins see at most `cap` alerts
        a = capped(self.a.filter(F.col("severity") == severity), [F.desc("recorded_at"), F.desc("id")], self.cap)
        if "experiment_id" not in a.columns:
            a = a.join(r, "run_id", "left")
        return a.join(e, "experiment_id", "left").select("id", "severity", "category", "run_id", "experiment_name", "recorded_at", "truncated")

    def timeline(self) -> DataFrame:
        return self._latest(timeline(self.e, self.r, self.m, self.a), "run_start", "run_id")

    def timeline_health(self, status: str) -> DataFrame:
        x = timeline(self.e, self.r, self.m, self.a).filter(F.col("health_status") == status)
        return self._latest(x, "run_start", "run_id")

    def metrics_for_run(self, run_id: int) -> DataFrame:
        m = self.m.filter(F.col("run_id") == run_id).join(self.r.select(F.col("id").alias("run_id")), "run_id", "left_semi")
        return capped(m.select("namespace", "name", "value", "step"), [F.col(c) for c in ("namespace", "name", "step", "value")], self.cap)


def schema_help(tables: dict[str, DataFrame], relations: list[tuple[str, str]] = ()) -> DataFrame:
    """Columns of every table and the declared relations, as rows."""
    spark = next(iter(tables.values())).sparkSession
    rows = [("column", t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    rows += [("relation", a, "", b) for a, b in relations]
    return spark.createDataFrame(rows, "kind string, table string, name string, detail string")


def best_metric(metric: DataFrame, run: DataFrame, name: str, namespace: str = "global", maximize: bool = True) -> DataFrame:
    """A5: best value of one metric per experiment."""
    m = metric.filter((F.col("name") == name) & (F.col("namespace") == namespace))
    x = m.join(run.select(F.col("id").alias("run_id"), "experiment_id"), "run_id")
    agg = F.max("value") if maximize else F.min("value")
    return x.groupBy("experiment_id").agg(agg.alias("best_value"))


def experiment_summary(experiment: DataFrame, run: DataFrame, metric: DataFrame, alert: DataFrame, name: str = "F1_macro") -> DataFrame:
    """Per experiment the best metric, number of runs and of unresolved alerts."""
    runs = run.groupBy("experiment_id").agg(F.count("*").alias("n_runs"))
    open_alerts = alert.filter("not resolved").join(run.select(F.col("id").alias("run_id"), "experiment_id"), "run_id")
    alerts = open_alerts.groupBy("experiment_id").agg(F.count("*").alias("n_alerts"))
    e = experiment.select(F.col("id").alias("experiment_id"), "name", "stage")
    x = e.join(runs, "experiment_id", "left").join(alerts, "experiment_id", "left")
    x = x.join(best_metric(metric, run, name), "experiment_id", "left")
    return x.fillna(0, ["n_runs", "n_alerts"])


def nested_runs(run: DataFrame, metric: DataFrame, order: list[str], page: int = 200) -> DataFrame:
    """Runs with their metrics nested, in pages of at most `page` metrics.

    A run of any size becomes several bounded rows instead of one unbounded list.
    """
    h = hash_bucket(stable_hash(*order))
    m = numbered(metric.withColumn("_b", h), ["run_id"], F.col("_b"), [F.col("_b"), *map(F.col, order)])
    pages = m.groupBy("run_id", F.floor((F.col("rn") - 1) / page).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("name", "namespace", "value"))).alias("metrics")
    )
    r = run.select(F.col("id").alias("run_id"), "experiment_id", "run_type", "status")
    return r.join(pages, "run_id", "left").withColumn("page", F.coalesce("page", F.lit(0).cast("long")))


def representative_run(run: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """The explicit run if given, else first train, else first test, else first run."""
    rank = F.when(F.col("run_type") == "train", 1).when(F.col("run_type") == "test", 2).otherwise(3)
    x = run
    if explicit is not None:
        x = x.join(explicit.select("experiment_id", F.col("run_id").alias("_want")), "experiment_id", "left")
        rank = F.when(F.col("id") == F.col("_want"), 0).otherwise(rank)
    pick = F.min(F.struct(rank.alias("p"), F.coalesce("start_time", F.timestamp_micros(F.lit(0))).alias("t"), F.col("id").alias("id")))
    return x.groupBy("experiment_id").agg(pick.alias("m")).select("experiment_id", F.col("m.id").alias("run_id"))


# Rows of the metric table.
SHOWN_METRICS = ["accuracy", "loss", "f1_macro", "auc_roc", "precision", "recall"]


def metric_table(metric: DataFrame, baselines: DataFrame, order: list[str]) -> DataFrame:
    """Value, baseline and delta per run and metric; the last global value wins, else the first other.

    `baselines` has run_id and baseline_* columns; `order` ranks duplicates.
    """
    m = metric.filter(F.col("namespace").isin("global", "per_class")).withColumn("metric", F.lower("name"))
    m = m.filter(F.col("metric").isin(SHOWN_METRICS))
    at = F.struct(*order, "value")
    is_global = F.col("namespace") == "global"
    v = m.groupBy("run_id", "metric").agg(
        F.coalesce(F.max(F.when(is_global, at))["value"], F.min(F.when(~is_global, at))["value"]).alias("value")
    )
    names = F.array(*[F.lit(n) for n in SHOWN_METRICS])
    base = F.create_map(*[c for b in BASELINES for c in (F.lit(b), F.col(f"baseline_{b}"))])
    grid = baselines.select("run_id", F.explode(names).alias("metric"), base.alias("_b"))
    x = grid.join(v, ["run_id", "metric"], "left").withColumn("baseline", F.try_element_at("_b", F.col("metric")))
    return x.select(
        "run_id", "metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"),
        F.round(F.col("value") - F.col("baseline"), 6).alias("delta"),
    )


def loss_gaps(metric: DataFrame, order: list[str]) -> DataFrame:
    """First and last validation gap of each run and the overfit signal."""
    h = metric.filter("namespace = 'history' and step is not null").filter(F.col("name").isin("loss", "val_loss"))
    at = F.struct("step", *order)
    out = []
    for n in ("loss", "val_loss"):
        v = F.when(F.col("name") == n, F.struct(at.alias("k"), F.col("value").alias("v")))
        out += [F.count_if(F.col("name") == n).alias(f"n_{n}"), F.min(v)["v"].alias(f"first_{n}"), F.max(v)["v"].alias(f"last_{n}")]
    x = h.groupBy("run_id").agg(*out)
    gap0, gap1 = F.col("first_val_loss") - F.col("first_loss"), F.col("last_val_loss") - F.col("last_loss")
    over = (F.col("n_loss") == F.col("n_val_loss")) & (F.col("n_loss") > 0) & (gap1 > gap0 * 1.5)
    return x.select("run_id", gap0.alias("first_gap"), gap1.alias("last_gap"), F.coalesce(over, F.lit(False)).alias("overfit"))


def recommendations(status: Column, drop: Column, gate: Column, overfit: Column, delta: Column) -> Column:
    """Codes of the advice given for a run, joined by commas."""
    failed = status == "failed"
    codes = F.array(
        F.when(failed, "find_cause"),
        F.when(failed & drop, "review_model"),
        F.when(failed & gate, "adjust_thresholds"),
        F.when(~failed & overfit, "overfit"),
        F.when(~failed & (delta < 0), "regression"),
        F.when(~failed & (delta > 0), "new_baseline"),
    )
    joined = F.array_join(F.array_compact(codes), ",")
    return F.when(joined == "", "monitor").otherwise(joined)


def experiment_cards(experiment: DataFrame, run: DataFrame, metric: DataFrame, alert: DataFrame, order: list[str]) -> DataFrame:
    """Summary row of each experiment's representative run."""
    e = experiment.select(F.col("id").alias("experiment_id"), "name", "stage", F.col("extra").alias("_ee"))
    r = representative_run(run).join(run.drop("experiment_id").withColumnRenamed("id", "run_id"), "run_id").join(e, "experiment_id")
    base = r.select(
        "run_id",
        *[F.coalesce(json_number("extra", f"baseline_{b}"), json_number("_ee", f"baseline_{b}")).alias(f"baseline_{b}") for b in BASELINES],
    )
    f1 = metric_table(metric.join(base.select("run_id"), "run_id", "left_semi"), base, order).filter("metric = 'f1_macro'")
    a = alert.groupBy("run_id").agg(
        F.count("*").alias("n_alerts"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("category") == "performance_drop").alias("_drop"),
        F.count_if(F.col("category") == "qg_failure").alias("_gate"),
    )
    x = r.join(f1.select("run_id", "value", "delta"), "run_id").join(a, "run_id", "left").join(loss_gaps(metric, order), "run_id", "left")
    x = x.fillna(0, ["n_alerts", "n_critical", "_drop", "_gate"]).fillna({"overfit": False})
    h = health(F.col("status"), F.col("n_critical"), F.when(F.col("delta").isNotNull(), F.col("delta")), F.lit(0.0))
    tags = F.array_join(F.array_sort(F.array_distinct(F.array("stage", "status", "run_type", h))), ",")
    text = F.concat(
        F.format_string("Experiment %s (%s) ended %s", "name", "stage", "status"),
        F.when(F.col("value").isNotNull(), F.format_string(", F1-macro %.4f", "value")).otherwise(""),
        F.when(F.col("n_alerts") > 0, F.format_string(" (%d alerts, %d critical)", "n_alerts", "n_critical")).otherwise(""),
    )
    return x.select(
        "experiment_id", "run_id", "n_alerts", "n_critical", F.col("value").alias("f1_macro"), F.col("delta").alias("f1_delta"),
        h.alias("health_status"), tags.alias("tags"),
        recommendations(F.col("status"), F.col("_drop") > 0, F.col("_gate") > 0, F.col("overfit"), F.col("delta")).alias("advice"),
        text.alias("summary"),
    )


def progress(cells: DataFrame, workers: int = 1) -> DataFrame:
    """Done, running, failed and queued cells, mean duration and remaining seconds."""
    a = cells.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "done").alias("done"),
        F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.avg(F.when(F.col("state") == "done", F.col("seconds"))).alias("mean_seconds"),
    )
    left = F.col("total") - F.col("done") - F.col("failed")
    return a.withColumn("queued", left - F.col("running")).withColumn("eta_seconds", F.col("mean_seconds") * left / workers)


def matrix_gaps(actual: DataFrame, dims: dict[str, list], declared: DataFrame | None = None) -> DataFrame:
    """Cells of the declared matrix that are missing, unexpected or duplicated.

    The declared lists are configuration; they are expanded from literals, not joined. `declared`
    holds the keys of a table (one row each) for which the lists are expected.
    """
    spark = actual.sparkSession
    want = declared if declared is not None else spark.range(1).drop("id")
    for c, vals in dims.items():
        want = want.withColumn(c, F.explode(F.lit(vals).cast(f"array<{dict(actual.dtypes)[c]}>")))
    keys = want.columns
    n = actual.groupBy(*keys).agg(F.count("*").alias("n"))
    x = want.withColumn("_want", F.lit(True)).join(n, keys, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return x.withColumn("problem", problem).filter("problem is not null").select(*keys, "problem", F.coalesce("n", F.lit(0)).alias("n"))


def append_rows(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Append child rows, partitioned by the given columns."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def build_experiment_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tracking tables stored under one root."""
    return {t: spark.read.parquet(f"{root}/{t}") for t in ("experiment", "run", "metric", "alert")}
