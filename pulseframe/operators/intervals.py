"""Interval joins on time buckets, so that a long or busy record is many small equi joins."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .ordering import running, shifted, time_bucket


ISLANDS = 5000


def close_intervals(
    marks: DataFrame, keys: Sequence[str], start: str, bucket_width: float, end: str = "end"
) -> DataFrame:
    """Each mark holds until the next one of its record; the last stays open (null)."""
    return shifted(marks, keys, time_bucket(start, bucket_width), [F.col(start)], {end: (start, -1)})


def runs_of_equal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket_width: float
) -> DataFrame:
    """First row of each run of equal values: the change points of a record."""
    x = shifted(df, keys, time_bucket(order[0], bucket_width), [F.col(c) for c in order], {"_pv": (value, 1)})
    return x.filter(F.col("_pv").isNull() | (F.col("_pv") != F.col(value))).drop("_pv")


def _spread(iv: DataFrame, keys: Sequence[str], start: str, end: str, width: float) -> DataFrame:
    lo, hi = time_bucket(start, width), time_bucket(F.col(end), width)
    return iv.withColumn("_bin", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def label_points(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    point: str,
    start: str,
    end: str,
    label: str,
    width: float,
    default: str | None = None,
) -> DataFrame:
    """Label of the half-open interval [start, end) that holds each point.

    Open intervals (null end) are closed just after the last point of their record.
    """
    last = points.groupBy(*keys).agg((F.max(point) + 1).alias("_last"))
    iv = intervals.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(label).alias("_lab"))
    iv = iv.join(last, list(keys), "inner").withColumn("_e", F.coalesce("_e", F.greatest(F.col("_last"), F.col("_s") + 1)))
    iv = _spread(iv.filter("_e > _s"), keys, "_s", "_e", width).drop("_last")
    p = points.withColumn("_bin", time_bucket(point, width)).alias("p")
    cond = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_bin"]]
    cond.append((F.col("i._s") <= F.col(f"p.{point}")) & (F.col(f"p.{point}") < F.col("i._e")))
    joined = p.join(iv.alias("i"), cond, "left")
    lab = F.col("i._lab") if default is None else F.coalesce(F.col("i._lab"), F.lit(default))
    return joined.select("p.*", lab.alias(label)).drop("_bin")


def contained_episodes(
    episodes: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    width: float,
    start: str = "start",
    end: str = "end",
    label: str = "rhythm",
) -> DataFrame:
    """The first interval that fully contains each episode; label null at a boundary.

    An interval is spread over the buckets it touches and an episode looks up the bucket of
    its own start, so each containing interval is met once. An open interval (null end) lasts to
    the end of its record: that is, at least to the end of its last episode.
    """
    last = episodes.groupBy(*keys).agg(F.max(end).alias("_last"))
    iv = intervals.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(label).alias("_lab"))
    iv = iv.join(last, list(keys)).withColumn("_e", F.coalesce("_e", F.greatest("_last", F.col("_s") + 1))).drop("_last")
    iv = _spread(iv.filter("_e > _s"), keys, "_s", "_e", width)
    ep = episodes.withColumn("_bin", time_bucket(start, width)).alias("p")
    cond = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_bin"]]
    cond.append((F.col("i._s") <= F.col(f"p.{start}")) & (F.col(f"p.{end}") <= F.col("i._e")))
    joined = ep.join(iv.alias("i"), cond, "left")
    first = joined.groupBy(*[F.col(f"p.{c}") for c in episodes.columns]).agg(
        F.min(F.struct(F.col("i._s").alias("s"), F.col("i._e").alias("e"), F.col("i._lab").alias("l"))).alias("_m")
    )
    return first.select(
        *episodes.columns,
        F.col("_m.s").alias("interval_start"),
        F.col("_m.e").alias("interval_end"),
        F.col("_m.l").alias(label),
    )


def contained_grid(
    spans: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    step: int,
    first: str = "first",
    last: str = "last",
    start: str = "start",
    end: str = "end",
    label: str = "rhythm",
) -> DataFrame:
    """J4 on a regular grid: episodes of each record per label of the interval that fully contains them.

    A record of `spans` has the episodes [i * step, (i + 1) * step) for i from `first` to `last`.
    An interval contains a range of them, so its episodes are counted and never become rows;
    those in no interval count under a null label. Intervals of a record must not overlap (see
    `close_intervals`); an open one (null end) lasts to the last episode. Returns keys, label, n.
    """
    iv = intervals.select(*keys, F.col(label), (-time_bucket(-F.col(start), step)).alias("_lo"), (time_bucket(end, step) - 1).alias("_hi"))
    iv = iv.filter("_lo is not null and (_hi is null or _lo <= _hi)")
    all_ = spans.select(*keys, F.col(first).alias("_first"), F.col(last).alias("_last")).filter("_first <= _last")
    n = F.least(F.coalesce("_hi", "_last"), "_last") - F.greatest("_lo", "_first") + 1
    inside = iv.join(all_, list(keys)).withColumn("_n", n).filter("_n > 0")
    # what lies in an interval is taken off the rest, so one aggregation gives both
    none = F.lit(None).cast(dict(iv.dtypes)[label])
    parts = F.array(F.struct(F.col(label).alias("l"), F.col("_n").alias("n")), F.struct(none.alias("l"), (-F.col("_n")).alias("n")))
    x = inside.select(*keys, F.inline(parts)).union(all_.select(*keys, none, F.col("_last") - F.col("_first") + 1))
    return x.groupBy(*keys, F.col("l").alias(label)).agg(F.sum("n").alias("n")).filter("n > 0")


def _greedy(tol: float):
    def match(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "is_truth", "rid"], kind="stable")
        truth = pdf[pdf.is_truth == 1]
        det = pdf[pdf.is_truth == 0]
        dt, dr = det.t.to_numpy(), det.rid.to_numpy()
        out, lo, used = [], 0, set()
        for t, r in zip(truth.t.to_numpy(), truth.rid.to_numpy()):
            while lo < len(dt) and (dt[lo] < t - tol or lo in used):
                lo += 1
            j = lo
            while j < len(dt) and j in used:
                j += 1
            if j < len(dt) and dt[j] <= t + tol:
                used.add(j)
                out.append((r, dr[j]))
        return pd.DataFrame(out, columns=["truth_id", "det_id"], dtype="int64")

    return match


def match_peaks(
    truth: DataFrame, detected: DataFrame, record: str, time: str, rid: str, tol: float, bucket_width: float
) -> DataFrame:
    """(record, truth_id, det_id) pairs; each truth in order takes the first free detection.

    The two streams of a record fall apart wherever consecutive events are more than the
    tolerance apart, and no match can cross such a gap. The greedy pass therefore runs on
    batches of ISLANDS consecutive islands; for beats (intervals above twice the tolerance)
    an island holds one or two events.
    """
    both = truth.select(record, F.col(time).alias("t"), F.col(rid).alias("rid"), F.lit(1).alias("is_truth")).unionByName(
        detected.select(record, F.col(time).alias("t"), F.col(rid).alias("rid"), F.lit(0).alias("is_truth"))
    )
    order = [F.col("t"), F.col("is_truth"), F.col("rid")]
    x = shifted(both, [record], time_bucket("t", bucket_width), order, {"_pt": ("t", 1)})
    new = F.when(F.col("_pt").isNull() | (F.col("t") - F.col("_pt") > F.lit(tol)), 1).otherwise(0)
    x = running(x.withColumn("_new", new), [record], time_bucket("t", bucket_width), order, {"island": F.col("_new")})
    return (
        x.select(record, F.floor(F.col("island") / ISLANDS).alias("batch"), "t", "rid", "is_truth")
        .groupBy(record, "batch")
        .applyInPandas(
            lambda key, pdf: _greedy(tol)(key, pdf).assign(**{record: key[0]})[[record, "truth_id", "det_id"]],
            schema=f"{record} {dict(both.dtypes)[record]}, truth_id long, det_id long",
        )
    )


def match_scores(truth: DataFrame, detected: DataFrame, pairs: DataFrame, record: str) -> DataFrame:
    """TP, FN, FP, sensitivity, precision and F1 per record."""
    parts = [
        truth.groupBy(record).agg(F.count("*").alias("n_true")).withColumn("n_det", F.lit(0)).withColumn("tp", F.lit(0)),
        detected.groupBy(record).agg(F.count("*").alias("n_det")).withColumn("n_true", F.lit(0)).withColumn("tp", F.lit(0)),
        pairs.groupBy(record).agg(F.count("*").alias("tp")).withColumn("n_true", F.lit(0)).withColumn("n_det", F.lit(0)),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    a = u.groupBy(record).agg(*[F.sum(c).cast("long").alias(c) for c in ("n_true", "n_det", "tp")])
    sens = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    ppv = F.when(F.col("n_det") > 0, F.col("tp") / F.col("n_det")).otherwise(0.0)
    return (
        a.withColumn("fn", F.col("n_true") - F.col("tp"))
        .withColumn("fp", F.col("n_det") - F.col("tp"))
        .withColumn("sens", sens)
        .withColumn("ppv", ppv)
        .withColumn("f1", F.when(F.col("sens") + F.col("ppv") > 0, F.col("sens") * F.col("ppv") * 2 / (F.col("sens") + F.col("ppv"))).otherwise(0.0))
    )
