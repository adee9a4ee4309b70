"""Structured Streaming jobs: refreshed timeline, progress, metric append, stateful beat features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequences import CAUSAL_FEATURES, causal_expressions


def refresh_snapshot(source: DataFrame, rebuild: Callable[[SparkSession], DataFrame], target: str, checkpoint: str, seconds: int = 300, once: bool = False) -> StreamingQuery:
    """ST1: on every trigger with new rows, rebuild the table and write a new version of it.

    A version is a directory of its own, so readers never see a half-written snapshot;
    a restarted batch overwrites its own version only.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rebuild(batch.sparkSession).write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    w = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")).start()


def latest_snapshot(spark: SparkSession, target: str) -> DataFrame:
    df = spark.read.parquet(target)
    last = df.select(F.max("version").alias("_v"))
    return df.join(F.broadcast(last), F.col("version") == F.col("_v")).drop("_v", "version")  # one row


def epoch_metrics(stream: DataFrame, keys: list[str], step: str, names: list[str]) -> DataFrame:
    """ST3: wide epoch rows to metric rows, ready for an append sink."""
    x = stream.select(*keys, step, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("m"))
    return x.select(*keys, F.lit("history").alias("namespace"), "m.name", "m.value", (F.col(step) + 1).alias("step")).filter("value is not null")


def live_progress(stream: DataFrame, state: str = "state") -> DataFrame:
    """ST4: running count per state (complete mode)."""
    return stream.groupBy(state).agg(F.count("*").alias("n"))


BUCKETS = 256  # groups of records; a group is one call of Python per batch, whatever the number of its records


def _stateful(fn: Callable, depth: int, extra: str, record: str, ident: str, peak: str, df: DataFrame, event_time: str | None, delay: str, ttl_ms: int | None) -> DataFrame:
    """State of a bucket of records: the last `depth` peaks of every record and, with an event time, the beats still waiting.

    With an event time a beat waits until the watermark has passed it and is then placed in event
    order, whatever the order of arrival; a record is forgotten `ttl_ms` after its last beat (None: never). A
    row without a record id only moves the watermark (a heartbeat). Without an event time, beats
    are placed as they come. A beat that comes out before one already placed is returned with
    late = true and nothing else; rows behind the watermark on arrival are counted by the engine,
    see `late_rows`.

    fn(peaks, at) gives the new columns of all rows of a bucket, records one after the other, `at` the row's position in its record.
    """
    types = dict(df.dtypes)
    if event_time is not None:
        df = df.withWatermark(event_time, delay)
    bucket = F.when(F.col(record).isNotNull(), F.pmod(F.xxhash64(record), F.lit(BUCKETS)))
    at = [] if event_time is None else [event_time, F.unix_millis(F.col(event_time).cast("timestamp")).alias("_ms")]
    cols = [bucket.alias("_bucket"), record, ident, F.col(peak).cast("long").alias(peak), *at]
    state_schema = f"ring_record array<{types[record]}>, ring_peak array<long>, ring_ms array<long>, wait_record array<{types[record]}>, wait_peak array<long>, wait_id array<{types[ident]}>, wait_ms array<long>"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if k[0] is None or k[0] != k[0]:  # heartbeats; a filter would be pushed below the watermark
            return
        old = state.get if state.exists else [[] for _ in range(7)]
        ring = pd.DataFrame({"record": pd.Series(old[0], dtype=object), "peak": np.array(old[1], np.int64), "ms": np.array(old[2], np.int64)})
        parts = [pd.DataFrame({"record": pd.Series(old[3], dtype=object), "peak": np.array(old[4], np.int64), "id": pd.Series(old[5], dtype=object), "ms": np.array(old[6], np.int64)})]
        for b in batches if not state.hasTimedOut else ():
            ms = np.zeros(len(b), np.int64) if event_time is None else b["_ms"].to_numpy(np.int64)
            parts.append(pd.DataFrame({"record": b[record].astype(object), "peak": b[peak].to_numpy(np.int64), "id": b[ident].astype(object), "ms": ms}))
        wait = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        now = None if event_time is None else state.getCurrentWatermarkMs()
        code = pd.factorize(pd.concat([ring["record"], wait["record"]], ignore_index=True))[0]
        ring["code"], wait["code"] = code[: len(ring)], code[len(ring) :]
        last = np.full(int(code.max(initial=-1)) + 1, np.iinfo(np.int64).min)
        np.maximum.at(last, ring["code"].to_numpy(), ring["peak"].to_numpy())
        wait = wait.sort_values(["code", "peak", "id"], kind="stable", ignore_index=True)
        ready = np.ones(len(wait), bool) if now is None else wait["ms"].to_numpy() <= now
        behind = ready & (wait["peak"].to_numpy() < last[wait["code"].to_numpy()])
        placed, lost, left = wait[ready & ~behind], wait[behind], wait[~ready]
        # peaks of a record: those it had, then the new ones
        seq = pd.concat([ring.assign(new=False), placed[["record", "peak", "code"]].assign(ms=now or 0, new=True)], ignore_index=True).sort_values("code", kind="stable", ignore_index=True)
        codes, new = seq["code"].to_numpy(), seq["new"].to_numpy(bool)
        at, count = seq.groupby("code").cumcount().to_numpy(), np.bincount(codes, minlength=len(last))
        out = fn(seq["peak"].to_numpy(np.int64), at)[new].reset_index(drop=True)
        out.insert(0, ident, placed["id"].infer_objects().to_numpy())
        out.insert(0, record, placed["record"].infer_objects().to_numpy())
        out["late"] = False
        if len(lost):
            gone = pd.DataFrame({record: lost["record"].to_numpy(), ident: lost["id"].to_numpy(), "late": True}).reindex(columns=out.columns)
            out = pd.concat([out.astype(object), gone.astype(object)], ignore_index=True)
        ring = seq[at >= count[codes] - depth]
        if now is not None and ttl_ms is not None:
            active = np.zeros(len(last), bool)
            active[left["code"].to_numpy()] = True
            seen = np.full(len(last), np.iinfo(np.int64).min)
            np.maximum.at(seen, codes, seq["ms"].to_numpy(np.int64))
            at_code = ring["code"].to_numpy()
            ring = ring[active[at_code] | (seen[at_code] + ttl_ms > now)]
        if event_time is not None and not len(ring) and not len(left):
            if state.exists:
                state.remove()
        else:
            state.update((*[ring[c].tolist() for c in ("record", "peak", "ms")], *[left[c].tolist() for c in ("record", "peak", "id", "ms")]))
            if event_time is not None and (len(left) or ttl_ms is not None):
                state.setTimeoutTimestamp(max(int(left["ms"].min()), now + 1) if len(left) else max(int(ring["ms"].min()) + ttl_ms, now + 1))
        if len(out):
            yield out

    timeout = GroupStateTimeout.NoTimeout if event_time is None else GroupStateTimeout.EventTimeTimeout
    schema = f"{record} {types[record]}, {ident} {types[ident]}, {extra}, late boolean"
    return df.select(*cols).groupBy("_bucket").applyInPandasWithState(run, schema, state_schema, "append", timeout)


def late_rows(query: StreamingQuery) -> int:
    """Rows that arrived behind the watermark so far; the engine leaves them out."""
    return sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in p["stateOperators"])


def causal_stream(stream: DataFrame, record: str, ident: str, peak: str, fs: float, event_time: str | None = None, delay: str = "10 minutes", ttl_ms: int | None = 3_600_000) -> DataFrame:
    """ST5: the causal RR features on an unbounded beat stream, with a flag `late`; see _stateful.

    State per record is its last four peaks and the beats that wait for the watermark.
    """
    lags = [f"_l{i}" for i in range(5)]

    def step(peaks: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        row = np.arange(len(peaks))
        return pd.DataFrame({c: pd.arrays.IntegerArray(peaks[np.maximum(row - i, 0)], at < i) for i, c in enumerate(lags)})

    x = _stateful(step, 4, ", ".join(f"{c} long" for c in lags), record, ident, peak, stream, event_time, delay, ttl_ms)
    rr = [(F.col(lags[i]) - F.col(lags[i + 1])) * F.lit(1000.0 / fs) for i in range(4)]
    return x.select(record, ident, F.col("_l0").alias(peak), *[causal_expressions(rr)[n].alias(n) for n in CAUSAL_FEATURES], "late")


def stability_stream(stream: DataFrame, record: str, ident: str, peak: str, threshold_ms: float, threshold_ratio: float, window: int = 5, minimum: int = 3, fs: float = 1000.0, event_time: str | None = None, delay: str = "10 minutes", ttl_ms: int | None = 3_600_000) -> DataFrame:
    """ST2: skip flag from the last five intervals of each record, with a flag `late`; see _stateful."""
    def step(peaks: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        rr = np.diff(peaks.astype("float64"), prepend=np.nan) * 1000.0 / fs
        # one row per beat: its last `window` intervals, NaN where there are fewer
        back = np.arange(window - 1, -1, -1)[None, :]
        ring = np.where(at[:, None] - back >= 1, rr[np.maximum(np.arange(len(peaks))[:, None] - back, 0)], np.nan)
        have = (~np.isnan(ring)).sum(axis=1)
        mean = np.nansum(ring, axis=1) / np.maximum(have, 1)
        dev = np.nanmax(np.where(have[:, None] > 0, np.abs(ring - mean[:, None]), 0.0), axis=1, initial=0.0)
        ok = (have >= minimum) & (mean > 0) & (dev <= threshold_ms)
        flags = ok & (dev <= threshold_ratio * np.where(mean > 0, mean, 1.0))
        return pd.DataFrame({"skip": flags})

    return _stateful(step, window + 1, "skip boolean", record, ident, peak, stream, event_time, delay, ttl_ms)


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a table and read it back."""
    spark = df.sparkSession
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        q = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")
