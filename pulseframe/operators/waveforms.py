"""Jobs over signals and beat windows stored as array columns."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import arrays as A, signal as K
from ..session import pinned

TARGET_FS = 500.0
BLOCK = 50_000


SLAB = 1 << 18  # samples that a step holds as matrices at a time


def slabs(batches: Iterator[pd.DataFrame], samples: str, most: int = SLAB) -> Iterator[pd.DataFrame]:
    """Arrow batches in runs of rows with about `most` samples (one row at least): what a task holds follows neither the batch nor the window length."""
    for pdf in batches:
        if len(pdf):
            run = pdf[samples].map(lambda v: 0 if v is None else len(v)).cumsum().to_numpy() // most
            ends = [*(np.flatnonzero(np.diff(run)) + 1), len(pdf)]
            for a, b in zip([0, *ends], ends):
                yield pdf.iloc[a:b]


def _per_row(df: DataFrame, keep: Sequence[str], cols: Sequence[str], fn: Callable, out: str, multi: bool = False) -> DataFrame:
    """Apply fn(*values) to each row, a slab of rows (by the first of `cols`, arrays) at a time; keep the key columns."""
    types = dict(df.dtypes)
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slabs(batches, cols[0]):
            rows, src = [], []
            for i, vals in enumerate(zip(*[pdf[c] for c in cols])):
                r = fn(*vals)
                for v in r if multi else [r]:
                    rows.append(v)
                    src.append(i)
            res = pd.DataFrame(rows, columns=names)
            yield pd.concat([pdf[list(keep)].iloc[src].reset_index(drop=True), res], axis=1)

    schema = ", ".join([f"{c} {types[c]}" for c in keep] + [out])
    return df.select(*keep, *[c for c in cols if c not in keep]).mapInPandas(run, schema)


# ---- signals in blocks --------------------------------------------------------------------
#
# A signal is handled as pieces: the samples [core_from, core_to) of a block with what the step
# needs on both sides, [piece_from, piece_from + size(piece)). Steps cut the pieces back to their core. `keep`
# names the columns that tell the records apart.

FILTER_BLOCK = 32_768
SETTLE_S = 16.4  # seconds after which the slowest filter (0.5 Hz) has forgotten a sample, to 1e-8


def _records_of(x: DataFrame, one_block: bool | None) -> DataFrame:
    """Blocks of records of one block (True), of longer ones (False), or of all (None)."""
    same = F.col("core_to") - F.col("core_from") == F.col("n_samples")
    return x if one_block is None else x.filter(same if one_block else ~same)


def pieces_of(df: DataFrame, keep: Sequence[str], samples: str, block: int = FILTER_BLOCK, halo: int = int(SETTLE_S * TARGET_FS), one_block: bool | None = None) -> DataFrame:
    """Pieces of signals that are stored as one array a record. A null or empty signal has none."""
    n = F.size(samples)
    x = df.filter(n > 0).select(*keep, F.col(samples), n.cast("long").alias("n_samples"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))).alias("blk"))
    at, end = F.col("blk") * block, F.least(F.col("n_samples"), (F.col("blk") + 1) * block)
    x = _records_of(x.withColumns({"core_from": at, "core_to": end}), one_block)
    first, last = F.greatest(F.col("core_from") - halo, F.lit(0).cast("long")), F.least(F.col("n_samples"), F.col("core_to") + halo)
    return x.select(*keep, "n_samples", "blk", "core_from", "core_to", first.alias("piece_from"), A.doubles(A.window(samples, first, last - first)).alias("piece"))


def _alike(pdf: pd.DataFrame, cols: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Groups of batch rows with equal values in `cols` and equally long pieces: (values, row numbers, matrix of pieces)."""
    size = pdf["piece"].map(len)
    for key, at in pdf.groupby([*[pdf[c] for c in cols], size], sort=False).indices.items():
        yield key[:-1], at, np.stack(pdf["piece"].to_numpy()[at]).astype(np.float64)


def _map_pieces(pieces: DataFrame, keep: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], out: str, n_keep: Sequence[str] = ("n_samples", "blk", "core_from", "core_to")) -> DataFrame:
    """fn of every slab of pieces gives the new columns of its rows."""
    types = dict(pieces.dtypes)
    kept = [*keep, *n_keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slabs(batches, "piece"):
            yield pd.concat([pdf[kept], fn(pdf)], axis=1)

    return pieces.mapInPandas(run, ", ".join([f"{c} {types[c]}" for c in kept] + [out]))


def resampled_pieces(df: DataFrame, keep: Sequence[str], samples: str, fs: str, block: int = FILTER_BLOCK, halo: int = 0, one_block: bool | None = None) -> DataFrame:
    """G1: pieces at 500 Hz of signals with any whole-numbered rate, straight from the stored arrays, with `halo` samples around."""
    rate = F.round(fs).cast("long")
    shared = F.coalesce(*[F.when(rate % d == 0, F.lit(d)) for d in (500, 250, 125, 100, 50, 25, 20, 10, 5, 4, 2, 1)]).cast("long")
    n = F.size(samples).cast("long")
    x = df.filter(n > 0).select(*keep, F.col(samples), n.alias("n_in"), F.expr("500").cast("long").alias("_up"), rate.alias("_down"), shared.alias("_g"))
    x = x.select(*keep, samples, "n_in", F.expr("_up div _g").alias("up"), F.expr("_down div _g").alias("down"))
    whole = lambda a, b: F.ceil(a / b).cast("long")
    x = x.withColumns({"n_samples": F.expr("(n_in * up + down - 1) div down"), "_u": whole(F.lit(block), F.col("up")), "_h": whole(F.lit(halo), F.col("up")),
                       "_reach": whole(F.least(F.greatest("up", "down"), F.lit(K.LONGEST)) * K.REACH, F.col("up")) + 1})
    x = x.withColumn("blk", F.explode(F.expr("sequence(0L, (n_samples - 1) div (_u * up))")))
    x = _records_of(x.withColumns({"core_from": F.expr("blk * _u * up"), "core_to": F.expr("least(n_samples, (blk + 1) * _u * up)")}), one_block)
    x = x.withColumns({"_from": F.expr("greatest(0L, blk * _u - _h)"), "_to": F.expr("(blk + 1) * _u + _h")})
    x = x.withColumns({"piece_from": F.expr("_from * up"), "count": F.expr("least(n_samples, _to * up) - _from * up"), "in_from": F.expr("greatest(0L, _from * down - _reach)"), "in_to": F.expr("least(n_in, _to * down + _reach + 1)")})
    x = x.select(*keep, "n_samples", "blk", "core_from", "core_to", "piece_from", "count", "up", "down", "n_in", "in_from", F.expr("_from * down - in_from").alias("lead"),
                 F.element_at(samples, 1).cast("double").alias("x0"), F.element_at(samples, -1).cast("double").alias("x1"), A.doubles(A.window(samples, F.col("in_from"), F.col("in_to") - F.col("in_from"))).alias("piece"))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.empty(len(pdf), object)
        for (up, down, lead, count), at, piece in _alike(pdf, ["up", "down", "lead", "count"]):
            col = lambda c: pdf[c].to_numpy()[at, None]
            if up == down:
                y = piece[:, lead : lead + count]
            else:
                slope = (col("x1") - col("x0")) / np.maximum(col("n_in") - 1, 1)
                y = K.resample_rows(piece - col("x0") - slope * (col("in_from") + np.arange(piece.shape[1])), up, down, count, lead)
                y = y + col("x0") + slope * (col("piece_from") + np.arange(count)) * down / up
            out[at] = list(y)
        return pd.DataFrame({"piece": out}, index=pdf.index)

    return _map_pieces(x, keep, fn, "piece array<double>", ("n_samples", "blk", "core_from", "core_to", "piece_from"))


def filtered(pieces: Callable[[bool], DataFrame], keep: Sequence[str], fs: float = TARGET_FS) -> tuple[DataFrame, DataFrame]:
    """The zero-phase band-pass on pieces, cut to their core, and detrended over the whole record: (records of one block, longer ones).

    `pieces(True)` are those of records of one block, `pieces(False)` of longer ones. Blocks: keep, n_samples, blk, core_from, core_to, samples.
    The trend comes from two sums per block. A record of one block knows them at once, so nothing of it is written or
    shuffled; the blocks of longer records are written once and read back with the trend.
    """
    def fn(one_block: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            end = pdf["piece_from"] + pdf["piece"].map(len) == pdf["n_samples"]
            pdf = pdf.assign(left=pdf["piece_from"] == 0, right=end, skip=pdf["core_from"] - pdf["piece_from"], size=pdf["core_to"] - pdf["core_from"])
            out, s0, s1 = np.empty(len(pdf), object), np.empty(len(pdf)), np.empty(len(pdf))
            for (left, right, skip, size), at, piece in _alike(pdf, ["left", "right", "skip", "size"]):
                y = K.zero_phase(piece, fs, 0.5, 40.0, 4, left, right)[:, skip : skip + size]
                s0[at], s1[at] = y.sum(axis=1), y @ np.arange(size)
                if one_block:
                    slope = (s1[at] - (size - 1) / 2 * s0[at]) / (size * (float(size) * size - 1) / 12) if size > 1 else np.zeros(len(at))
                    y = y - (s0[at] / size)[:, None] - slope[:, None] * (np.arange(size) - (size - 1) / 2)
                out[at] = list(y)
            return pd.DataFrame({"samples": out} if one_block else {"_y": out, "_s0": s0, "_s1": s1}, index=pdf.index)

        return run

    short = _map_pieces(pieces(True), keep, fn(True), "samples array<double>")
    y = pinned(_map_pieces(pieces(False), keep, fn(False), "_y array<double>, _s0 double, _s1 double"))
    n, mid = F.max("n_samples"), (F.max("n_samples") - 1) / 2
    s0 = F.sum("_s0")
    slope = F.when(n > 1, (F.sum(F.col("_s1") + F.col("core_from") * F.col("_s0")) - mid * s0) / (n * (n.cast("double") * n - 1) / 12)).otherwise(0.0)
    trend = y.groupBy(*keep).agg((s0 / n).alias("_mean"), slope.alias("_slope"))
    t = _per_record(y, trend, keep)
    flat = F.transform("_y", lambda v, i: v - F.col("_mean") - F.col("_slope") * (F.col("core_from") + i - (F.col("n_samples") - 1) / 2))
    return short, t.select(*keep, "n_samples", "blk", "core_from", "core_to", flat.alias("samples"))


# Records (a few dozen bytes each) are broadcast to their blocks up to this many; beyond, the blocks are shuffled.
BROADCAST_RECORDS = 250_000


def _per_record(blocks: DataFrame, records: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Blocks with the columns of their record; null keys meet. The records are counted first: few of them are broadcast."""
    own = pinned(records.select(*[F.col(k).alias(f"_k_{k}") for k in keep], *[c for c in records.columns if c not in keep]))
    own = F.broadcast(own) if own.count() <= BROADCAST_RECORDS else own
    cond = None
    for k in keep:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = same if cond is None else cond & same
    return blocks.join(own, cond).drop(*[f"_k_{k}" for k in keep])


def _assembled(samples: str) -> Column:
    parts = F.sort_array(F.collect_list(F.struct("core_from", F.col("samples").alias("v"))))
    return F.flatten(F.transform(parts, lambda p: p["v"])).alias(samples)


def assembled(blocks: DataFrame, keep: Sequence[str], samples: str = "samples") -> DataFrame:
    """One array a record again; for users who need it so, since such a row grows with its record."""
    return blocks.groupBy(*keep).agg(_assembled(samples))


def _stats(n: Column, s: Column, q: Column) -> list[Column]:
    """Samples, mean and population deviation from the number, sum and sum of squares."""
    return [n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("std")]


def _sums() -> list[Column]:
    return [F.size("samples"), A.total("samples"), A.mean_square("samples") * F.size("samples")]


def block_stats(blocks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Samples, mean and population deviation of every record from its blocks."""
    return blocks.groupBy(*keep).agg(*_stats(*map(F.sum, _sums())))


# ---- cleaning ---------------------------------------------------------------------------

def resample(df: DataFrame, keep: Sequence[str], samples: str, fs: str) -> DataFrame:
    """G1: blocks at 500 Hz: keep, n_samples, blk, core_from, core_to, samples. No component lies above half the new rate."""
    return resampled_pieces(df, keep, samples, fs).withColumnRenamed("piece", "samples").drop("piece_from")


def band_pass(df: DataFrame, keep: Sequence[str], samples: str, fs: float = TARGET_FS) -> DataFrame:
    """Zero-phase 0.5-40 Hz band-pass of order 4, then linear detrend, as blocks."""
    short, long = filtered(lambda one_block: pieces_of(df, keep, samples, halo=int(SETTLE_S * fs), one_block=one_block), keep, fs)
    return short.unionByName(long)


def _cleaned(df: DataFrame, keep: Sequence[str], samples: str, fs: str, stats: DataFrame | None = None, by: str | None = None, clip: float = 5.0, z_clip: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Cleaned blocks with _mu, _sd, _clipped and _z_clipped, and rejected records."""
    v = F.col(samples)
    usable = F.coalesce((F.size(v) >= 16) & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a.cast("double")) & (F.abs(a.cast("double")) < float("inf"))) & (F.round(fs) > 0), F.lit(False))
    bad = df.filter(~usable).select(*keep, F.lit("resample").alias("step"), F.lit("empty, short or non-finite signal").alias("error"))
    good = df.filter(usable)
    parts = filtered(lambda one_block: resampled_pieces(good, keep, samples, fs, halo=int(SETTLE_S * TARGET_FS), one_block=one_block), keep)
    cut, n_cut = A.clip_counted("samples", F.lit(-clip), F.lit(clip))
    short, long = (x.withColumn("_clipped", n_cut).withColumn("samples", cut) for x in parts)
    if stats is not None:
        given = stats.filter(F.col(by).isNotNull()).select(by, F.col("mean").alias("_mu"), F.col("std").alias("_sd"))
        x = _per_record(short.unionByName(long), given, [by])
    else:
        own = short.select("*", *[c.alias(k) for k, c in zip(("_n", "_s", "_q"), _sums())])
        _, mean, std = _stats(F.col("_n"), F.col("_s"), F.col("_q"))
        own = own.withColumns({"_mu": mean, "_sd": std}).drop("_n", "_s", "_q")
        x = own.unionByName(_per_record(long, block_stats(long, keep).select(*keep, F.col("mean").alias("_mu"), F.col("std").alias("_sd")), keep))
    z = x.withColumn("samples", A.zscore("samples", F.col("_mu"), F.col("_sd")))
    cut, n_z = A.clip_counted("samples", F.lit(-z_clip), F.lit(z_clip))
    return z.withColumn("_z_clipped", n_z).withColumn("samples", cut), bad


def _lineage() -> Column:
    return F.struct(F.lit(TARGET_FS).alias("fs"), F.lit("resample,band,detrend,clip,zscore,clip").alias("steps"), F.max("_mu").alias("mean"), F.max("_sd").alias("std"), F.sum("_clipped").alias("n_clipped"), F.sum("_z_clipped").alias("n_z_clipped")).alias("lineage")


def clean_blocks(df: DataFrame, keep: Sequence[str], samples: str, fs: str, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resample, filter, detrend, clip, z-score, clip, block by block: (blocks, one lineage row per record, rejected records).

    `stats` (by, mean, std; `by` one of `keep`) gives global normalisation; without it each record uses its own. Records of one block are
    never written, so a user of both the blocks and the lineage has them made twice; `clean` and `clean_stats` make them once.
    """
    z, bad = _cleaned(df, keep, samples, fs, **settings)
    return z.select(*keep, "n_samples", "blk", "core_from", "core_to", "samples"), z.groupBy(*keep).agg(_lineage()), bad


def clean_stats(df: DataFrame, keep: Sequence[str], samples: str, fs: str, **settings) -> tuple[DataFrame, DataFrame]:
    """G3 without the samples: number, mean and deviation of the cleaned samples and the lineage of every record; rejected records."""
    z, bad = _cleaned(df, keep, samples, fs, **settings)
    return z.groupBy(*keep).agg(*_stats(*map(F.sum, _sums())), _lineage()), bad


def clean(df: DataFrame, keep: Sequence[str], samples: str, fs: str, **settings) -> tuple[DataFrame, DataFrame]:
    """G3 with one array and the lineage per record; rejected records as rows with the step that failed."""
    z, bad = _cleaned(df, keep, samples, fs, **settings)
    return z.groupBy(*keep).agg(_assembled(samples), _lineage()), bad


def pending(records: DataFrame, done: DataFrame, keys: Sequence[str] = ("dataset", "record_id", "config", "checksum")) -> DataFrame:
    """Records not yet processed with the same configuration and content."""
    return records.join(done, list(keys), "left_anti")


# ---- peaks and windows ------------------------------------------------------------------

BEAT_BLOCK, BLOCKS_A_WAVE = 50_000, 20


def detect_peaks(df: DataFrame, keep: Sequence[str], samples: str, fs: float = TARGET_FS, block: int = BEAT_BLOCK, blocks_a_wave: int = BLOCKS_A_WAVE) -> DataFrame:
    """One row (keep, peak) per detected R peak.

    Filter, slope and integration run on blocks, all at once. The levels of the detector go from sample to sample, so they
    are carried along: a wave scans the next blocks of every record, a bounded number, and leaves one small state row per record for the next
    wave. Records of up to block * blocks_a_wave samples (33 minutes at 500 Hz) need a single wave.
    """
    gap, steep = int(round(K.REFRACTORY * fs)), max(2, int(round(K.STEEP * fs)))
    short = 2 * (int(round(K.INTEGRATE * fs)) | 1)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        end = pdf["piece_from"] + pdf["piece"].map(len)
        first, last = np.maximum(pdf["core_from"] - steep, 0), np.minimum(pdf["core_to"] + gap + steep, pdf["n_samples"])
        pdf = pdf.assign(left=pdf["piece_from"] == 0, right=end == pdf["n_samples"], skip=first - pdf["piece_from"], size=last - first)
        band, power = np.empty(len(pdf), object), np.empty(len(pdf), object)
        for (left, right, skip, size), at, piece in _alike(pdf, ["left", "right", "skip", "size"]):
            b, p = K.beat_power(piece, fs, left, right)
            band[at], power[at] = list(b[:, skip : skip + size]), list(p[:, skip : skip + size])
        return pd.DataFrame({"band": band, "power": power}, index=pdf.index)

    pieces = pieces_of(df.filter(F.size(samples) >= short), keep, samples, block, int(8 * fs) + gap)
    ready = pinned(_map_pieces(pieces, keep, fn, "band array<double>, power array<double>"))
    types = dict(ready.dtypes)
    held = "at long, signal double, noise double, rr double, beats array<long>, held long, held_steep double"
    schema = ", ".join(f"{k} {types[k]}" for k in keep) + f", peak long, {held}"
    names = [c.split()[0] for c in held.split(", ")]

    def scan(rows: pd.DataFrame, state: pd.DataFrame | None) -> pd.DataFrame:
        rows = rows.sort_values("blk")
        total, start, stop = int(rows["n_samples"].iloc[0]), int(rows["core_from"].iloc[0]), int(rows["core_to"].iloc[-1])
        base = max(0, start - steep)
        band, power = (np.empty(min(total, stop + gap + steep) - base) for _ in range(2))
        for at, b, p in zip(rows["core_from"], rows["band"], rows["power"]):
            o = max(0, int(at) - steep) - base
            band[o : o + len(b)], power[o : o + len(p)] = b, p
        if state is None:
            s = K.Levels.first(power, total, fs)
        else:
            s = K.Levels(**{c: state[c].iloc[0] for c in names})
            s.beats, s.at, s.held = [int(v) for v in s.beats], int(s.at), int(s.held)
        peaks = K.scan_beats(s, power, band, start, stop, total, fs)
        out = pd.DataFrame({"peak": pd.Series(peaks, dtype="Int64")})
        for c in names:
            out[c] = None
        if stop < total:
            out = pd.concat([out, pd.DataFrame([{"peak": None, **vars(s)}])], ignore_index=True)
        for k in reversed(keep):
            out.insert(0, k, rows[k].iloc[0])
        return out

    waves = ready.agg(F.max(F.expr(f"blk div {blocks_a_wave}"))).first()[0]
    found = None
    for w in range(0 if waves is None else waves + 1):
        now = ready.filter(F.expr(f"blk div {blocks_a_wave} = {w}"))
        if w == 0:
            got = now.groupBy(*keep).applyInPandas(lambda rows: scan(rows, None), schema)
        else:
            got = now.groupBy(*keep).cogroup(state.groupBy(*keep)).applyInPandas(lambda rows, s: scan(rows, s) if len(rows) else s[:0], schema)
        got = pinned(got)
        state = got.filter("peak is null")
        peaks = got.filter("peak is not null").select(*keep, "peak")
        found = peaks if found is None else found.unionByName(peaks)
    return found if found is not None else df.sparkSession.createDataFrame([], ", ".join(f"{k} {types[k]}" for k in keep) + ", peak long")


def detect_simple(df: DataFrame, keep: Sequence[str], samples: str, distance: int, prominence: float) -> DataFrame:
    """G5."""
    return _per_row(df, keep, [samples], lambda x: [(int(p),) for p in K.simple_peaks(np.asarray(x, dtype=np.float64), distance, prominence)], "peak long", multi=True)


def signal_blocks(df: DataFrame, keys: Sequence[str], samples: str, block: int = BLOCK, halo: int = 250) -> DataFrame:
    """Bounded pieces of each signal with `halo` samples of context on both sides."""
    n = F.size(samples)
    x = df.withColumn("n_samples", n).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(n, F.lit(1)) - 1) / F.lit(block)))))
    lo = F.greatest(F.lit(0), F.col("blk") * block - halo)
    hi = F.least(F.col("n_samples"), (F.col("blk") + 1) * block + halo)
    return x.select(*keys, "n_samples", "blk", lo.alias("blk_start"), A.window(samples, lo, hi - lo).alias("piece"))


def segment_beats(beats: DataFrame, signals: DataFrame, keys: Sequence[str], samples: str, peak: str = "peak", rr: str = "rr_for_window", block: int = BLOCK) -> DataFrame:
    """500-sample windows centred on each peak; beats at the borders are dropped.

    An interval below 600 ms selects the 300-sample window, extended to 500 with its edge
    values. Beats meet pieces of the signal, not whole recordings.
    """
    half = F.when(F.col(rr) < 600.0, 150).otherwise(250)
    b = beats.withColumn("_half", half).withColumn("blk", F.floor(F.col(peak) / block))
    x = b.join(signal_blocks(signals, keys, samples, block), [*keys, "blk"])
    x = x.filter((F.col(peak) - F.col("_half") >= 0) & (F.col(peak) + F.col("_half") <= F.col("n_samples")))
    core = A.window("piece", F.col(peak) - F.col("_half") - F.col("blk_start"), F.col("_half") * 2)
    pad = (F.lit(250) - F.col("_half")).cast("int")
    x = x.withColumn("_core", core)
    w = F.when(F.col("_half") == 250, F.col("_core")).otherwise(
        F.concat(F.array_repeat(F.element_at("_core", 1), pad), F.col("_core"), F.array_repeat(F.element_at("_core", -1), pad)))
    return x.withColumn("waveform", w).withColumn("window_ms", F.when(F.col("_half") == 150, 600).otherwise(1000)).drop("_half", "blk", "n_samples", "blk_start", "piece", "_core")


def segmentation_counts(beats: DataFrame, kept: DataFrame, keys: Sequence[str], rr: str = "rr_for_window") -> DataFrame:
    """W10 counters; the window counters include beats dropped later."""
    a = beats.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if(F.col(rr) < 600.0).alias("n_600"), F.count_if(F.col(rr) >= 600.0).alias("n_1000"))
    k = kept.groupBy(*keys).agg(F.count("*").alias("n_kept"))
    return a.join(k, list(keys), "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0))).withColumn("n_discarded", F.col("n_total") - F.col("n_kept"))


# ---- features ---------------------------------------------------------------------------

def _morphology_of(windows: pa.Array, fs: float) -> np.ndarray:
    """The features of some windows as a matrix; NaN where the detection failed or the window is null or empty."""
    out = np.full((len(windows), len(K.MORPHOLOGY)), np.nan)
    size = pc.fill_null(pc.list_value_length(windows), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        rows = windows if len(at) == len(windows) else windows.take(pa.array(at))
        out[at] = K.morphology(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n), fs)
    return out


def _with_columns(df: DataFrame, keep: Sequence[str], samples: str, fn: Callable[[pa.Array], list[pa.Array]], out: list[T.StructField]) -> DataFrame:
    """Columns `keep` and those that fn makes of the array column, a slab of windows at a time.

    The kept columns, the windows among them, go through as Arrow: what a task holds beyond its batch is one slab.
    """
    kept = [*keep, *([] if samples in keep else [samples])]
    fields = {f.name: f for f in df.schema.fields}
    names = [*keep, *[f.name for f in out]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(kept.index(samples))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < b.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + SLAB, "right")))
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*[part.column(kept.index(c)) for c in keep], *fn(part.column(kept.index(samples)))], names=names)
                at = to

    return df.select(*kept).mapInArrow(run, T.StructType([*[fields[c] for c in keep], *out]))


MORPHOLOGY_FIELDS = [T.StructField(n, T.DoubleType()) for n in K.MORPHOLOGY]


def _finished(df: DataFrame) -> DataFrame:
    null = F.lit(None).cast("double")
    return df.withColumns({n: F.nanvl(n, null) for n in K.MORPHOLOGY}).withColumn("j_point", F.col("j_point").cast("int"))


def morphology(df: DataFrame, keep: Sequence[str], samples: str, fs: float = TARGET_FS) -> DataFrame:
    """Ten morphology features per window, a matrix per slab; null where the detection failed or the window is null or empty."""
    return _finished(_with_columns(df, keep, samples, lambda w: [pa.array(c) for c in _morphology_of(w, fs).T.copy()], MORPHOLOGY_FIELDS))


def morphology_and_hash(df: DataFrame, samples: str, name: str = "waveform_sha256", domain: str = "waveform/v1", fs: float = TARGET_FS) -> DataFrame:
    """G6 and P7 of every window in one pass; all columns stay."""
    def fn(w: pa.Array) -> list[pa.Array]:
        return [*[pa.array(c) for c in _morphology_of(w, fs).T.copy()], pa.array([_digest(v, domain) for v in w], pa.string())]

    return _finished(_with_columns(df, df.columns, samples, fn, [*MORPHOLOGY_FIELDS, T.StructField(name, T.StringType())]))


# Sentinel of each morphology feature in the published table.
SENTINELS = {"qrs_width_ms": 0.0, "qrs_area": 0.0, "qrs_asymmetry_index": -1.0, "t_r_ratio": -1.0, "qrs_raggedness": -1.0}


def with_sentinels(df: DataFrame) -> DataFrame:
    """P19."""
    return df.withColumns({c: A.sentinel(c, v) for c, v in SENTINELS.items()})


def _ms(ms: float, fs: float) -> int:
    return int(round(ms * fs / 1000.0))


def qrs_window(samples: str, fs: float, centre: Column | int | None = None, pre_ms: float = 120.0, post_ms: float = 180.0, base_ms: float = 40.0) -> Column:
    """Window around the centre minus the median of its first samples."""
    pre, post = _ms(pre_ms, fs), _ms(post_ms, fs)
    c = F.floor(F.size(samples) / 2) if centre is None else (F.lit(centre) if isinstance(centre, int) else centre)
    w = A.doubles(A.window(samples, c - pre, pre + post))
    base = A.median(A.window(w, 0, min(max(5, _ms(base_ms, fs)), pre + post)))
    return A.let(base, lambda b: F.transform(w, lambda v: v - b))


def direct_morphology(df: DataFrame, samples: str, fs: float = TARGET_FS, centre: Column | int | None = None, eps: float = 1e-8) -> DataFrame:
    """Nineteen direct QRS features as array expressions."""
    pre, post, s_len = _ms(120.0, fs), _ms(180.0, fs), _ms(120.0, fs)
    short, long_ = 90.0, 200.0
    x = df.withColumn("_q", qrs_window(samples, fs, centre))
    x = x.withColumn("_d", A.diff("_q")).withColumn("_e", F.transform("_q", lambda v: v * v)).withColumn("_a", F.transform("_q", lambda v: F.abs(v)))
    x = x.withColumn("_s", qrs_window(samples, fs, centre, short, short)).withColumn("_l", qrs_window(samples, fs, centre, long_, long_))
    x = x.withColumn("_lm", A.mean("_l")).withColumn("_ptp", F.array_max("_q") - F.array_min("_q")).withColumn("_et", A.total("_e"))
    x = x.withColumn("_ls", F.greatest(F.lit(eps), F.sqrt(A.power_mean("_l", F.col("_lm"), 2))))
    s_amp = F.array_min(A.window("_q", pre, min(pre + post, pre + s_len + 1) - pre))
    r_amp = F.get("_q", F.lit(pre))
    # five-sample moving sums; a crossing is a change of sign between neighbours
    n = pre + post
    sums = F.transform(F.sequence(F.lit(1), F.lit(n - 4)), lambda i: A.total(F.slice("_q", i, 5)))
    x = x.withColumn("_m", sums)
    sign = F.transform("_m", lambda v: F.when(v < 0, 1.0).otherwise(0.0))
    crossings = A.total(F.transform(A.diff(sign), lambda v: F.abs(v)))
    off = F.array(*[F.lit(k / fs * 1000.0) for k in range(-pre, post)])
    rms = lambda c: F.sqrt(A.mean_square(c))
    crest = lambda c: F.array_max(F.transform(c, lambda v: F.abs(v))) / F.greatest(rms(c), F.lit(eps))
    feats = {
        "qrs_peak_to_peak": F.col("_ptp"),
        "qrs_signed_area": A.total("_q") / fs,
        "qrs_abs_area": A.total("_a") / fs,
        "qrs_energy": F.col("_et") / n,
        "qrs_activity": A.total(F.transform("_d", lambda v: F.abs(v))),
        "qrs_mobility": rms("_d") / F.greatest(F.sqrt(F.col("_et") / n), F.lit(eps)),
        "qrs_max_upslope": F.array_max("_d") * fs,
        "qrs_max_downslope": F.abs(F.array_min("_d") * fs),
        "qrs_s_amplitude": s_amp,
        "qrs_r_s_ratio": r_amp / F.greatest(F.abs(s_amp), F.col("_ptp") * 0.05, F.lit(eps)),
        "qrs_zero_crossings": crossings,
        "qrs_centroid_ms": A.dot("_a", off) / F.greatest(A.total("_a"), F.lit(eps)),
        "qrs_early_energy_fraction": A.total(A.window("_e", 0, pre)) / F.greatest(F.col("_et"), F.lit(eps)),
        "qrs_late_energy_fraction": A.total(A.window("_e", pre, post)) / F.greatest(F.col("_et"), F.lit(eps)),
        "crest_factor_180": crest(F.col("_s")),
        "crest_factor_400": crest(F.col("_l")),
        "beat_energy_400": A.mean_square("_l"),
        "beat_skewness_400": A.power_mean("_l", F.col("_lm"), 3) / F.pow("_ls", 3),
        "beat_kurtosis_400": A.power_mean("_l", F.col("_lm"), 4) / F.pow("_ls", 4) - 3.0,
    }
    return x.select(*df.columns, *[e.alias(k) for k, e in feats.items()])


def spectral(df: DataFrame, keep: Sequence[str], samples: str, fs: float = TARGET_FS) -> DataFrame:
    """Thirteen spectral features; a slab of equal windows is one matrix."""
    pre, post = _ms(120.0, fs), _ms(180.0, fs)
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slabs(batches, "_w"):
            w = np.vstack(pdf["_w"].to_numpy()).astype(np.float64)
            f = pd.DataFrame(K.spectral(w, fs), columns=K.SPECTRAL)
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), f], axis=1)

    c = F.floor(F.size(samples) / 2)
    w = A.window(samples, c - pre, pre + post)
    schema = ", ".join([f"{k} {types[k]}" for k in keep] + [f"{n} double" for n in K.SPECTRAL])
    return df.select(*keep, w.alias("_w")).mapInPandas(run, schema)


def sampled_qrs(df: DataFrame, samples: str, fs: float = TARGET_FS, step_ms: float = 20.0, eps: float = 1e-8) -> DataFrame:
    """Raw, amplitude-normalised and derivative values on a time grid (three arrays)."""
    pre, post, step = _ms(120.0, fs), _ms(180.0, fs), _ms(step_ms, fs)
    x = df.withColumn("_q", qrs_window(samples, fs))
    top = F.array_max(F.transform("_q", lambda v: F.abs(v)))
    x = x.withColumn("_n", A.let(F.greatest(top, F.lit(eps)), lambda t: F.transform("_q", lambda v: v / t)))
    n = pre + post
    idx = lambda i: F.get("_n", i)
    # central differences, one-sided at the ends
    grad = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == 0, idx(F.lit(1)) - idx(F.lit(0))).when(i == n - 1, idx(F.lit(n - 1)) - idx(F.lit(n - 2))).otherwise((F.get("_n", F.least(i + 1, F.lit(n - 1))) - F.get("_n", F.greatest(i - 1, F.lit(0)))) / 2.0))
    x = x.withColumn("_g", grad)
    gtop = F.array_max(F.transform("_g", lambda v: F.abs(v)))
    at = F.array(*[F.lit(k) for k in range(0, n, step)])
    pick = lambda c: F.transform(at, lambda i: F.get(c, i))
    return x.select(
        *df.columns, pick(F.col("_q")).alias("qrs_raw"), pick(F.col("_n")).alias("qrs_norm"),
        A.let(F.greatest(gtop, F.lit(eps)), lambda t: F.transform(pick(F.col("_g")), lambda v: v / t)).alias("qrs_diff_norm"))


def _digest(window: pa.ListScalar, domain: str) -> str:
    row = np.ascontiguousarray(np.nan if window.values is None else window.values.to_numpy(zero_copy_only=False), dtype="<f4")
    return hashlib.sha256(domain.encode() + b"\x00" + struct.pack("<q", len(row)) + row.tobytes()).hexdigest()


def add_waveform_hash(df: DataFrame, samples: str, name: str = "waveform_sha256", domain: str = "waveform/v1") -> DataFrame:
    """Digest of a domain prefix, the shape and the float32 bytes of each row."""
    return _with_columns(df, df.columns, samples, lambda w: [pa.array([_digest(v, domain) for v in w], pa.string())], [T.StructField(name, T.StringType())])


def json_hash(cols: dict[str, Column], domain: str) -> Column:
    """Digest of a domain and the JSON of a struct with sorted keys."""
    return F.sha2(F.concat(F.lit(domain + ":"), F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]))), 256)


def select_lead(df: DataFrame, dataset: str, names: str, leads: str, wanted: dict[str, str], fallback: Sequence[str] = ()) -> DataFrame:
    """Lead by name; datasets in `fallback` use their first lead when the name is absent, others give null and an error."""
    from ..functions.ontology import lookup

    want = lookup(wanted, dataset)
    pos = F.array_position(names, want)
    use = F.when(pos > 0, pos).when(F.col(dataset).isin(list(fallback)), F.lit(1))
    err = F.when(want.isNull(), "unknown dataset").when(use.isNull(), "lead not found").when(use > F.size(leads), "lead index out of range")
    return df.withColumn("lead_error", err).withColumn("lead_name", F.when(err.isNull(), F.try_element_at(names, use.cast("int")))).withColumn("lead", F.when(err.isNull(), F.try_element_at(leads, use.cast("int"))))


# ---- augmentation -----------------------------------------------------------------------

AUGMENTATIONS = ["noise", "scale", "warp", "wander", "powerline", "shift"]


def augment(df: DataFrame, keep: Sequence[str], samples: str, kind: str, strength: float, seed: int, fs: float = TARGET_FS, stage: str = "train") -> DataFrame:
    """One perturbed copy per row, seeded by the row key; only for training rows."""
    if stage != "train":
        raise ValueError("augmentation is for training data only")
    types = dict(df.dtypes)

    def one(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        n = len(x)
        t = np.arange(n) / fs
        if kind == "noise":
            return x + rng.normal(0, strength * (x.std() or 1.0), n)
        if kind == "scale":
            return x * rng.uniform(1 - strength, 1 + strength)
        if kind == "warp":
            k = 1 + rng.uniform(-strength, strength)
            return np.interp(np.clip((np.arange(n) - n / 2) * k + n / 2, 0, n - 1), np.arange(n), x)
        if kind == "wander":
            return x + strength * np.sin(2 * np.pi * rng.uniform(0.1, 0.5) * t + rng.uniform(0, 2 * np.pi))
        if kind == "powerline":
            return x + strength * np.sin(2 * np.pi * 60.0 * t + rng.uniform(0, 2 * np.pi))
        return np.roll(x, int(rng.integers(-int(strength * n), int(strength * n) + 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slabs(batches, samples):
            rows = [one(np.asarray(x, dtype=np.float64), np.random.default_rng([seed, int(s)])) for x, s in zip(pdf[samples], pdf["_seed"])]
            yield pdf[list(keep)].assign(**{samples: rows})

    from .ordering import hash_int, stable_hash

    key = hash_int(stable_hash(*keep, F.lit(kind), seed=seed))
    schema = ", ".join([f"{c} {types[c]}" for c in keep] + [f"{samples} array<double>"])
    return df.select(*keep, samples, key.alias("_seed")).mapInPandas(run, schema)


def counterfactual(df: DataFrame, key: str, samples: str, scorer: Callable[[Column], Column], transforms: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """Mean and p95 absolute probability change and label flip rate per transform.

    `scorer` maps an array column to an array of probabilities (a pandas_udf or expressions).
    """
    from ..session import pinned
    from .ordering import percentiles

    base = df.select(key, scorer(F.col(samples)).alias("_p"))
    out = None
    for kind, strength in transforms:
        x = augment(df, [key], samples, kind, strength, seed).select(key, scorer(F.col(samples)).alias("_q")).join(base, key)
        top = lambda c: F.array_position(c, F.array_max(c))
        d = x.select(F.lit(kind).alias("transform"), F.lit(strength).alias("level"), (A.total(F.zip_with("_p", "_q", lambda a, b: F.abs(a - b))) / F.size("_p")).alias("change"), (top(F.col("_p")) != top(F.col("_q"))).cast("double").alias("flip"))
        out = d if out is None else out.unionByName(d)
    x = pinned(out)
    keys = ["transform", "level"]
    return x.groupBy(*keys).agg(F.avg("change").alias("mean_change"), F.avg("flip").alias("flip_rate"), F.count("*").alias("n")).join(percentiles(x, keys, "change", {"p95_change": 0.95}), keys)
