"""Near-duplicate documents by bands of MinHash signatures at two depths, confirmed on full shingle sets.

A document is the set of its distinct word shingles. Documents with the same set are one class. A
class has one signature of minima; every tree is a fixed band that reads the signature from another
place. This stands in for an LSH forest: nothing is sorted. A region is the classes with the same
`depth` values; where a region is dense, its sub-regions of twice the depth are used as well in
the first pass.

Candidates come in two passes, and no bucket is capped. First every class meets the head of its
region and of its sub-region. Confirmed links give components, and a region whose members are all
in one component is done: its other pairs could only repeat what is known. In the second pass,
members of a region that belong to different components meet: the largest component of the
region in blocks of bounded size, each against blocks of the members outside it, and these among
themselves. Full signatures sort out pairs far below the threshold (more than four standard errors);
the rest is confirmed on full sets inside the block, and only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_IDS, clean_name, components, map_batches, pinned, slices, without, release

DENSE = 32  # members from which sub-regions are used as well
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _Q
    return h ^ (h >> np.uint64(27))


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z is lower-cased, words are split at ASCII white space.

    Fewer words than `width` are one shingle; no words, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = h * _P + w[k : len(w) - n + 1 + k]
    return np.unique(_mix(h + np.uint64(n)))


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    top = np.iinfo(np.uint64).max
    return rng.integers(1, top, n, np.uint64) | np.uint64(1), rng.integers(0, top, n, np.uint64)


def signature(h: np.ndarray, n: int) -> np.ndarray:
    a, b = _permutations(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(low, (h[at : at + 1024, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _features(width: int, length: int):
    names = ["id", "n", "k1", "k2", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            sets = [shingle_hashes(t, width) for t in b.column(1).to_pylist()]
            with np.errstate(over="ignore"):
                k1 = [int(h.sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0 for h in sets]
                k2 = [int(np.bitwise_xor.reduce(_mix(h * _Q)).astype(np.int64)) if len(h) else 0 for h in sets]
            sig = [signature(h, length).tobytes() if len(h) else None for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], names=names)
        _words.clear()

    return run


def _regions(trees: int, depth: int):
    """Per class and tree: hashes of the first `depth` and of the first 2 * `depth` values of the tree's order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(trees, dtype=np.int32)
        for b in slices(batches, 4096):
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").reshape(b.num_rows, -1).astype(np.uint64)
            two = np.concatenate([sig, sig], axis=1)
            short = np.empty((b.num_rows, trees), np.uint64)
            long = np.empty_like(short)
            for t in range(trees):
                h = np.full(b.num_rows, t + 1, np.uint64)
                for d in range(2 * depth):
                    h = _mix(h * _P + two[:, t * depth + d])
                    if d == depth - 1:
                        short[:, t] = h
                long[:, t] = h
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), trees)), pa.array(np.repeat(b.column(1).to_numpy(), trees)), pa.array(short.ravel().astype(np.int64)), pa.array(long.ravel().astype(np.int64)), pa.array(np.tile(number, b.num_rows))], names=["id", "n", "region", "sub", "tree"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "set"])
        _words.clear()

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cross(least: int, depth: int, num: int, den: int):
    """Links between components in one block of a region: one for every two components that have any.

    Members of the block's one side meet those of the other (or each other, where there is one side
    only). A pair is looked at in the first tree in which it shares a region, when its components
    differ and enough minima are equal, and confirmed on the full sets.
    """
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        release()
        sig = np.frombuffer(b"".join(rows["sig"]), "<u4").reshape(len(rows), -1)
        sets = [np.frombuffer(v, np.uint64) for v in rows["set"]]
        ids, comp, side = (rows[c].to_numpy() for c in ("id", "comp", "side"))
        size = np.array([len(v) for v in sets])
        tree = int(rows["tree"].iloc[0])
        mine, theirs = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.arange(len(rows)),) * 2
        out, joined = [], set()
        for i in mine:
            ok = theirs[(comp[theirs] != comp[i]) & (np.minimum(size[theirs], size[i]) * den >= np.maximum(size[theirs], size[i]) * num)]
            same = sig[ok] == sig[i]
            ok = ok[(same.sum(axis=1) >= least) & (same.reshape(len(ok), sig.shape[1] // depth, depth).all(axis=2).argmax(axis=1) == tree)]
            for k in ok:
                pair = (comp[i], comp[k]) if comp[i] < comp[k] else (comp[k], comp[i])
                if pair in joined:
                    continue
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if den * both >= num * (size[i] + size[k] - both):
                    joined.add(pair)
                    out.append((ids[i], ids[k]))
        del sets, sig
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: str = "0.8", width: int = 4, trees: int = 24, depth: int = 5, block: int = 512) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Two documents are linked when intersection >= threshold * union, reckoned in integers;
    component_id is the smallest id reachable by links, kept marks that document. A null text
    counts as empty; without words a document is linked with nothing. Rows without an id have a
    null component and are not kept. A row repeated with the same id is in its own component and
    kept like it. Other columns are ignored. No rows give no rows.
    A pair exactly at the threshold shares no region of any tree with probability (1 - 0.8^5)^24 < 1e-4.
    """
    num, den = Fraction(threshold).limit_denominator(10_000).as_integer_ratio()
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    feats = pinned(map_batches(base, _features(width, trees * depth), "id long, n long, k1 long, k2 long, sig binary"))
    some = feats.filter("n > 0 and id is not null")
    classes = pinned(some.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")))
    reps = some.alias("f").join(classes.alias("c"), F.expr("f.id = c.rep and f.n = c.n and f.k1 = c.k1 and f.k2 = c.k2"), "left_semi")
    ordered = pinned(map_batches(reps.select("id", "n", "sig"), _regions(trees, depth), "id long, n long, region long, sub long, tree int"))
    heads = ordered.groupBy("region").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("head")).filter("size > 1")
    members = pinned(ordered.join(heads, "region").select("region", "sub", "tree", "id", "n", "size", "head"))
    near = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num  # noqa: E731  sizes too far apart cannot link
    stars = members.filter(F.col("id") != F.col("head.id")).filter(near(F.col("n"), F.col("head.n"))).select(F.col("head.id").alias("a"), F.col("id").alias("b"))
    dense = members.filter(F.col("size") >= DENSE)
    subs = dense.groupBy("region", "sub").agg(F.count("*").alias("s"), F.min(F.struct("id", "n")).alias("h2")).filter("s > 1")
    deeper = dense.join(subs, ["region", "sub"]).filter(F.col("id") != F.col("h2.id")).filter(near(F.col("n"), F.col("h2.n"))).select(F.col("h2.id").alias("a"), F.col("id").alias("b"))
    first = pinned(stars.union(deeper).distinct())
    wanted = pinned(members.select("id").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted  # 8 bytes each
    sets = pinned(map_batches(base.join(wanted, "id").select("id", "text"), _sets(width), "id long, set binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        both = left.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y")
        return pinned(map_batches(both, _confirm(num, den), "a long, b long"))

    links = confirmed(first)
    comps = pinned(components(links))
    placed = members.select("region", "tree", "id").join(comps, "id", "left").select("region", "tree", "id", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("region")
    apart = pinned(placed.join(mixed, "region"))
    if not apart.isEmpty():
        largest = apart.groupBy("region", "comp").agg(F.count("*").alias("c")).groupBy("region").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("c"))
        blocks = lambda n: F.greatest(F.ceil(n / block).cast("int"), F.lit(1))
        rows = apart.join(largest, "region").withColumns({"ni": blocks(F.col("c")), "no": blocks(F.col("all") - F.col("c")), "inside": F.col("comp") == F.col("main")})
        rows = rows.join(some.select("id", "sig").dropDuplicates(["id"]), "id").join(sets.dropDuplicates(["id"]), "id")
        rows = rows.withColumn("o", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("ni")).otherwise(F.col("no"))).cast("int"))
        keep = ["tree", "id", "comp", "sig", "set"]
        # The largest component in blocks, each against every block of the others ...
        inner = rows.filter("inside").select("region", F.col("o").alias("i"), F.explode(F.sequence(F.lit(1), F.col("no"))).alias("j"), *keep, F.lit(1).alias("side"))
        meet = rows.filter("not inside").select("region", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), (F.col("o") + 1).alias("j"), *keep, F.lit(0).alias("side"))
        # ... and the blocks of the others among themselves, as (-1 - lower, higher).
        own = rows.filter("not inside").select("region", "o", F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("p"), *keep)
        own = own.select("region", (-1 - F.least("o", "p")).alias("i"), F.greatest("o", "p").alias("j"), *keep, F.when(F.col("o") <= F.col("p"), 0).otherwise(1).alias("side"))
        share = num / den
        least = int((share - 4.4 * np.sqrt(share * (1 - share) / (trees * depth))) * trees * depth)
        more = inner.union(meet).union(own).groupBy("region", "i", "j").applyInPandas(_cross(least, depth, num, den), "a long, b long")
        comps = components(links.union(pinned(more)))
    info = classes.join(comps, F.col("rep") == F.col("id"), "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = some.select("id", "n", "k1", "k2").join(info, ["n", "k1", "k2"]).select("id", "n", "component_id")
    out = out.union(feats.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one document of each group of near-duplicates, all columns as they were.

    Rows without an id stay.
    """
    gone = clean_name(docs, "_gone")
    drop = near_duplicates(docs, id_col, text_col, **options).filter(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(gone)).distinct()
    return without(docs, drop, F.col(id_col) == F.col(gone))
