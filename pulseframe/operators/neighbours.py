"""Nearest rows of every query, all against all, by packed blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLAB = 512  # queries in one matrix product
MANY = 200_000  # candidate pairs that are scored at once


def nearest_rows(q: DataFrame, src: DataFrame, k: int, sizes: tuple[int, int], euclidean: bool = False) -> DataFrame:
    """Some rows (qid, id, score) of every query (qid, v) that hold its k best of `src` (id, v): cosine, or the negative distance to others than itself.

    A block is one row with all its vectors, of queries and of rows at most about `sizes`. Blocks of rows are dealt to every block of queries, whose task goes
    through them one by one and keeps the k best so far. Scores are rounded to 9 digits, ties go to the smaller id.
    """
    cores = q.sparkSession.sparkContext.defaultParallelism
    n = q.count()
    nq = max(1, -(-n // sizes[0]), min(3 * cores, n // 256))
    nc = max(1, -(-src.count() // sizes[1]))
    block = lambda df, key, of, name: df.groupBy(F.pmod(F.xxhash64(key), F.lit(of)).cast("int").alias("_" + name)).agg(F.collect_list(F.struct(key, "v")).alias(name))
    left = block(q, "qid", nq, "q").withColumnRenamed("_q", "qb")
    right = block(src, "id", nc, "c").select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), "c")
    kinds = f"qid {dict(q.dtypes)['qid']}, id {dict(src.dtypes)['id']}, score double"
    # sorted by block, so that a block of queries is read once
    return left.join(right.hint("merge"), "qb").select("qb", "q", "c").mapInArrow(_scan(k, euclidean), kinds)


def _unpacked(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """Ids of a block, and its vectors in double precision."""
    values = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows.field(0), values.reshape(len(rows), -1)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class Best:
    """The k best rows so far of a block of queries.

    Single-precision products only rule rows out, with a margin above their error; what is left is scored in double precision.
    """

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, euclidean: bool) -> None:
        self.ids, self.k, self.euclidean = ids, k, euclidean
        self.q = vectors if euclidean else unit(vectors)
        self.q32, self.length = self.q.astype(np.float32), np.linalg.norm(self.q, axis=1)
        self.names = ids.to_numpy(zero_copy_only=False)
        self.row, self.id, self.score = np.zeros(0, np.int64), self.names[:0], np.zeros(0)

    def _least(self) -> np.ndarray:
        """Score of the k-th best so far, or minus infinity."""
        n = np.bincount(self.row, minlength=len(self.q))
        out = np.full(len(self.q), -np.inf)
        if len(self.row):
            last = np.cumsum(n) - 1
            out[n == self.k] = self.score[last[n == self.k]]
        return out

    def add(self, ids: pa.Array, vectors: np.ndarray) -> None:
        c = vectors if self.euclidean else unit(vectors)
        names, c32 = ids.to_numpy(zero_copy_only=False), c.astype(np.float32)
        half = (c * c).sum(axis=1) / 2 if self.euclidean else np.zeros(len(c))
        longest = np.sqrt((c * c).sum(axis=1).max())
        margin = 2e-5 * (self.length * longest + half.max()) + 1e-8 * (self.length + longest)
        least = self._least()
        if self.euclidean:  # q.c - |c|^2 / 2 grows as the distance falls
            least = np.where(np.isinf(least), least, (self.length**2 - least**2) / 2)
        rows, at, score = [self.row], [self.id], [self.score]
        for s in range(0, len(self.q), SLAB):
            key = self.q32[s : s + SLAB] @ c32.T
            if self.euclidean:
                key -= half.astype(np.float32)
            bound = np.maximum(least[s : s + SLAB], self._lower(key)) - margin[s : s + SLAB]
            r, j = np.divmod(np.flatnonzero(key >= bound[:, None].astype(np.float32)), len(c))
            for t in range(0, len(r), MANY):
                rr, jj = r[t : t + MANY] + s, j[t : t + MANY]
                own = np.zeros(len(rr), bool)
                if self.euclidean:
                    own = self.names[rr] == names[jj]
                    v = -np.sqrt(np.square(self.q[rr] - c[jj]).sum(axis=1))
                else:
                    v = np.einsum("ij,ij->i", self.q[rr], c[jj])
                rows.append(rr[~own])
                at.append(names[jj[~own]])
                score.append(v.round(9)[~own])
        row, id_, v = np.concatenate(rows), np.concatenate(at), np.concatenate(score)
        order = np.lexsort((id_, -v, row))
        row = row[order]
        start = np.searchsorted(row, np.arange(len(self.q)))
        keep = np.arange(len(row)) - start[row] < self.k
        self.row, self.id, self.score = row[keep], id_[order][keep], v[order][keep]

    def _lower(self, key: np.ndarray) -> np.ndarray:
        """A value that at least k rows reach, one more where a row may be the query itself: the k-th largest of maxima of groups."""
        k = self.k + self.euclidean
        size = key.shape[1] // max(4 * k, 64)
        if size < 1:
            size = 1
        groups = key.shape[1] // size
        if groups < k:
            return np.full(len(key), -np.inf)
        top = key[:, : groups * size].reshape(len(key), groups, size).max(axis=2)
        return np.partition(top, groups - k, axis=1)[:, groups - k].astype(np.float64)

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.row)), pa.array(self.id.tolist(), self.ids.type), pa.array(self.score)], ["qid", "id", "score"])


def _scan(k: int, euclidean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = None, None
        for b in batches:
            for i, block in enumerate(b.column("qb").to_pylist()):
                if block != at:
                    if best is not None:
                        yield best.result()
                    best, at = Best(*_unpacked(b.column("q")[i].values), k, euclidean), block
                best.add(*_unpacked(b.column("c")[i].values))
        if best is not None:
            yield best.result()

    return run
