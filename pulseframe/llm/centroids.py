"""Centroid clustering in whole numbers: n-simplex projection filters the centroids, integers decide.

The distances of a vector to a few pivots are computed once, exactly, and kept in a written table.
They place the vector as the apex of a simplex over the pivots: all coordinates but the last lie in
the space that the pivots span, the last one is the height above it. The distances of a centroid
to the same pivots place it likewise. For apexes a and b

    lower^2 = sum of (a_i - b_i)^2 over all coordinates
    upper^2 = the same with (a_n + b_n)^2 for the heights

bound the squared Euclidean distance, so a centroid whose lower bound exceeds the smallest upper
bound cannot be the nearest. Only the centroids that remain are compared with the vector, in 64-bit
integers. The pivots are the first centroids, so the bounds of the first round are exact; later they
separate the better the more the vectors are clustered, and hardly at all for vectors without
structure in many dimensions (`compared` tells). A round reads the table once and leaves one row of sums per task and cluster; the
vectors themselves never move. Rounding of the bounds is covered by a margin, and nothing of the
result depends on the pivots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import clean_name, map_batches, pinned

# Beyond this a squared distance of 64 components may not fit in 63 bits.
LARGEST = 1 << 27


def rows_of(column: pa.Array, dim: int, kind=np.int64) -> np.ndarray:
    """Lists of `dim` numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


def lists_of(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(x.ravel()))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered rows."""
    return np.stack([((x - row) ** 2).sum(axis=1) for row in y], 1) if len(y) else np.zeros((len(x), 0), np.int64)


@dataclass
class Simplex:
    """Base simplex of the pivots: row i of `base` holds the i coordinates of pivot i (pivot 0 is the origin)."""

    base: np.ndarray
    used: list[int]

    @staticmethod
    def of(pivots: np.ndarray) -> Simplex:
        """Pivots that lie in, or nearly in, the space of those before them are left out: they add no coordinate."""
        d2 = squares(pivots, pivots).astype(np.float64)
        s = Simplex(np.zeros((1, 0)), [0])
        for i in range(1, len(pivots)):
            apex = s.apexes(d2[i : i + 1, s.used])[0]
            if apex[-1] ** 2 > 1e-6 * max(d2[i].max(), 1.0):
                s = Simplex(np.vstack([np.hstack([s.base, np.zeros((len(s.base), 1))]), apex]), s.used + [i])
        return s

    def apexes(self, d2: np.ndarray) -> np.ndarray:
        """Coordinates of rows from their squared distances to the used pivots; the last one, the height, is not negative."""
        k = len(self.used)
        out = np.zeros((len(d2), k))
        for j in range(1, k):  # |x|^2 - |x - p|^2 = 2 x.p - |p|^2, and p has j coordinates
            p = self.base[j]
            out[:, j - 1] = ((d2[:, 0] - d2[:, j] + p @ p) / 2 - out[:, : j - 1] @ p[: j - 1]) / p[j - 1]
        out[:, k - 1] = np.sqrt(np.maximum(d2[:, 0] - (out[:, : k - 1] ** 2).sum(axis=1), 0))
        return out


def candidates(a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """rows x centroids: whether the bounds allow that the centroid is the nearest. `scale`: largest squared distance per row."""
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    lower, upper = flat + (a[:, None, -1] - b[None, :, -1]) ** 2, flat + (a[:, None, -1] + b[None, :, -1]) ** 2
    return lower <= (upper.min(axis=1) + 1e-6 * scale + 1e-6)[:, None]


def nearest(x: np.ndarray, d2: np.ndarray, centroids: np.ndarray, simplex: Simplex, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: smaller number), its squared distance, and how many were compared exactly."""
    to = squares(centroids, pivots[simplex.used]).astype(np.float64)
    a, b = simplex.apexes(d2[:, simplex.used].astype(np.float64)), simplex.apexes(to)
    open_ = candidates(a, b, d2.max(axis=1, initial=0) + to.max())
    best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for c in range(len(centroids)):
        at = np.flatnonzero(open_[:, c])
        d = ((x[at] - centroids[c]) ** 2).sum(axis=1)
        less = d < best[at]
        best[at[less]], cluster[at[less]] = d[less], c
    return cluster, best, open_.sum(axis=1)


def _assigned(b: pa.RecordBatch, dim: int, centroids, simplex, pivots, x_at: int, d_at: int, part: int = 8192):
    for at in range(0, b.num_rows, part):
        s = b.slice(at, part)
        x = rows_of(s.column(x_at), dim)
        yield (s, x, *nearest(x, rows_of(s.column(d_at), len(pivots)), centroids, simplex, pivots))


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Clusters of the vectors: (assignment, clusters).

    Takes the vectors of exactly `dim` components, none null or not finite, as whole numbers
    floor(scale * x). Centroids start as the `k` vectors whose `<seed>:<id>` has the smallest SHA-256,
    or all when there are fewer; a round assigns every vector and moves every centroid that has vectors to their
    floored mean; after `rounds` rounds the vectors are assigned once more.

    assignment: id, cluster, distance (squared), compared (centroids that the bounds left). clusters, at most `k` rows:
    cluster, n, cluster_inertia, inertia (over all), centroid, centroid_sha256; n is 0 for a cluster without vectors.
    Other vectors, null ones among them, are left out. A row without an id is clustered, as a seed it comes
    last. A row repeated with the same id is another vector. Of rows with the same hash the one with smaller
    components is the earlier seed. No rows give no rows. Other columns are ignored. A component of
    2^27 or more after scaling is an error: its distance does not fit the result.
    """
    spark = vectors.sparkSession
    ok = F.coalesce((F.size("v") == dim) & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(ok)
    small = F.forall("v", lambda v: F.abs(v) < LARGEST / scale)
    kept = kept.withColumn("v", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"a component is too large for scale {scale}"))))
    whole = kept.select("id", F.transform("v", lambda v: F.floor(v * scale).cast("int")).alias("x"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = whole.orderBy(order.asc_nulls_last(), "x").limit(k).collect()  # k rows
    kinds = "id long, cluster int, distance long, compared int"
    if not seeds:
        return spark.createDataFrame([], kinds), spark.createDataFrame([], "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    centroids = pivots = np.array([r["x"] for r in seeds], np.int64)
    simplex = Simplex.of(pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                s = b.slice(at, 8192)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), lists_of(squares(rows_of(s.column(1), dim), pivots))], names=["id", "x", "d2"])

    stored = pinned(map_batches(whole, measured, "id long, x array<int>, d2 array<long>"))

    def sums(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
            for b in batches:
                for _, x, cluster, _, _ in _assigned(b, dim, centroids, simplex, pivots, 0, 1):
                    n += np.bincount(cluster, minlength=k)
                    for c in np.unique(cluster):
                        total[c] += x[cluster == c].sum(axis=0)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), lists_of(total[at])], names=["cluster", "n", "total"])

        return run

    for _ in range(rounds):
        parts = map_batches(stored.select("x", "d2"), sums(centroids), "cluster int, n long, total array<long>")
        got = parts.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect()  # k x dim rows
        centroids = centroids.copy()
        for r in got:
            centroids[r["cluster"], r["pos"]] = r["s"] // r["n"]
    last = centroids

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, _, cluster, best, compared in _assigned(b, dim, last, simplex, pivots, 1, 2):
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(cluster), pa.array(best), pa.array(compared.astype(np.int32))], names=["id", "cluster", "distance", "compared"])

    out = pinned(map_batches(stored, assigned, kinds))
    inertia = {r["cluster"]: (r["n"], r["s"]) for r in out.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(s for _, s in inertia.values())
    rows = [(c, *inertia.get(c, (0, 0)), total, row.tolist(), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(last)]
    return out, spark.createDataFrame(rows, "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")


def cluster_rows(vectors: DataFrame, id_col: str = "vec_id", **settings) -> DataFrame:
    """One row per vector that `cluster_vectors` takes: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, clusters = cluster_vectors(vectors, id_col, **settings)
    c = F.broadcast(clusters.select(F.col("cluster").alias("c"), "cluster_inertia", "inertia", "centroid_sha256"))  # at most k rows
    name = id_col if id_col not in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") else clean_name(c, "id")
    return rows.join(c, F.col("cluster") == F.col("c")).select(F.col("id").alias(name), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
