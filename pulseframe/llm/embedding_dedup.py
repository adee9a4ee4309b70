"""Embedding near-deduplication: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors are one class with a multiplicity, so copies are compared once. Centroids are fitted
on a bounded sample; every class has a home cell, the one of its nearest centroid, and visits
other cells near its border. No linked pair is missed: let x live with c1 and y with c2 and d = c1 - c2, so
x . d >= 0 >= y . d. Linked unit vectors have |x - y| <= r = sqrt(2 - 2 * threshold), so
x . d - y . d <= r * |d|, and one of x . d and -y . d is at most r * |d| / 2. A vector visits all
cells for which that holds, so at least one of the two visits the other.

Cells are dealt to a few groups, a large cell in parts, and a task compares one pair of groups: only there it is seen who
visits whom, so a vector is shuffled once a group, packed with others, and not once a visited cell. Inside, rows of
a cell meet the rows of the other group in products of bounded size. Only sums and a spanning forest
leave a task, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .common import components, hash_unit, pinned, tidy


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of the unit rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        home = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, home, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 1e-12, s / np.maximum(n, 1e-12), c)
    return c


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


SLACK = 1e-7  # for rounding, above the error of a distance between centroids that all but coincide


def _homes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 1024] @ c.T, axis=1) for i in range(0, len(x), 1024)])


def _near(x: np.ndarray, home: np.ndarray, c: np.ndarray, cells: np.ndarray, threshold: float, margin: float) -> np.ndarray:
    """Whether each unit row of x visits each of the cells; it visits its own."""
    half = 0.5 * np.sqrt(max(2 - 2 * threshold, 0) + 1e-12)
    square = (c * c).sum(axis=1)
    out = np.empty((len(x), len(cells)), bool)
    for at in range(0, len(x), 1024):
        rows, own = x[at : at + 1024], home[at : at + 1024]
        lead = (rows * c[own]).sum(axis=1)[:, None] - rows @ c[cells].T
        apart = np.sqrt(np.maximum(square[own][:, None] + square[cells] - 2 * (c[own] @ c[cells].T), 0))
        out[at : at + 1024] = lead <= np.maximum(half * apart + SLACK, margin)
    return out


def visited(x: np.ndarray, c: np.ndarray, threshold: float, margin: float = 0.0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home cell of each unit row of x and the other cells that it visits."""
    home = _homes(x, c)
    near = _near(x, home, c, np.arange(len(c)), threshold, margin)
    near[np.arange(len(home)), home] = False
    return home, [np.flatnonzero(row) for row in near]


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for b in batches:
            sizes = pyarrow.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False) if b.num_rows else np.zeros(0, int)
            for dim in np.unique(sizes):
                part = b.filter(pa.array(sizes == dim))
                first, c = centroids[int(dim)]
                home = _homes(unit_rows(_matrix(part.column(2))), c) + first
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32))], names=["rep", "m", "vec", "home"])

    return run


def _deal(counts: np.ndarray, first: int, groups: int, block: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of these sizes in groups of about equal size: how many parts each cell has, and the group of each part (from `first`).

    A part has about `block` rows at most. There are `groups` groups, or as many as keep each at about `most` rows.
    """
    parts = np.maximum(1, -(-counts // block))
    rows = np.repeat(counts / parts, parts)
    n = max(min(groups, len(rows)), -(-int(counts.sum()) // most))
    before = np.cumsum(rows) - rows
    return parts, first + np.minimum(before * n / max(counts.sum(), 1), n - 1).astype(np.int64)


def _pack(shared):
    """Rows of a batch as one row for each group, with the numbers of the first and last group of vectors of that length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at, group, range_of = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            rep, home = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            mix = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            own = group[at[home] + ((mix >> np.uint64(32)) % parts[home].astype(np.uint64)).astype(np.int64)]
            order = np.argsort(own, kind="stable")
            b, own = b.take(pa.array(order)), own[order]
            ends = np.append(np.flatnonzero(np.diff(own)) + 1, len(own))
            starts = np.append(0, ends[:-1])
            lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)
            long = pyarrow.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            whole = [lists(b.column(i), ends - starts) for i in (0, 1, 3)]
            u = own[starts]
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in (u, range_of[u, 0], range_of[u, 1])), *whole, lists(b.column(2).flatten(), np.add.reduceat(long, starts))], names=["u", "first", "last", "rep", "m", "home", "vec"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n nodes: the smallest node that the edges (a, b) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Side:
    """Vectors of one group, by cell."""

    def __init__(self, rows: pa.Table, side: int) -> None:
        rows = rows.filter(pyarrow.compute.equal(rows["side"], side))
        flat = lambda name: np.concatenate([np.zeros(0, int), *(c.flatten().to_numpy(zero_copy_only=False) for c in rows[name].chunks)])
        home = flat("home").astype(np.int64)
        order = np.argsort(home, kind="stable")
        self.home, self.rep, self.m = home[order], flat("rep").astype(np.int64)[order], flat("m").astype(np.int64)[order]
        if len(home):
            self.x = unit_rows(flat("vec").reshape(len(home), -1)[order])
            self.x32 = self.x.astype(np.float32)
        self.n = np.zeros(len(home), np.int64)  # links of each row


class _Joined:
    """Nodes that links have joined so far; a bounded number of links is held."""

    def __init__(self, n: int) -> None:
        self.label, self.held, self.size = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        new = a != b
        self.held.append((a[new], b[new]))
        self.size += int(new.sum())
        if self.size > 1 << 20:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.size:
            self.label = _forest(*(np.concatenate(v) for v in zip(*self.held)), len(self.label))[self.label]
        self.held, self.size = [], 0
        return self.label


WIDE = 2048  # columns of a product


def _linked(left: _Side, s: int, e: int, right: _Side, cols: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of left[s:e] and right[cols]. Single precision decides where it is beyond its error, double precision the rest."""
    error = (left.x.shape[1] + 8) * 2.0**-23
    cosine = left.x32[s:e] @ right.x32[cols].T
    hit = np.flatnonzero(cosine >= threshold - error)
    p, q = s + hit // len(cols), cols[hit % len(cols)]
    keep = np.ones(len(hit), bool)
    unsure = np.flatnonzero(cosine.ravel()[hit] < threshold + error)
    for i in range(0, len(unsure), 65_536):
        u = unsure[i : i + 65_536]
        keep[u] = np.einsum("ij,ij->i", left.x[p[u]], right.x[q[u]]) >= threshold
    return p[keep], q[keep]


def _compare(shared, threshold: float, margin: float, block: int):
    """Number of links and a spanning forest of the links between two groups, or inside one."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        same = key[0] == key[1]
        left = _Side(rows, 0)
        right = left if same else _Side(rows, 1)
        del rows
        sides = [left] if same else [left, right]
        joined = _Joined(sum(len(v.rep) for v in sides))
        shift = 0 if same else len(left.rep)
        if len(left.rep) and len(right.rep):
            first, c = shared.value[left.x.shape[1]]
            (own, _), (other, at) = (np.unique(v.home - first, return_inverse=True) for v in (left, right))
            to_right = _near(left.x, left.home - first, c, other, threshold, margin)
            to_left = to_right if same else _near(right.x, right.home - first, c, own, threshold, margin)
            cuts = np.flatnonzero(np.diff(left.home)) + 1
            for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(left.home)])):  # a cell
                for s in range(a, b, block):
                    e = min(s + block, b)
                    meets = to_left[:, k] | to_right[s:e].any(axis=0)[at]
                    if same:
                        meets[:s] = False
                    meets = np.flatnonzero(meets)
                    for i in range(0, len(meets), WIDE):
                        p, q = _linked(left, s, e, right, meets[i : i + WIDE], threshold)
                        if same:
                            p, q = p[p < q], q[p < q]
                        if len(p):
                            np.add.at(left.n, p, right.m[q])
                            np.add.at(right.n, q, left.m[p])
                            joined.add(p, q + shift)
        reps, n = (np.concatenate([getattr(v, k) for v in sides]) for k in ("rep", "n"))
        label = joined.settle()
        tree = np.flatnonzero(label != np.arange(len(label)))
        tidy()
        return pa.table({"a": np.concatenate([reps[n > 0], reps[tree]]), "b": pa.concat_arrays([pa.nulls(int((n > 0).sum()), pa.int64()), pa.array(reps[label[tree]], pa.int64())]), "n": np.concatenate([n[n > 0], np.zeros(len(tree), np.int64)])})

    return run


GROUPS, GROUP_BYTES = 12, 32 << 20  # how often a vector is shuffled, while no group exceeds so many bytes of vectors


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, per_cell: int = 512, most_cells: int = 4096, margin: float = 0.0, block: int = 1024, fit_rows: int = 20_000, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id, kept.

    n_links counts the other rows linked directly (cosine >= threshold), component_id is the
    smallest id reachable by links, kept marks the representative of the group. A vector that is null,
    empty, zero or has null or non-finite components links with nothing and is kept; so is a row
    without an id, with a null component_id and kept false. Vectors of different length never link.
    A row repeated with the same id is another vector. Other columns are ignored.
    `fit_rows` bounds the sample on which the centroids are fitted; all rows are assigned and compared.
    `margin` lets vectors visit cells within that cosine of the nearest as well; no result depends on it.
    A vector is shuffled to the blocks once a group: GROUPS times, or as often as there are groups of `group_bytes` of vectors.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    number = base.schema["vec"].dataType.elementType.typeName()
    wide = "float" if number == "float" else "double"
    base = base.withColumn("vec", F.col("vec").cast(f"array<{wide}>"))
    usable = F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0) & F.col("id").isNotNull(), F.lit(False))
    keyed = base.filter(usable).select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2"))
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    # The vector of a class comes from its row with the smallest id; repeated ids may bring it twice.
    reps = pinned(keyed.alias("v").join(classes.alias("c"), (F.col("v.id") == F.col("c.rep")) & (F.col("v.k1") == F.col("c.k1")) & (F.col("v.k2") == F.col("c.k2"))).select("c.rep", "c.m", "v.vec", "c.k1", "c.k2").dropDuplicates(["k1", "k2"]))
    sizes = {r["dim"]: r["n"] for r in reps.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    centroids, first = {}, 0
    for dim, n in sorted(sizes.items()):
        k = max(1, min(most_cells, round(n / per_cell)))
        got = reps.filter(F.size("vec") == dim).filter(hash_unit("rep", seed=3) < fit_rows / n).select("rep", "vec").toArrow().sort_by("rep")
        x = unit_rows(_matrix(got.column("vec").combine_chunks())) if got.num_rows else np.eye(1, dim)
        centroids[dim] = (first, spherical_kmeans(x, k))
        first += len(centroids[dim][1])
    shared = spark.sparkContext.broadcast(centroids)  # at most `most_cells` vectors of each length
    placed = pinned(reps.select("rep", "m", "vec").mapInArrow(_assign(shared), f"rep long, m long, vec array<{wide}>, home int"))
    size = np.zeros(first, np.int64)
    for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect():  # one row per cell
        size[r["home"]] = r["n"]
    parts, group, range_of = np.ones(first, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    for dim, (at, c) in centroids.items():
        parts[at : at + len(c)], own = _deal(size[at : at + len(c)], len(range_of), GROUPS, block, max(1, group_bytes // (dim * (4 if wide == "float" else 8))))
        group = np.concatenate([group, own])
        n = group[-1] + 1 - len(range_of)
        range_of = np.concatenate([range_of, np.tile([len(range_of), len(range_of) + n - 1], (n, 1))])
    plan = spark.sparkContext.broadcast((parts, np.cumsum(parts) - parts, group, range_of))
    packed = placed.mapInArrow(_pack(plan), f"u int, first int, last int, rep array<long>, m array<long>, home array<int>, vec array<{wide}>")
    pairs = packed.withColumn("o", F.explode(F.sequence("first", "last"))).select(F.least("u", "o").alias("i"), F.greatest("u", "o").alias("j"), (F.col("u") > F.col("o")).cast("int").alias("side"), "rep", "m", "home", "vec")
    found = pinned(pairs.groupBy("i", "j").applyInArrow(_compare(shared, threshold, margin, block), "a long, b long, n long"))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    comps = components(found.filter("b is not null").select("a", "b"))
    info = reps.select("k1", "k2", "rep", "m").join(counts, F.col("rep") == F.col("a"), "left").join(comps, F.col("rep") == F.col("id"), "left").select("k1", "k2", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = keyed.select("id", "k1", "k2").join(info, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = base.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
