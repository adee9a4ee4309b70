"""Hard-negative mining over a multiway hyperplane tree with distance ranges between siblings.

The tree is fitted on a bounded sample: split points far from each other, `fan` of them on every
level; a row belongs to the nearest split point of each level (a generalized hyperplane partition),
so every row is in one of fan ** levels leaves. Then all rows are placed, and for every split point
and each of its siblings the tree learns the range of distances from the split point to the rows
in the sibling's subtree, besides the range of norms in the subtree.

A search looks for scores (inner products) in a window [low, high]. With |y|^2 between the norms of
a subtree and |a - y|^2 = |a|^2 + |y|^2 - 2 a.y the window is an annulus of distances around the
anchor. By the triangle inequality a row in the annulus has a distance from each split point p
between max(inner - |a - p|, |a - p| - outer) and |a - p| + outer; a sibling whose range does not
meet this for one of the split points is left out with its whole subtree. What remains is compared
exactly, leaf block by leaf block, as one product of whole numbers.

Positives first visit the leaves around the anchor, which gives a score that the rest has to reach;
then every leaf that the annulus of that score leaves. Negatives visit the leaves that the annuli
of the anchor's windows leave. The tree has a fixed number of leaves, so an anchor is copied
at most that often for every block of a leaf; rows and anchors meet in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .centroids import rows_of
from .common import map_batches, pinned

# Products of this size, summed over up to 8192 components, stay below 2^53 and are exact in doubles.
LARGEST = 1 << 20
NONE = -(1 << 62)


@dataclass
class Tree:
    """Split points by level: points[l][node] is a fan x dim matrix; ranges per level and node, norms per level and subtree."""

    points: list[np.ndarray]  # level l: fan^l x fan x dim
    low: list[np.ndarray] | None = None  # level l: fan^l x fan x fan, distance of point i to rows below sibling j
    high: list[np.ndarray] | None = None
    norm_low: list[np.ndarray] | None = None  # level l: fan^l x fan, squared
    norm_high: list[np.ndarray] | None = None

    @property
    def fan(self) -> int:
        return self.points[0].shape[1]

    def place(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Child of each row on each level (numbered over the whole level), and its distances to the split points there."""
        node, path, dist = np.zeros(len(x), np.int64), [], []
        for pts in self.points:
            d = np.empty((len(x), self.fan))
            for v in np.unique(node):
                at = node == v
                d[at] = distances(x[at], pts[v])
            node = node * self.fan + d.argmin(axis=1)
            path.append(node)
            dist.append(d)
        return path, dist


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows, each as far as possible from those before it; rows repeat when there are too few."""
    if not len(x):
        return np.zeros((n, x.shape[1]), np.int64)
    pick, d = [0], distances(x, x[:1])[:, 0]
    while len(pick) < n:
        pick.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[pick[-1:]])[:, 0])
    return x[pick]


def grow(sample: np.ndarray, fan: int, levels: int) -> Tree:
    groups, points = [sample], []
    for _ in range(levels):
        # The farthest rows of a small random part are outliers less often than those of the whole.
        pts = np.stack([far_apart(g[: 8 * fan], fan) for g in groups])
        points.append(pts)
        groups = [g[at == j] for g, p in zip(groups, pts) for at in [distances(g, p).argmin(axis=1)] for j in range(fan)]
    return Tree(points)


def _ranges(tree: Tree):
    """Per task: smallest and largest distance of every split point to the rows of every sibling, and the norms."""
    fan = tree.fan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full((fan**lv, fan, fan + 1), np.inf) for lv in range(len(tree.points))]
        high = [np.full((fan**lv, fan, fan + 1), -np.inf) for lv in range(len(tree.points))]
        for b in batches:
            x = rows_of(b.column(0), tree.points[0].shape[2])
            path, dist = tree.place(x)
            norm = (x * x).sum(axis=1, dtype=np.float64)
            for lv, (p, d) in enumerate(zip(path, dist)):
                node, j = p // fan, p % fan
                for a, f in ((low[lv], np.minimum), (high[lv], np.maximum)):
                    f.at(a, (node, j), np.hstack([d, norm[:, None]]))
        for lv in range(len(low)):
            node, j = np.nonzero(np.isfinite(low[lv][:, :, 0]))
            n = len(node)
            if n:
                cell = [a[node, j].ravel() for a in (low[lv], high[lv])]
                rep = lambda v: np.repeat(v, fan + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n * (fan + 1), lv, np.int32)), pa.array(rep(node)), pa.array(rep(j)), pa.array(np.tile(np.arange(fan + 1, dtype=np.int32), n)), *map(pa.array, cell)], names=["lv", "node", "j", "i", "low", "high"])

    return run


def learn(tree: Tree, rows: DataFrame) -> Tree:
    """The tree with the ranges of all rows; their number depends on the tree alone."""
    fan = tree.fan
    shape = lambda fill, *more: [np.full((fan**lv, fan, *more), fill) for lv in range(len(tree.points))]
    out = Tree(tree.points, shape(np.inf, fan), shape(-np.inf, fan), shape(np.inf), shape(-np.inf))
    parts = map_batches(rows.select("x"), _ranges(tree), "lv int, node int, j int, i int, low double, high double")
    for r in parts.groupBy("lv", "node", "j", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        at = r["lv"], r["node"], r["j"], r["i"]
        if at[3] == fan:
            out.norm_low[at[0]][at[1:3]], out.norm_high[at[0]][at[1:3]] = r["low"], r["high"]
        else:
            out.low[at[0]][at[1], at[3], at[2]], out.high[at[0]][at[1], at[3], at[2]] = r["low"], r["high"]
    return out


def surviving(tree: Tree, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """anchors x leaves: whether a leaf may hold a row whose product with the anchor lies in one of the windows (anchors x windows)."""
    fan, norm = tree.fan, (a * a).sum(axis=1, dtype=np.float64)
    alive = np.ones((len(a), 1, low.shape[1]), bool)
    for lv, pts in enumerate(tree.points):
        nxt = np.zeros((len(a), len(pts) * fan, low.shape[1]), bool)
        for v in range(len(pts)):
            at = np.flatnonzero(alive[:, v].any(axis=1))
            if not len(at):
                continue
            d = distances(a[at], pts[v])
            for j in range(fan):
                n0, n1 = tree.norm_low[lv][v, j], tree.norm_high[lv][v, j]
                if n0 > n1:  # nothing below
                    continue
                slack = 1e-6 * (norm[at] + n1 + 1)[:, None]
                inner = np.sqrt(np.maximum(norm[at][:, None] + n0 - 2 * high[at] - slack, 0))
                outer2 = norm[at][:, None] + n1 - 2 * low[at] + slack
                outer = np.sqrt(np.maximum(outer2, 0))
                ok = alive[at, v] & (outer2 >= 0) & (low[at] <= high[at])
                near = 1e-6 * (d + 1)[:, :, None]
                least = np.maximum(inner[:, None] - d[:, :, None], d[:, :, None] - outer[:, None]) - near
                most = d[:, :, None] + outer[:, None] + near
                ok &= ((least <= tree.high[lv][v, :, j][None, :, None]) & (most >= tree.low[lv][v, :, j][None, :, None])).all(axis=1)
                nxt[at, v * fan + j] = ok
        alive = nxt
    return alive.any(axis=2)


def nearest_leaves(tree: Tree, a: np.ndarray, n: int) -> np.ndarray:
    """anchors x n leaves: those with the nearest split points on the last level, among leaves that hold rows."""
    last = tree.points[-1].reshape(-1, tree.points[-1].shape[2])
    d = distances(a, last)
    d[:, (tree.norm_low[-1] > tree.norm_high[-1]).ravel()] = np.inf
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _best(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k largest allowed scores per anchor, earlier columns first among equals: (anchor number, column)."""
    n = score.shape[1]
    if abs(score).max(initial=0) < (1 << 61) // n:
        key = np.where(ok, score * n + (n - 1 - np.arange(n)), NONE)
        at = np.argpartition(-key, k - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(key), 1))
    else:
        key = np.where(ok, score, NONE)
        at = np.argsort(-key, axis=1, kind="stable")[:, :k]
    r, c = np.nonzero(np.take_along_axis(key, at, 1) > NONE)
    return r, at[r, c]


def _meet(left: pa.Table, right: pa.Table, dim: int):
    """Ids of anchors and rows, their scores, and whether their labels are equal."""
    x, y = (rows_of(t.column("x").combine_chunks(), dim, np.float64) for t in (left, right))
    labels = pc.unique(pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks]))
    p, q = (pc.index_in(t.column("label"), labels).to_numpy() for t in (left, right))
    return left.column("id").to_numpy(), right.column("id").to_numpy(), np.rint(x @ y.T).astype(np.int64), p[:, None] == q


def _positives(dim: int, k: int, kind: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        right = right.sort_by("id")  # columns in order of id: ties go to the smaller one
        a, b, s, same = _meet(left, right, dim)
        r, c = _best(s, same & (a[:, None] != b) & (s >= left.column("reach").to_numpy()[:, None]), k)
        return pa.table([a[r], b[c], s[r, c]], schema=kind)

    return run


def _negatives(dim: int, k: int, kind: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        right = right.sort_by("id")
        a, b, s, same = _meet(left, right, dim)
        found = left.column("found").to_pylist()  # at most as many as there are positives per anchor
        nothing = {"id": 0, "score": 0, "low": 1, "high": 0}
        out = []
        for i in range(max(map(len, found))):
            at = [f[i] if len(f) > i else nothing for f in found]
            pid, p, low, high = (np.array([v[c] for v in at], np.int64) for c in ("id", "score", "low", "high"))
            r, c = _best(s, ~same & (s >= low[:, None]) & (s <= high[:, None]), k)
            out.append((a[r], pid[r], b[c], p[r], s[r, c]))
        return pa.table([np.concatenate(v) for v in zip(*out)], schema=kind)

    return run


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3,
    window: tuple[int, int] = (50, 95), fan: int = 16, levels: int = 2, first: int = 4, block: int = 1024, anchor_block: int = 1024, fit_rows: int = 4096,
) -> DataFrame:
    """Hard negatives of the anchors: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the inner product of the whole numbers, higher ones first, ties by
    the smaller id. `anchors` is a condition on the columns of `vectors`. An anchor's positives are its first `positives`
    other rows of the same label; for each of them come the first `negatives` rows of another label with
    window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score (0 <= window[0] < window[1]). A positive without such rows gives none.

    Rows with a null id, label or vector or with null or not finite components take no part. Of rows with the same id
    the one with the smallest label, then the smallest components, takes part. A shorter vector counts
    as filled up with zeros. No rows or no anchors give no rows. Other columns are ignored. A component of 2^20 or more after
    scaling is an error: its products are not exact. The `fit_rows` rows with the smallest hash fit the split points; all rows are
    placed and searched, and no result depends on the tree.
    """
    spark = vectors.sparkSession
    usable = F.coalesce(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor")).filter(usable)
    x = F.transform("v", lambda v: F.when(F.abs(v) < LARGEST / scale, F.floor(v * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component is too large for scale {scale}")).cast("int")))
    one = base.select("id", F.struct("label", x.alias("x"), "anchor").alias("r")).groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")
    rows = pinned(one)
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    kinds = dict(rows.dtypes)
    final = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    if dim is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim = max(dim, 1)
    pad = F.concat("x", F.array_repeat(F.lit(0), F.lit(dim) - F.size("x")))
    rows = rows.withColumn("x", F.when(F.size("x") < dim, pad).otherwise(F.col("x")))
    sample = rows.orderBy(F.xxhash64("id"), "id").select("x").limit(fit_rows).toArrow()  # a fixed number of rows
    tree = learn(grow(rows_of(sample.column(0).combine_chunks(), dim), fan, levels), rows)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.place(rows_of(b.column(2), dim))[0][-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(leaf.astype(np.int32))], names=["id", "label", "x", "anchor", "leaf"])

    stored = pinned(map_batches(rows.select("id", "label", "x", "anchor"), placed, f"id long, label {kinds['label']}, x array<int>, anchor boolean, leaf int"))
    sizes = stored.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))  # one row per leaf
    spot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = stored.filter("anchor").select("id", "label", "x")

    def visit(who: DataFrame, choose: Callable[[pa.RecordBatch], list[np.ndarray]], match, kind: str) -> DataFrame:
        """Every anchor against the rows of the leaves that `choose` names for it."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    s = b.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([*s.columns, pa.array([v.astype(np.int32) for v in choose(s)], pa.list_(pa.int32()))], names=[*s.schema.names, "leaves"])

        named = map_batches(who, run, ", ".join(f"`{c}` {t}" for c, t in who.dtypes) + ", leaves array<int>")
        went = named.withColumn("leaf", F.explode("leaves")).drop("leaves")
        meets = went.groupBy("leaf").agg(F.ceil(F.count("*") / anchor_block).cast("int").alias("na")).join(sizes, "leaf")
        meets = F.broadcast(pinned(meets))  # one row per leaf
        left = went.join(meets, "leaf").select(*went.columns, spot(F.col("na")).alias("g"), every(F.col("nb")).alias("b"))
        right = stored.select("leaf", "id", "label", "x").join(meets, "leaf").select("leaf", "id", "label", "x", spot(F.col("nb")).alias("b"), every(F.col("na")).alias("g"))
        return left.groupBy("leaf", "b", "g").cogroup(right.groupBy("leaf", "b", "g")).applyInArrow(match, kind)

    def best_first(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
        """At most k rows per group; a group holds k rows a visited block, and the engine cuts it before the shuffle as well."""
        w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    schema = lambda ddl: pa.schema([(c.split()[0], pa.int64()) for c in ddl.split(", ")])
    pos_kind = "anchor_id long, positive_id long, score long"
    match = _positives(dim, positives, schema(pos_kind))
    anchor_x = lambda s: rows_of(s.column("x"), dim)
    start = asked.withColumn("reach", F.lit(NONE).cast("long"))
    near = pinned(visit(start, lambda s: list(nearest_leaves(tree, anchor_x(s), first)), match, pos_kind))
    reach = best_first(near, ["anchor_id"], "score", "positive_id", positives).groupBy("anchor_id").agg(F.min("score").alias("reach"), F.count("*").alias("n")).filter(F.col("n") == positives)
    goes = asked.join(reach.select(F.col("anchor_id").alias("id"), "reach"), "id", "left").withColumn("reach", F.coalesce("reach", F.lit(NONE).cast("long"))).select("id", "label", "x", "reach")

    def beyond(s: pa.RecordBatch) -> list[np.ndarray]:
        a = anchor_x(s)
        low = s.column("reach").to_numpy().astype(np.float64)
        alive = surviving(tree, a, np.maximum(low, -1e18)[:, None], np.full((len(a), 1), 1e18))
        np.put_along_axis(alive, nearest_leaves(tree, a, first), False, 1)  # seen before
        return [np.flatnonzero(v) for v in alive]

    more = visit(goes, beyond, match, pos_kind)
    top = best_first(near.union(more), ["anchor_id"], "score", "positive_id", positives)
    # In whole numbers; a negative positive score leaves no window.
    bounds = {"low": F.expr(f"(score * {int(window[0])} + 99) div 100"), "high": F.expr(f"score * {int(window[1])} div 100")}
    ranges = top.filter("score >= 0").withColumns(bounds).filter("low <= high")
    found = ranges.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("positive_id").alias("id"), "score", "low", "high"))).alias("found"))  # at most `positives` per anchor
    seeks = pinned(asked.join(found, F.col("id") == F.col("anchor_id")).select("id", "label", "x", "found"))

    def windows(s: pa.RecordBatch) -> list[np.ndarray]:
        a, f = anchor_x(s), s.column("found").to_pylist()
        lo, hi = np.full((len(a), positives), 1.0), np.zeros((len(a), positives))
        for i, ps in enumerate(f):
            lo[i, : len(ps)], hi[i, : len(ps)] = [p["low"] for p in ps], [p["high"] for p in ps]
        return [np.flatnonzero(v) for v in surviving(tree, a, lo, hi)]

    got = visit(seeks, windows, _negatives(dim, negatives, schema(final)), final)
    out = best_first(got, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
