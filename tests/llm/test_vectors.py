"""Centroid clustering and hard negatives against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm.centroids import Simplex, candidates, cluster_rows, cluster_vectors, squares
from pulseframe.llm.hard_negatives import grow, learn, mine, surviving

VECS = "vec_id long, embedding array<float>, label int, cluster int, distance string, id string, x int, c int"


def vectors_of(spark, rows):
    """Rows (id, vector, label) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, y, 7, "d", "i", 1, 2) for i, v, y in rows], VECS)


def whole(rows, scale, dim=64):
    keep = [(i, v) for i, v, *_ in rows if v is not None and len(v) == dim and all(a is not None and np.isfinite(a) for a in v)]
    return [i for i, _ in keep], np.floor(np.array([v for _, v in keep], np.float32).astype(float).reshape(len(keep), dim) * scale).astype(np.int64)


def clusters_by_hand(ids, x, k=16, rounds=3):
    c = x[sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest() if ids[i] is not None else "z", x[i].tolist()))[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if r < rounds:
            for j in set(a.tolist()):
                c[j] = [int(s) // int((a == j).sum()) for s in x[a == j].sum(axis=0)]
    best = d.min(axis=1)
    sha = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    return sorted((ids[i] if ids[i] is not None else -1, int(a[i]), int(best[i]), int(best[a == a[i]].sum()), int(best.sum()), sha[a[i]]) for i in range(len(ids)))


def test_clusters_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=64).tolist()
    rows = [(i, rng.normal(size=64).tolist(), 0) for i in range(150)] + [(200 + i, one, 0) for i in range(60)] + [(300, one, 1), (300, rng.normal(size=64).tolist(), 1), (None, one, 2)]
    bad = [(400, None, 0), (401, [], 0), (402, one[:63], 0), (403, one + [0.0], 0), (404, [None] + one[1:], 0), (405, [float("nan")] + one[1:], 0), (406, [float("inf")] + one[1:], 0)]
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in cluster_rows(vectors_of(spark, rows + bad)).collect())
    assert got == clusters_by_hand(*whole(rows + bad, 64))


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(i, [float(i % 3)] * 64, None) for i in range(5)]
    got = sorted(tuple(r) for r in cluster_rows(vectors_of(spark, rows)).collect())
    assert got == clusters_by_hand(*whole(rows, 64))
    none = cluster_rows(vectors_of(spark, [(1, None, 0)]))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        cluster_rows(vectors_of(spark, [(1, [1e30] * 64, 0)])).count()


def test_bounds_filter_clustered_vectors(spark):
    """Nearly all centroids are ruled out by the bounds when the vectors are clustered."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(16, 64))
    rows = [(i, (middle[i % 16] + 0.02 * rng.normal(size=64)).tolist(), 0) for i in range(800)]
    got, clusters = cluster_vectors(vectors_of(spark, rows))
    assert got.agg(F.avg("compared")).first()[0] < 4 and clusters.agg(F.sum("n")).first()[0] == 800
    assert sorted(tuple(r) for r in cluster_rows(vectors_of(spark, rows)).collect()) == clusters_by_hand(*whole(rows, 64))


def test_simplex_bounds_hold():
    rng = np.random.default_rng(1)
    pivots = rng.integers(-50, 50, size=(9, 64))
    pivots[4] = pivots[2]  # adds nothing
    pivots[5] = 2 * pivots[3] - pivots[1]
    s = Simplex.of(pivots)
    assert s.used == [0, 1, 2, 3, 6, 7, 8]
    x, y = rng.integers(-50, 50, size=(200, 64)), rng.integers(-50, 50, size=(12, 64))
    a, b = (s.apexes(squares(v, pivots)[:, s.used].astype(float)) for v in (x, y))
    d = squares(x, y)
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    assert (flat + (a[:, None, -1] - b[None, :, -1]) ** 2 <= d + 1e-6).all() and (flat + (a[:, None, -1] + b[None, :, -1]) ** 2 >= d - 1e-6).all()
    assert candidates(a, b, d.max(axis=1))[np.arange(200), d.argmin(axis=1)].all()
    assert np.allclose(s.apexes(squares(pivots, pivots)[:, s.used].astype(float))[s.used, -1][:-1], 0, atol=1e-3)


# ---- hard negatives


def negatives_by_hand(rows, anchor, scale=256, k=5, n=3):
    best = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(a is None or not np.isfinite(a) for a in v):
            continue
        x = [int(np.floor(float(np.float32(a)) * scale)) for a in v]
        best[i] = min(best.get(i, (y, x)), (y, x))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, (y, x) in best.items():
        if not anchor(i):
            continue
        s = sorted((-dot(x, w), j, z == y) for j, (z, w) in best.items() if j != i)
        for p, j, same in [t for t in s if t[2]][:k]:
            hit = [(-q, m) for q, m, same in s if not same and 50 * -p <= 100 * -q <= 95 * -p][:n]
            out += [(i, j, r + 1, m, -p, q) for r, (q, m) in enumerate(hit)]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"fan": 3, "levels": 3, "first": 1, "block": 7, "anchor_block": 5, "fit_rows": 60}])
def test_hard_negatives_with_odd_rows(spark, settings):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(4, 12))
    vec = lambda c, spread=0.5: (middle[c] + spread * rng.normal(size=12)).tolist()
    one = vec(0)
    rows = [(i, vec(i % 4), int(rng.integers(3))) for i in range(220)] + [(300 + i, one, i % 3) for i in range(40)]  # many ties
    rows += [(500, None, 0), (501, vec(1), None), (None, vec(1), 1), (502, [None] + one[1:], 0), (503, [float("nan")] + one[1:], 0), (504, [float("-inf")] + one[1:], 1)]
    rows += [(10, vec(2), 2), (10, vec(3), 0), (20, rows[20][1], rows[20][2]), (600, one[:5], 1), (601, [], 2), (610, [0.0] * 12, 1), (620, vec(1), 9), (630, vec(2, 0.1), 0)]
    got = sorted(tuple(r) for r in mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, **settings).collect())
    want = negatives_by_hand(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100
    assert len({r[0] for r in got}) > 15


def test_hard_negatives_without_rows_or_anchors(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0], 0), (3, [1.0], 1)]):
        assert mine(vectors_of(spark, rows), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(Exception, match="too large"):
        mine(vectors_of(spark, [(50, [1e30], 0)]), F.lit(True)).count()
    words = spark.createDataFrame([(i, [1.0, i / 9], "ab"[i % 2], 1) for i in range(8)], "vec_id long, embedding array<double>, label string, x int")
    assert mine(words, F.col("vec_id") == 0).filter("positive_score = 256 * 256").count() == 0 and mine(words, F.col("vec_id") == 7).count() > 0


def test_siblings_are_eliminated_and_none_wrongly(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(30, 64)) / 8
    x = np.floor(256 * (middle[np.arange(1500) % 30] + 0.02 * rng.normal(size=(1500, 64)))).astype(np.int64)
    tree = learn(grow(x[:600], 6, 2), spark.createDataFrame([(row.tolist(),) for row in x], "x array<int>"))
    leaf = tree.place(x)[0][-1]
    a, s = x[:40], x[:40] @ x.T
    best = np.sort(s, axis=1)[:, -6:]
    low, high = np.stack([best[:, 1], best[:, 0] // 2], 1), np.stack([best[:, 5], best[:, 0] * 9 // 10], 1)
    for lo, hi in ((low, high), (low[:, :1], high[:, :1]), (low[:, 1:], high[:, 1:])):
        alive = surviving(tree, a, lo.astype(float), hi.astype(float))
        inside = ((s[:, :, None] >= lo[:, None]) & (s[:, :, None] <= hi[:, None])).any(axis=2)
        r, c = np.nonzero(inside)
        assert alive[r, leaf[c]].all()
    assert surviving(tree, a, low[:, :1].astype(float), high[:, :1].astype(float)).mean() < 0.3
    assert not surviving(tree, a, np.full((40, 1), 1.0), np.full((40, 1), 0.0)).any()
