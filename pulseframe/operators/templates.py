"""Template banks of beat classes and the features derived from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import arrays as A
from .sampling import is_even_position
from .ordering import hash_bucket, numbered, stable_hash
from .waveforms import SLAB

MAX_BEATS_PER_GROUP = 256


def unit_window(df: DataFrame, samples: str, pre: int, post: int, base: int = 20, name: str = "_u", eps: float = 1e-8) -> DataFrame:
    """Window around the centre, median of its first samples removed, unit length (zeros if flat)."""
    c = F.floor(F.size(samples) / 2)
    w = A.doubles(A.window(samples, c - pre, pre + post))
    x = df.withColumn("_w", A.let(A.median(A.window(w, 0, base)), lambda b: F.transform(w, lambda v: v - b)))
    norm = F.sqrt(A.dot("_w", "_w"))
    return x.withColumn(name, A.let(norm, lambda n: F.transform("_w", lambda v: F.when(n > eps, v / n).otherwise(0.0)))).drop("_w")


def group_prototypes(df: DataFrame, group: str, label: str, vec: str, ident: Sequence[str], k: int | None = MAX_BEATS_PER_GROUP) -> DataFrame:
    """Mean unit window per (class, group) of at most k evenly spaced beats (None: of all beats), unit length again.

    Means are built by partial vector sums on the map side.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = df
    if k is not None:
        h = stable_hash(*ident)
        x = numbered(df.withColumn("_h", h), [label, group], hash_bucket(F.col("_h")), [F.col("_h")], "_rn")
        n = df.groupBy(label, group).agg(F.count("*").alias("_c"))
        x = x.join(n, [label, group]).filter(is_even_position(F.col("_rn") - 1, F.col("_c"), k, rounded=True))
    m = x.groupBy(label, group).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"), F.count("*").alias("n_beats"))
    m = m.withColumn("_p", vector_to_array("_m"))
    size = F.greatest(F.lit(1e-8), F.sqrt(A.dot("_p", "_p")))
    return m.select(label, group, "n_beats", A.let(size, lambda n: F.transform("_p", lambda v: v / n)).alias("prototype"))


def fit_bank(prototypes: DataFrame, label: str, counts: dict[str, int], seed: int = 42) -> dict[str, np.ndarray]:
    """KMeans centres of the prototypes of each class; a bank has `counts` rows per class.

    The prototypes are read once per class and twice for its centres: give them pinned.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    bank = {}
    for i, (c, k) in enumerate(counts.items()):
        p = prototypes.filter(F.col(label) == c).select(F.transform("prototype", lambda v: F.round(v, 7)).alias("_p")).distinct()
        n = p.limit(k).count()
        if n == 0:
            raise ValueError(f"no prototypes of class {c}")
        x = p.select(array_to_vector("_p").alias("features"))
        if n == 1:
            centres = np.array([p.head()["_p"]])
        else:
            centres = np.array(KMeans(k=n, seed=seed + i, maxIter=50).fit(x).clusterCenters())
        bank[c] = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-8)
    return bank


def check_sources(train_groups: DataFrame, test_groups: DataFrame, group: str) -> DataFrame:
    """Q8: groups that would leak from the held-out fold into a bank; must be empty."""
    return train_groups.select(group).distinct().intersect(test_groups.select(group).distinct())


# Names of the two-class template features.
NV_FEATURES = [
    "template_corr_N", "template_corr_V", "template_corr_delta", "template_distance_N", "template_distance_V", "template_distance_ratio", "derivative_corr_N",
    "derivative_corr_V", "derivative_corr_delta", "hybrid_alpha", "hybrid_interiority", "hybrid_residual", "hybrid_residual_gain", "early_distance_delta",
    "mid_distance_delta", "late_distance_delta",
]
# Names of the three-class template features.
NVF_FEATURES = [
    "template_corr_N", "template_corr_V", "template_corr_F", "template_corr_delta_NV", "template_corr_delta_NF", "template_corr_delta_VF",
    "template_distance_N", "template_distance_V", "template_distance_F", "template_distance_ratio_NV", "template_distance_ratio_NF", "template_distance_ratio_VF",
    "derivative_corr_N", "derivative_corr_V", "derivative_corr_F", "derivative_corr_delta_NV", "derivative_corr_delta_NF", "derivative_corr_delta_VF",
    "template_F_margin_over_NV", "template_F_margin_over_V", "template_F_margin_over_N",
]
EPS = 1e-8


def _sum(rows: np.ndarray) -> np.ndarray:
    """Sums of the columns, from the first row to the last."""
    return np.add.reduce(rows, axis=0)


def _length(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(_sum(rows * rows))


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, EPS)


def closest(w: np.ndarray, bank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every unit window (one a column) the template of a bank that correlates best (the first of equals): corr, distance, slope_corr, template."""
    seen = np.stack([np.maximum(-1.0, np.fmin(1.0, _sum(w * t[:, None]))) for t in bank])
    at = seen.argmax(axis=0)
    corr, t = np.take_along_axis(seen, at[None], 0)[0], bank.T[:, at]
    d, e = np.diff(w, axis=0), np.diff(t, axis=0)
    return corr, np.sqrt(np.maximum(0.0, 2 - 2 * corr)), _over(_over(_sum(d * e), _length(d)), _length(e)), t


def _of_bank(w: np.ndarray, bank: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Template features of unit windows (one a column) by name."""
    classes = [c for c in "NVF" if c in bank]
    pairs = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    name = lambda base, a, b: base + (f"_{a}{b}" if len(classes) > 2 else "")
    corr, dist, slope, template = ({}, {}, {}, {})
    for c in classes:
        corr[c], dist[c], slope[c], template[c] = closest(w, bank[c])
    out: dict[str, np.ndarray] = {}
    for c in classes:
        out |= {f"template_corr_{c}": corr[c], f"template_distance_{c}": dist[c], f"derivative_corr_{c}": slope[c]}
    for a, b in pairs:
        out |= {name("template_corr_delta", a, b): corr[a] - corr[b], name("template_distance_ratio", a, b): _over(dist[a], dist[b]), name("derivative_corr_delta", a, b): slope[a] - slope[b]}
    if "F" in bank:
        n, v = corr["F"] - corr["N"], corr["F"] - corr["V"]
        return out | {"template_F_margin_over_N": n, "template_F_margin_over_V": v, "template_F_margin_over_NV": np.fmin(n, v)}
    # where a window lies on the line from its N template to its V template, and which third is nearer to which
    n, v = template["N"], template["V"]
    own, axis = w - n, v - n
    alpha = np.maximum(0.0, np.fmin(1.0, _over(_sum(own * axis), _length(axis) ** 2)))
    residual = _length(own - alpha * axis)
    out |= {"hybrid_alpha": alpha, "hybrid_interiority": 1 - np.abs(2 * alpha - 1), "hybrid_residual": residual, "hybrid_residual_gain": np.fmin(dist["N"], dist["V"]) - residual}
    size = len(w)
    ends = [0, *np.cumsum([size // 3 + (i < size % 3) for i in range(3)]).tolist()]
    for part, a, b in zip(("early", "mid", "late"), ends, ends[1:]):
        out[f"{part}_distance_delta"] = _length((w - n)[a:b]) - _length((w - v)[a:b])
    return out


def template_features(df: DataFrame, keep: Sequence[str], vec: str, bank: dict[str, np.ndarray]) -> DataFrame:
    """Features of every unit window against a bank of fixed size (classes N and V, or N, V and F)."""
    return template_features_of(df, keep, vec, {0: bank}, "_key").drop("_key")


def template_features_of(df: DataFrame, keep: Sequence[str], vec: str, banks: dict[int, dict[str, np.ndarray]], key: str) -> DataFrame:
    """The features against several banks of the same classes in one pass: a row per window and bank, `key` the bank's.

    A task holds the windows of one slab as a matrix. A window that is null or of another length than the templates has null features.
    """
    names = NVF_FEATURES if "F" in next(iter(banks.values())) else NV_FEATURES
    size = len(next(iter(banks.values()))["N"][0])
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*[fields[c] for c in keep], T.StructField(key, T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    rows = max(1, SLAB // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                windows = part.column(len(keep))
                fit = pc.fill_null(pc.equal(pc.list_value_length(windows), size), False)
                w = np.ascontiguousarray(windows.filter(fit).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).T)
                whole, mask = w.shape[1] == part.num_rows, fit.to_numpy(zero_copy_only=False)
                for k, bank in banks.items():
                    with np.errstate(invalid="ignore"):
                        got = _of_bank(w, bank)
                    cols = []
                    for n in names:
                        v = got[n]
                        if not whole:
                            v = np.zeros(part.num_rows)
                            v[mask] = got[n]
                        cols.append(pa.array(v, pa.float64(), mask=None if whole else ~mask))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.full(part.num_rows, k, np.int32)), *cols], names=[*keep, key, *names])

    return df.select(*keep, A.doubles(vec).alias("_vec")).mapInArrow(run, schema)
