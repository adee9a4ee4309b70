"""Document quality by a linear-chain conditional random field over lines.

Every line has numbers that describe it (symbols, capitals, repeated words, ...) and those of the
line before and after. A chain with the states bad and good gives each line its marginal
probability by forward-backward; the marginals, weighted by line length, give the quality of the
document. Labels exist for documents only, so fitting alternates: label the lines of rejected
documents with the present model, then fit the chain to these labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, filter_rows, map_batches

BASE = 14  # numbers per line
CHUNK = 1 << 19  # code points handled at once
LETTER, UPPER, DIGIT, SPACE, STOP, SYMBOL = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    t = np.zeros(1 << 16, np.uint8)
    for c in range(len(t)):
        s = category(chr(c))
        t[c] = LETTER | (UPPER if s == "Lu" else 0) if s[0] == "L" else DIGIT if s[0] == "N" else SPACE if s[0] == "Z" or chr(c).isspace() else STOP if chr(c) in ".,;:?'\"()-" else SYMBOL
    return t


@lru_cache(maxsize=1)
def _powers(n: int = CHUNK + 1) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = base, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def line_numbers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x BASE numbers, line lengths) of a whole text; an empty text is one empty line.

    Long texts go in parts of whole lines, about CHUNK code points each; a longer line is a part of its own.
    """
    parts, at = [], 0
    while len(text) - at > CHUNK:
        cut = text.rfind("\n", at, at + CHUNK)
        cut = cut if cut >= 0 else text.find("\n", at + CHUNK)
        if cut < 0:
            break
        parts.append(_numbers(text[at:cut]))
        at = cut + 1
    parts.append(_numbers(text[at:] if at else text))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _numbers(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    kind = _kinds()[np.minimum(c, 0xFFFF)]
    ends = np.flatnonzero(c == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    # One more row of zeros per line end keeps reduceat right for empty lines.
    per = lambda x: np.add.reduceat(x, starts, dtype=np.float64) - x[ends]
    letters, upper = per((kind & LETTER != 0).astype(np.int32)), per((kind & UPPER != 0).astype(np.int32))
    digits, spaces = per((kind & DIGIT != 0).astype(np.int32)), per((kind & SPACE != 0).astype(np.int32))
    symbol = kind & SYMBOL != 0
    same = np.zeros(n, np.int32)
    same[1:] = (c[1:] == c[:-1]) & symbol[1:]
    symbols, repeats = per(symbol.astype(np.int32)), per(same)
    bars, bangs = per((c == 124).astype(np.int32)), per((c == 33).astype(np.int32))
    # Words and their hashes by prefix sums of a polynomial.
    word = kind & SPACE == 0
    edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers() if n <= CHUNK + 1 else _powers(n)
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((c.astype(np.uint64) + np.uint64(7)) * up[:n], dtype=np.uint64)))
    h = (prefix[we] - prefix[ws]) * down[ws]
    line = np.searchsorted(ends, ws)
    words = np.bincount(line, minlength=len(ends)).astype(np.float64)
    again = np.zeros(len(ws), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    doubled = np.bincount(line[again], minlength=len(ends))
    if len(ws):
        order = np.lexsort((h, line))
        first = np.ones(len(ws), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order][first], minlength=len(ends))
    else:
        distinct = np.zeros(len(ends))
    m, w = np.maximum(size, 1), np.maximum(words, 1)
    last = np.where(size > 0, kind[np.maximum(ends - 1, 0)] & STOP != 0, False)
    x = np.stack([np.log1p(size), letters / m, upper / np.maximum(letters, 1), digits / m, symbols / m, bars / m * 10, spaces / m, bangs / w, (size - spaces) / w / 10, doubled / w, repeats / m, last, distinct / w, np.log1p(words)], 1)
    return x, size.astype(np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Numbers of the line, of the line before and of the line after (zeros at the ends), and a one."""
    z = np.zeros((1, x.shape[1]))
    return np.concatenate([x, np.concatenate([z, x[:-1]]), np.concatenate([x[1:], z]), np.ones((len(x), 1))], 1)


def marginals(score: np.ndarray, step: np.ndarray, lengths: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for many chains at once.

    score: lines x 2 log potentials, chains one after another; step: 2 x 2 log potentials of
    neighbouring states. Returns state marginals, expected state pairs (2 x 2 sums, each pair counted with
    the weight of its first line) and the log partition sums.
    """
    order = np.argsort(-lengths, kind="stable")
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    size = lengths[order]
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alive = np.searchsorted(-size, -np.arange(1, size.max(initial=0) + 1), side="right")
    lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for t, k in enumerate(alive):
        at = start[:k] + t
        alpha[at] = score[at] if t == 0 else score[at] + np.logaddexp(alpha[at - 1, 0, None] + step[0], alpha[at - 1, 1, None] + step[1])
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        nxt = beta[at + 1] + score[at + 1]
        beta[at] = np.stack([lse(nxt + step[0]), lse(nxt + step[1])], 1)
    total = np.empty(len(lengths))
    total[order] = lse(alpha[start + size - 1])
    z = np.repeat(total, lengths)
    p = np.exp(alpha + beta - z[:, None])
    inside = np.ones(len(score), bool)
    inside[np.cumsum(lengths) - 1] = False
    at = np.flatnonzero(inside)
    pairs = np.exp(alpha[at][:, :, None] + step[None] + (score + beta)[at + 1][:, None, :] - z[at][:, None, None])
    pairs = (pairs if weight is None else pairs * weight[at][:, None, None]).sum(0)
    return p, pairs, total


@dataclass
class QualityModel:
    mean: np.ndarray
    sd: np.ndarray
    w: np.ndarray  # numbers of a line and its neighbours -> log odds of good
    step: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def line_scores(self, x: np.ndarray) -> np.ndarray:
        s = with_neighbours((x - self.mean) / self.sd) @ self.w
        return np.stack([np.zeros_like(s), s], 1)

    def good_lines(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Marginal probability of good for every line of every text."""
        sizes = np.array([len(x) for x in xs], np.int64)
        if not len(sizes):
            return []
        p, _, _ = marginals(np.concatenate([self.line_scores(x) for x in xs]), self.step, sizes)
        return np.split(p[:, 1], np.cumsum(sizes)[:-1])

    @staticmethod
    def share(good: np.ndarray, size: np.ndarray) -> float:
        """Log odds of the length-weighted share of good."""
        s = min(max(float((good * (size + 1)).sum() / (size + 1).sum()), 1e-4), 1 - 1e-4)
        return float(np.log(s / (1 - s)))

    def scores(self, texts: list[str]) -> list[tuple[float, int, int]]:
        """(score, lines, bad lines) of whole texts."""
        got = [line_numbers(t) for t in texts]
        out = []
        for (_, size), good in zip(got, self.good_lines([x for x, _ in got])):
            out.append((1.0 / (1.0 + float(np.exp(-(self.a * self.share(good, size) + self.b)))), len(size), int((good < 0.5).sum())))
        return out


def _sampled_lines(most_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, flat, sizes = [], [], []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, size = line_numbers(text or "")
                if len(size) <= most_lines:
                    labels.append(label)
                    flat.append(x.astype(np.float32).ravel())
                    sizes.append(size.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(flat, pa.list_(pa.float32())), pa.array(sizes, pa.list_(pa.int32()))], names=["label", "x", "size"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, most_lines: int = 500, rounds: int = 3, steps: int = 60) -> QualityModel | None:
    """Fit on a bounded sample of labelled rows: about `per_class` documents of each label, chosen by a
    hash of the id, those of more than `most_lines` lines left out of fitting. `train` says which ids may be learnt
    from. None when there is no labelled row.
    """
    known = labels.filter(train & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["_id"])
    chosen = bounded_sample(known, "label", "_id", per_class)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("label", "text")  # two classes of a bounded number of ids
    got = map_batches(rows, _sampled_lines(most_lines), "label int, x array<float>, size array<int>").toArrow()
    if not got.num_rows:
        return None
    y = np.array(got.column("label").to_pylist())
    xs = [np.array(v.values, np.float64).reshape(-1, BASE) for v in got.column("x")]
    sizes = [np.array(v.values, np.float64) for v in got.column("size")]
    order = sorted(range(len(y)), key=lambda i: (y[i], len(sizes[i]), xs[i].sum()))
    y, xs, sizes = y[order], [xs[i] for i in order], [sizes[i] for i in order]
    count = np.array([len(x) for x in xs], np.int64)
    flat = np.concatenate(xs)
    model = QualityModel(flat.mean(0), flat.std(0) + 1e-3, np.zeros(3 * BASE + 1), np.zeros((2, 2)))
    f = np.concatenate([with_neighbours((x - model.mean) / model.sd) for x in xs])
    doc = np.repeat(np.arange(len(y)), count)
    weight = np.repeat(0.5 / np.maximum(np.bincount(y, minlength=2)[y], 1) / count, count)  # classes and documents count alike
    ends = np.cumsum(count) - 1
    inner = np.ones(len(f), bool)
    inner[ends] = False
    inner = np.flatnonzero(inner)
    line = y[doc].astype(np.int64)
    m1 = m2 = None
    for r in range(rounds):
        pair = np.zeros((2, 2))
        np.add.at(pair, (line[inner], line[inner + 1]), weight[inner])
        m1, m2 = np.zeros(len(model.w)), np.zeros(len(model.w))
        for k in range(1, steps + 1):
            s = f @ model.w
            p, q, _ = marginals(np.stack([np.zeros_like(s), s], 1), model.step, count, weight)
            grad = f.T @ ((p[:, 1] - line) * weight) + 1e-4 * model.w
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
            model.w = model.w - 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
            model.step = np.clip(model.step + 0.5 * (pair - q), -3, 3)
        if r < rounds - 1:  # lines of rejected documents: bad where the model says so, the worst one in any case
            s = f @ model.w
            p, _, _ = marginals(np.stack([np.zeros_like(s), s], 1), model.step, count)
            line = np.where(y[doc] == 1, 1, (p[:, 1] > 0.5).astype(np.int64))
            for d in np.flatnonzero(y == 0):
                a, b = ends[d] - count[d] + 1, ends[d] + 1
                line[a + int(np.argmin(p[a:b, 1]))] = 0
    # Document scores: log odds of the good share, scaled on the same sample.
    share = np.array([QualityModel.share(g, n) for g, n in zip(model.good_lines(xs), sizes)])
    cw = 0.5 / np.maximum(np.bincount(y, minlength=2)[y], 1)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))
        g, hess = cw * (p - y), cw * p * (1 - p)
        grad = np.array([(g * share).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        hh = np.array([[(hess * share * share).sum() + 1e-3, (hess * share).sum()], [(hess * share).sum(), hess.sum() + 1e-3]])
        delta = np.linalg.solve(hh, grad)
        a, b = a - delta[0], b - delta[1]
        if abs(delta).max() < 1e-9:
            break
    model.a, model.b = float(a), float(b)
    return model


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (higher is better), predicted (score >= 0.5), n_lines, n_bad_lines.

    Whole texts, no shuffle. A null text counts as empty, and an empty one is scored as one empty
    line. Without a model every score is 0.5. Repeated rows and null ids come out as they went
    in; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 60 numbers
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_lines", pa.int64()), ("n_bad_lines", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = m.scores(texts) if m else [(0.5, t.count("\n") + 1, 0) for t in texts]
                s, n, bad = zip(*got)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array(n, pa.int64()), pa.array(bad, pa.int64())], schema=schema)

    out = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, score double, predicted int, n_lines long, n_bad_lines long")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that score 0.5 or more, all columns as they were; all rows without a model."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, text_col, lambda: lambda texts: [s >= 0.5 for s, _, _ in shared.value.scores([t or "" for t in texts])])
