"""Language identification with error-correcting output codes.

Every language has a codeword of bits; a binary classifier over hashed byte n-grams predicts each
bit. A text gets the language whose codeword has the smallest loss, each bit weighted by how
reliable its classifier was for that language; a small lead over the next one flags ambiguity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, map_batches

BUCKET_BITS = 13
ORDERS = (1, 2, 3)
SEGMENT = 1 << 20
# ASCII letters stay, other ASCII becomes a space; bytes of other characters stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased letters of a text, segment by segment, whole text."""
    raw = text.lower().encode("utf-8", "replace").translate(_LETTERS)
    for at in range(0, len(raw), SEGMENT):
        a = np.frombuffer(raw[max(0, at - max(ORDERS) + 1) : at + SEGMENT], np.uint8).astype(np.uint32)
        space = a == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        a = a[keep]
        code = np.zeros(len(a), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(a) < n:
                break
            code = (code[: len(a) - n + 1] << np.uint32(8)) | a[n - 1 :]
            if n in ORDERS:
                yield ((code + np.uint32(n << 29)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """One row of +1/-1 per class: every split of the classes up to five of them, a random code beyond."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= 5:
        bits = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(bits, np.float32).T
    rng = np.random.default_rng(seed)
    best, width = None, int(10 * np.ceil(np.log2(n)))
    for _ in range(50):
        m = np.where(rng.random((n, width)) < 0.5, -1, 1).astype(np.float32)
        apart = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if np.unique(m, axis=0).shape[0] == n and (abs(m.sum(0)) < n).all() and (best is None or apart > best[0]):
            best = (apart, m)
    return best[1]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # language x bit, rows add up to 1

    def decode(self, f: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and ambiguity of one row of bit margins."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = (self.trust * np.log1p(np.exp(-np.clip(self.code * f, -30, 30)))).sum(1)
        p = np.exp(-(loss - loss.min()) * 4.0)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.languages[order[0]], float(p[order[0]]), bool(p[order[0]] - p[order[1]] < 0.2)

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1], np.float64), 0
        for idx in gram_buckets(text):
            total += np.take(self.weights, idx, axis=0).sum(0)
            n += len(idx)
        return total / max(n, 1) + self.bias


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per sampled text: the histogram of the whole text and of a short piece of it."""
    for b in batches:
        out: dict[str, list] = {"lang": [], "idx": [], "cnt": []}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at = sum(map(ord, text[:64])) % max(1, len(text) - 60)
            for piece in (text, text[at : at + 60]):
                found = list(gram_buckets(piece))
                if found:
                    idx, cnt = np.unique(np.concatenate(found), return_counts=True)
                    out["lang"].append(lang)
                    out["idx"].append(idx.astype(np.int32))
                    out["cnt"].append((cnt / cnt.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["idx"], pa.list_(pa.int32())), pa.array(out["cnt"], pa.list_(pa.float32()))], names=["lang", "idx", "cnt"])


def fit(docs: DataFrame, lang_col: str, text_col: str, train: Column, per_language: int = 500, steps: int = 60) -> LanguageModel | None:
    """Fit on a bounded sample: about `per_language` rows of each language, chosen by a hash of their text, each
    text once however often it is repeated. Every value of `lang_col` is learnt; the sample grows with their number alone.

    None when no row qualifies.
    """
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sample = bounded_sample(rows, "lang", "text", per_language, distinct=True)
    got = map_batches(sample, _histograms, "lang string, idx array<int>, cnt array<float>").toArrow()
    if not got.num_rows:
        return None
    langs = got.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], len(got.column("idx")[i]), got.column("cnt")[i][0].as_py()))
    languages = sorted(set(langs))
    y = np.array([languages.index(langs[i]) for i in order])
    x = np.zeros((len(y), 1 << BUCKET_BITS), np.float32)
    for row, i in enumerate(order):
        x[row, got.column("idx")[i].values.to_numpy()] = got.column("cnt")[i].values.to_numpy()
    code = codewords(len(languages))
    scale = (1.0 / np.sqrt(x.mean(0) + 1e-4)).astype(np.float32)
    x *= scale
    t = code[y]  # rows x bits
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weight = (1.0 / share[y] / len(languages) / len(y)).astype(np.float32)[:, None]  # languages count alike
    m = [np.zeros_like(w), np.zeros_like(bias)]
    v = [np.zeros_like(w), np.zeros_like(bias)]
    for step in range(1, steps + 1):
        g = -weight * t / (1.0 + np.exp(np.clip(t * (x @ w + bias), -30, 30)))
        for k, (param, grad) in enumerate(((w, x.T @ g + 1e-6 * w), (bias, g.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            param -= 0.3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    right = ((x @ w + bias) * t > 0).astype(np.float64)
    trust = np.array([right[y == i].mean(0) for i in range(len(languages))]).reshape(len(languages), -1) + 1e-3
    trust /= np.maximum(trust.sum(1, keepdims=True), 1e-9)
    trust *= max(1, code.shape[1])
    return LanguageModel(languages, code, np.ascontiguousarray(w * scale[:, None]), bias, trust)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score, ambiguous. Whole texts, no shuffle.

    `und` with score 0 when the text is null, empty or has no letter, and for every text when there
    is no model. A repeated row gets the same answer again; ids may be null; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets x bits numbers, whatever the data
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mod = shared.value
        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py()
                if mod is None or not text or not any(map(str.isalpha, text)):
                    rows.append(("und", 0.0, False))
                else:
                    rows.append(mod.decode(mod.margins(text)))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, schema.types[1:]))], schema=schema)

    out = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)
