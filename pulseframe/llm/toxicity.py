"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the weights of the
hashed character n-grams in it; the sentences of a document are combined by noisy-or,
p = 1 - (1 - leak) * prod(1 - p_s). Only sentences with at least one weighted n-gram enter the
product; what they do not explain is one leak per document, whatever its number of sentences. In the score
the sentences under one half enter as the strongest of them, so that a text is not toxic by being
long. Only document labels are used: the weights are fitted to the likelihood of the documents,
and afterwards say which sentences offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, filter_rows, map_batches, pinned

BITS = 18
ORDERS = (4, 6)
SEGMENT = 1 << 20
ENDS = ".!?\n"
_END = re.compile(f"[{re.escape(ENDS)}]")
# ASCII letters stay, sentence ends become a line feed, other ASCII a space; bytes of other characters stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 10 if chr(c) in ENDS else 32 for c in range(256))


def sentence_grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sentence number, hashed n-gram) arrays of the whole text, segment by segment.

    The text is lower-cased; n-grams may start with the space before a word and never cross a
    sentence end. Sentence k is what lies between the ends k and k + 1 of the text.
    """
    raw = (" " + text.lower()).encode("utf-8", "replace").translate(_LETTERS).replace(b"\n", b"\n ")
    before, overlap = 0, max(ORDERS) - 1
    for at in range(0, len(raw), SEGMENT):
        lead = min(at, overlap)
        a = np.frombuffer(raw[at - lead : at + SEGMENT], np.uint8)
        end = a == 10
        sentence = before - int(end[:lead].sum()) + np.cumsum(end)
        before += int(end[lead:].sum())
        blocked = np.concatenate(([0], np.cumsum(end)))
        wide = a.astype(np.uint64)
        code = np.zeros(len(a), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(a) < n:
                break
            code = (code[: len(a) - n + 1] << np.uint64(8)) | wide[n - 1 :]
            if n in ORDERS:
                ok = blocked[n:] == blocked[: len(a) - n + 1]
                ok &= a[n - 1 :] != 32  # a gram ends inside a word
                ok[: max(0, lead - n + 1)] = False  # counted with the segment before
                yield sentence[: len(ok)][ok], ((code[ok] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one per bucket
    bias: float
    leak: float  # logit of a document without any weighted n-gram
    a: float = 1.0
    b: float = 0.0

    def sentence_logits(self, text: str) -> np.ndarray:
        n = 1 + sum(text.count(e) for e in ENDS)
        found = [sentence[hit] << BITS | gram[hit] for sentence, gram in sentence_grams(text) if (hit := self.weights[gram] > 0).any()]
        if not found:
            return np.zeros(n)
        key = np.unique(np.concatenate(found))  # a gram counts once in a sentence
        return np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)], minlength=n)[:n]

    def score(self, text: str) -> tuple[float, np.ndarray]:
        """Document score and the probability of each sentence, 0 for one without weighted n-grams."""
        found = self.sentence_logits(text)
        z = np.clip(found + self.bias, -30, 30)
        p = np.where(found > 0, 1 / (1 + np.exp(-z)), 0.0)
        weak = (found > 0) & (p < 0.5)  # faint suspicions would add up with the length of the text: the strongest stands for them
        log_not = -np.logaddexp(0, z)[p >= 0.5].sum() - np.logaddexp(0, z[weak].max(initial=-30.0)) - np.logaddexp(0, self.leak)
        odds = float(np.log(max(-np.expm1(log_not), 1e-12)) - log_not)
        return 1 / (1 + float(np.exp(-np.clip(self.a * odds + self.b, -30, 30)))), p

    def offending(self, text: str, p: np.ndarray) -> list[dict]:
        """Sentences with probability one half or more: start and end (code points) and probability."""
        at = np.flatnonzero(p >= 0.5)
        if not len(at):
            return []
        edges = [0, *(m.end() for m in _END.finditer(text)), len(text)]
        return [{"start": edges[i], "end": edges[i + 1], "p": float(p[i])} for i in at]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.unique(np.concatenate([np.zeros(0, np.int32), *(g for _, g in sentence_grams(t or ""))])) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["label", "grams"])


def _selected(shared):
    """Per sampled text and sentence with any of the chosen grams: their positions in the list of chosen grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value
        for b in batches:
            labels, sizes, where, which = [], [], [], []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                s, g = (np.concatenate(c) for c in zip(*([(np.zeros(0, np.int64), np.zeros(0, np.int32))] + list(sentence_grams(text)))))
                k = np.searchsorted(chosen, g)
                hit = chosen[np.minimum(k, len(chosen) - 1)] == g
                labels.append(label)
                sizes.append(1 + sum(text.count(e) for e in ENDS))
                key = np.unique(s[hit] << BITS | k[hit])
                where.append((key >> BITS).astype(np.int32))
                which.append((key & ((1 << BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(sizes, pa.int64()), pa.array(where, pa.list_(pa.int32())), pa.array(which, pa.list_(pa.int32()))], names=["label", "sentences", "sentence", "gram"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000, features: int = 4000, steps: int = 250) -> ToxicityModel | None:
    """Fit on a bounded sample of labelled rows: about `per_class` documents of each label, chosen by a
    hash of the id. `train` says which ids may be learnt from. The `features` buckets that differ
    most between the labels get weights. None when a label is missing.
    """
    spark = docs.sparkSession
    known = labels.filter(train & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["_id"])
    chosen = bounded_sample(known, "label", "_id", per_class)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    rows = pinned(texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("label", "text"))  # two classes of a bounded number of ids
    df = np.zeros((2, 1 << BITS), np.int64)
    n = np.zeros(2)
    for b in map_batches(rows, _distinct, "label int, grams array<int>").toArrow().to_batches():
        for label, grams in zip(b.column(0).to_pylist(), b.column(1)):
            df[label][grams.values.to_numpy()] += 1
            n[label] += 1
    if not n.all():
        return None
    # Standardized difference of document shares.
    share = (df + 0.5) / (n[:, None] + 1)
    z = (share[1] - share[0]) / np.sqrt(share[1] * (1 - share[1]) / n[1] + share[0] * (1 - share[0]) / n[0])
    z[(df[1] < 3) | (share[1] < 4 * share[0])] = 0  # grams that are common without offence say nothing
    order = np.argsort(-z, kind="stable")[:features]
    strong = order[z[order] > 3.5]
    picks = np.sort(strong if len(strong) >= 16 else order[:16]).astype(np.int32)
    got = map_batches(rows, _selected(spark.sparkContext.broadcast(picks)), "label int, sentences long, sentence array<int>, gram array<int>").toArrow()
    y = np.array(got.column("label").to_pylist(), np.float64)
    sizes = np.array(got.column("sentences").to_pylist(), np.int64)
    count = np.array([len(v) for v in got.column("gram")])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    sent = np.concatenate([np.zeros(0, np.int64), *(v.values.to_numpy().astype(np.int64) + o for v, o in zip(got.column("sentence"), base))])
    gram = np.concatenate([np.zeros(0, np.int64), *(v.values.to_numpy().astype(np.int64) for v in got.column("gram"))])
    # Only sentences with a chosen gram are kept; the others do not enter the noisy-or.
    used, sent = np.unique(sent, return_inverse=True)
    doc_of = np.searchsorted(base, used, side="right") - 1
    cw = (np.array([0.8, 0.2]) / np.maximum(np.array([(y == 0).sum(), (y == 1).sum()]), 1))[y.astype(int)]  # a false alarm weighs more
    w, bias, leak = np.full(len(picks), 0.05), -5.0, -5.0
    m, v = np.zeros(len(picks) + 2), np.zeros(len(picks) + 2)
    for k in range(1, steps + 1):
        s = np.clip(np.bincount(sent, w[gram], minlength=len(used)) + bias, -30, 30)
        enters = np.bincount(sent, w[gram] > 0, minlength=len(used)) > 0  # as in the score, a weight of 0 is none
        p, p0 = enters / (1 + np.exp(-s)), 1 / (1 + np.exp(-leak))
        log_not = np.bincount(doc_of, -np.logaddexp(0, s) * enters, minlength=len(y)) - np.logaddexp(0, leak)
        q = np.maximum(-np.expm1(log_not), 1e-9)  # noisy-or
        # d(-log-likelihood)/d(sentence score) = p_s * (1 - y / q)
        back = cw * (1 - y / q)
        d = back[doc_of] * p
        grad = np.append(np.bincount(gram, d[sent], minlength=len(w)) + 1e-5 * w, [d.sum(), back.sum() * p0])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, bias, leak = np.maximum(w - move[:-2], 0.0), bias - move[-2], leak - move[-1]  # chosen grams speak for toxicity or not at all
    full = np.zeros(1 << BITS)
    full[picks] = w
    return ToxicityModel(full, float(bias), float(leak))


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score, predicted (score >= 0.5), n_sentences, offending (start, end, p of each sentence found).

    Whole texts, no shuffle. A null text counts as empty; an empty text is one empty sentence.
    Without a model every score is 0. Repeated rows and null ids come out as they went in; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_sentences", pa.int64()), ("offending", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py() or ""
                if model is None:
                    rows.append((0.0, 0, 1, []))
                    continue
                s, p = model.score(text)
                rows.append((s, int(s >= 0.5), len(p), model.offending(text, p)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, schema.types[1:]))], schema=schema)

    out = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, score double, predicted int, n_sentences long, offending array<struct<start: long, end: long, p: double>>")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under 0.5, all columns as they were; all rows without a model."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, text_col, lambda: lambda texts: [shared.value.score(t or "")[0] < 0.5 for t in texts])
