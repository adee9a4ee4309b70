"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte positions. Every adjacent pair that the vocabulary
can merge waits in the bucket of its merge rank; a bitmap in three levels of 64-bit words marks
the buckets that are not empty, so the next rank is found by three find-first-set steps however
many ranks there are. Entries whose pair has changed since are skipped when they come up. A
pre-token of n bytes takes O(n log n) steps (the log only inside one bucket), so very long
pre-tokens are no special case.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, slices, worker_cache
from .pretokens import WHITE, TextEncoder


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


FIRST = {1 << k: k for k in range(64)}  # find-first-set of a word with one bit


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: re.Pattern) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._pairs = [-1] * 65536  # rank of every two bytes
        for k, v in ranks.items():
            if len(k) == 2:
                self._pairs[k[0] << 8 | k[1]] = v
        n = max(ranks.values(), default=0) + 1
        self._byte_ids = [ranks.get(bytes([b])) for b in range(256)]
        # The bitmap: a bit of `low` per rank, of `mid` per word of `low`, of `top` per word of `mid`.
        self._low, self._mid = [0] * (n // 64 + 1), [0] * (n // 4096 + 1)
        self._buckets: list[list[int]] = [[] for _ in range(n)]  # all empty between two pre-tokens
        self._texts = TextEncoder(self._encode_words, self._encode_text, pattern)

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(token)
        if whole is not None:
            return [whole]
        n = len(token)
        pairs, low, mid, buckets, rank_of, first = self._pairs, self._low, self._mid, self._buckets, ranks.get, FIRST
        top = 0
        ids = [*map(self._byte_ids.__getitem__, token)]  # id of the part that starts here, -1 where it is merged away
        end = list(range(1, n + 1))  # a part runs from its position to end[position]
        before = list(range(-1, n - 1))
        now = [pairs[a << 8 | b] for a, b in zip(token, token[1:])]  # rank of the pair that starts here
        for i, r in enumerate(now):
            if r >= 0:
                b = buckets[r]
                if not b:
                    w = r >> 6
                    low[w] |= 1 << (r & 63)
                    mid[r >> 12] |= 1 << (w & 63)
                    top |= 1 << (r >> 12)
                b.append(i)
        now.append(-1)
        while top:
            # Find-first-set on three levels.
            m = (top & -top).bit_length() - 1
            x = mid[m]
            w = m << 6 | first[x & -x]
            x = low[w]
            rank = w << 6 | first[x & -x]
            b = buckets[rank]
            i = heappop(b)
            if not b:
                low[w] = x = x & (x - 1)
                if not x:
                    mid[m] = x = mid[m] & (mid[m] - 1)
                    if not x:
                        top &= top - 1
            if now[i] != rank:  # stale: the pair at this position is another one by now, or none
                continue
            j = end[i]
            k = end[i] = end[j]
            now[j] = ids[j] = -1
            ids[i] = rank
            if k < n:
                before[k] = i
                now[i] = r = rank_of(token[i : end[k]], -1)
                if r >= 0:
                    b = buckets[r]
                    if b:
                        heappush(b, i)
                    else:
                        b.append(i)
                        w = r >> 6
                        low[w] |= 1 << (r & 63)
                        mid[r >> 12] |= 1 << (w & 63)
                        top |= 1 << (r >> 12)
            else:
                now[i] = -1
            i = before[i]
            if i >= 0:
                now[i] = r = rank_of(token[i:k], -1)
                if r >= 0:
                    b = buckets[r]
                    if b:
                        heappush(b, i)
                    else:
                        b.append(i)
                        w = r >> 6
                        low[w] |= 1 << (r & 63)
                        mid[r >> 12] |= 1 << (w & 63)
                        top |= 1 << (r >> 12)
        if None in ids:
            raise KeyError("a byte of the text is not in the vocabulary")
        return [v for v in ids if v != -1]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (self.merge(w.encode("utf-8", "surrogatepass")) for w in words)]

    def _encode_text(self, text: str) -> bytes:
        return b"".join(self._encode_words(self.pattern.findall(text)))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        return self._texts.encode_many(texts)

    def encode(self, text: str) -> list[int]:
        b = self.encode_packed([text])[0]
        return list(struct.unpack(f"<{len(b) // 4}I", b))

    def decode(self, ids) -> bytes:
        """The bytes of the ids; an unknown id is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """Character ranges of the letter and of the number categories."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in found:
            spans = found[kind]
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    esc = lambda c: f"\\U{c:08x}"
    letters, numbers = ("".join(f"{esc(a)}-{esc(b)}" for a, b in found[k]) for k in "LN")
    return letters, numbers


@lru_cache(maxsize=4)
def compile_pattern(pattern: str) -> re.Pattern:
    """The pre-token pattern for the re module: letter, number and white-space classes written out."""
    letters, numbers = _classes()
    inside = lambda m: m[0].replace(r"\s", WHITE).replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
    p = re.sub(r"\[[^\]]*\]", inside, pattern)
    return re.compile(p.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


@worker_cache("byte_bpe")
def encoder(path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(load_ranks(path), compile_pattern(pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Encode whole texts and decode the ids again: id, n_tokens, ids (array, if asked for), ids_sha256, decoded_sha256, exact.

    `exact` is true when the decoded bytes are the text. A null text counts as empty and has no
    ids. Rows are handled one by one, so repeated rows and null ids come out as they went in;
    other columns are ignored. No shuffle.
    """
    fields = [pa.field("id", pa.int64()), pa.field("n_tokens", pa.int64())] + ([pa.field("ids", pa.list_(pa.int32()))] if ids else []) + [pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string()), pa.field("exact", pa.bool_())]
    out_schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in slices(batches):
            rows: dict[str, list] = {f.name: [] for f in fields}
            texts = [t or "" for t in b.column(1).to_pylist()]
            for key, text, packed in zip(b.column(0).to_pylist(), texts, enc.encode_packed(texts)):
                got = memoryview(packed).cast("I") if packed else ()
                raw = enc.decode(got)
                rows["id"].append(key)
                rows["n_tokens"].append(len(got))
                if ids:
                    rows["ids"].append(list(got))
                rows["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                rows["exact"].append(raw == text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict(rows, schema=out_schema)

    schema = "id long, n_tokens long, " + ("ids array<int>, " if ids else "") + "ids_sha256 string, decoded_sha256 string, exact boolean"
    out = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema, keeps="byte_bpe")
    return out.withColumnRenamed("id", id_col)
