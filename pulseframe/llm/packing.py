"""Harmonic packing of token sequences, independently in every task.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], and a
bin of class k takes exactly k pieces. A document is cut freely so that its pieces lie just
under the upper end of their class: full bins first, then the longest reciprocal length that
fits, until what is left wastes at most `slack` tokens per bin in its own class. A task fills
the open bin of each class on its own and never waits for another. What is left open when the
task ends is laid end to end and cut into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .byte_bpe import compile_pattern
from .common import map_batches, slices, worker_cache
from .pretokens import TextEncoder

SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

JOINT = 2000  # words in one call of the tokenizer


def cuts(n: int, capacity: int, slack: int) -> list[int]:
    """Piece lengths of a document of n tokens; they add up to n."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if (capacity - k * n) <= slack:
            out.append(n)
            break
        piece = capacity // (k + 1)  # the next reciprocal length below n
        out.append(piece)
        n -= piece
    return out


class HarmonicPacker:
    """Bins of one task. add() and close() yield (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int, slack: int, first_sequence: int) -> None:
        self.capacity, self.slack, self._next = capacity, slack, first_sequence
        self._open: dict[int, list[tuple]] = {}

    def _sequence(self) -> int:
        self._next += 1
        return self._next - 1

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        seq, offset = self._sequence(), 0
        for doc, start, length in pieces:
            yield doc, start, length, seq, offset
            offset += length

    def add(self, doc, n: int) -> Iterator[tuple]:
        start = 0
        for length in cuts(n, self.capacity, self.slack):
            k = self.capacity // length
            pieces = self._open.setdefault(k, [])
            pieces.append((doc, start, length))
            start += length
            if len(pieces) == k:
                yield from self._emit(self._open.pop(k))

    def close(self) -> Iterator[tuple]:
        """Bins that are not full: their pieces end to end, cut at the capacity and then at powers of two."""
        rest = [p for k in sorted(self._open) for p in self._open[k]]
        self._open.clear()
        total = sum(p[2] for p in rest)
        room, pieces = min(self.capacity, total) if total >= self.capacity else 1 << total.bit_length() >> 1, []
        for doc, start, length in rest:
            while length:
                take = min(length, room)
                pieces.append((doc, start, take))
                start, length, room, total = start + take, length - take, room - take, total - take
                if not room:
                    yield from self._emit(pieces)
                    pieces, room = [], self.capacity if total >= self.capacity else 1 << total.bit_length() >> 1


@worker_cache("packing")
def text_encoder(path: str, pattern: str) -> TextEncoder:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text

    sizes = np.zeros(t.get_vocab_size(), np.int64)  # bytes of every token: byte-level vocabularies write one character a byte
    for token, i in t.get_vocab().items():
        sizes[i] = len(token)

    def each(found: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(found, add_special_tokens=False)]

    def words(found: list[str]) -> list[bytes]:
        """Words of one space and letters keep their borders when laid end to end, so these take one call; their ids are told apart by bytes."""
        joint = [w[0] == " " and w[1:].isalpha() for w in found]
        out: list[bytes] = [b""] * len(found)
        alone = [i for i, j in enumerate(joint) if not j]
        for i, b in zip(alone, each([found[i] for i in alone])):
            out[i] = b
        together = [i for i, j in enumerate(joint) if j]
        for at in range(0, len(together), JOINT):
            part = together[at : at + JOINT]
            text = "".join([found[i] for i in part])
            packed = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(sizes[packed])
            raw = np.frombuffer(text.encode(), np.uint8)
            last = np.append(np.flatnonzero(raw == 32)[1:], len(raw))  # a word ends before the next space
            to = np.searchsorted(ends, last) + 1
            if to[-1] != len(packed) or (ends[to - 1] != last).any():
                raise ValueError("the tokenizer joined words over a space")
            raw, begin = packed.tobytes(), 0
            for i, stop in zip(part, (4 * to).tolist()):
                out[i] = raw[begin:stop]
                begin = stop
        return out

    return TextEncoder(words, lambda s: each([s])[0], compile_pattern(pattern))


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 1, slack: int = 32, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Pack all documents: one row per piece with id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document is its token ids and then `end_id`; a null or empty text has only that one. Rows
    with the same id, or a null id, are packed as documents of their own. Other columns are
    ignored. An empty table gives no rows. `pattern` is the pre-token pattern of the
    vocabulary, used only to look words up that were tokenized before. sequence_id is the task's partition number times
    2^33 plus a counter, so a task that runs again gives the same rows as before.
    """
    fields = [pa.field(n, pa.int64()) for n in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
    out_schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tok = text_encoder(path, pattern)
        packer = HarmonicPacker(capacity, slack, TaskContext.get().partitionId() << 33)
        end = int(end_id).to_bytes(4, "little")
        held: dict[int, list] = {}  # ids of documents with pieces in open bins: key -> [id, packed ids, tokens not placed]
        key = 0

        def record(placed) -> pa.RecordBatch:
            rows: dict[str, list] = {f.name: [] for f in fields}
            for k, start, length, seq, offset in placed:
                doc = held[k]
                part = doc[1][4 * start : 4 * (start + length)]
                for name, v in zip(rows, (doc[0], start, length, zlib.crc32(part), len(doc[1]) // 4, seq, offset)):
                    rows[name].append(v)
                if ids:
                    rows["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                doc[2] -= length
                if not doc[2]:
                    del held[k]
            return pa.RecordBatch.from_pydict(rows, schema=out_schema)

        for b in slices(batches):
            placed: list[tuple] = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, packed in zip(b.column(0).to_pylist(), tok.encode_many(texts)):
                packed += end
                n = len(packed) // 4
                held[key] = [i, packed, n]
                placed += packer.add(key, n)
                key += 1
            yield record(placed)
        yield record(packer.close())

    schema = SCHEMA + (", ids array<int>" if ids else "")
    out = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema, keeps="packing")
    return out.withColumnRenamed("id", id_col)
