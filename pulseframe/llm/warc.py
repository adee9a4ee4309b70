"""WARC archives in seekable Zstandard bundles.

A bundle is one file. Records are gathered into frames of about `frame_bytes`, every frame is
compressed on its own, and a skippable frame at the end holds the seek table of the public
seekable format: compressed and plain size of each frame. Any tool that reads Zstandard
reads the file as one WARC; a reader that knows the table fetches single frames.

Every task writes bundles of its own under names that no other attempt uses, straight to the shared folder,
and returns one index row per record: identifier, bundle, frame, offset and length inside the
plain frame. The index is a table that Spark commits, so only the bundles it names belong to the archive; what a lost task
leaves behind is never read. Reading takes the seek tables first and deals frames, not files, to the tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_folder
from .common import map_batches, pinned

# Fixed values of the seekable Zstandard format: magic of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")  # number of frames, descriptor, magic
# Fixed value: the profile of WARC 1.1 for a revisit with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, record_type string, bundle string, frame int, at long, length long"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store behind a folder name such as file:///x, hdfs://host/x, s3a://bucket/x or /x."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!//)", "file:///", uri)))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(record: str) -> int | None:
    return int(record[9:]) if record[9:] else None


def _head(first: str, fields: list[tuple[str, object]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit holds the HTTP head only, with the length of the full payload."""
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if revisit else http + payload
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id(page_id)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or record_id(page_id))), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, dict(line.split(": ", 1) for line in lines)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC fields, HTTP fields, payload, end) of the record that begins at `at`; broken records are errors."""
    cut = data.index(b"\r\n\r\n", at)
    first, fields = _fields(data[at:cut])
    size = int(fields["Content-Length"])
    block = data[cut + 4 : cut + 4 + size]
    end = cut + 8 + size
    if first != "WARC/1.1" or len(block) != size or data[end - 4 : end] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"broken record at {at}")
    head = block.index(b"\r\n\r\n")
    return fields, _fields(block[:head])[1], block[head + 4 :], end


class Bundle:
    """One seekable file under way."""

    def __init__(self, folder: str, frame_bytes: int, level: int):
        self.fs, path = filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{path}/{self.name}", compression=None)  # frames are compressed here
        self.frame_bytes, self.codec = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.plain, self.waiting, self.frames, self.size = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the plain frame) of the record."""
        if self.waiting and self.waiting + len(data) > self.frame_bytes:
            self.flush()
        spot = len(self.frames), self.waiting
        self.plain.append(data)
        self.waiting += len(data)
        return spot

    def flush(self) -> None:
        if self.plain:
            packed = self.codec.compress(b"".join(self.plain))
            self.out.write(packed)
            self.frames.append((len(packed), self.waiting))
            self.size += len(packed)
            self.plain, self.waiting = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + FOOTER.size) + table + FOOTER.pack(len(self.frames), 0, SEEKABLE))
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the end of an open bundle."""
    size = f.size()
    f.seek(size - FOOTER.size)
    n, kind, magic = FOOTER.unpack(f.read(FOOTER.size))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    wide = 12 if kind & 0x80 else 8  # with or without a checksum per frame
    f.seek(size - FOOTER.size - n * wide)
    table = f.read(n * wide)
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * wide)
        out.append((at, packed, plain))
        at += packed
    return out


def frame_at(f, at: int, packed: int, plain: int) -> bytes:
    f.seek(at)
    return zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)


# Payloads that occur more often than this are dealt out over several join keys.
HOT = 1 << 16


def roles(pages: DataFrame, id_col: str, text_col: str, least_bytes: int, small: int = 200_000) -> DataFrame:
    """The rows of `pages` with the columns _revisit and _first: the smallest id among the rows with an equal payload.

    Payloads are compared by SHA-256; only ids and digests are grouped. Repeated payloads are
    broadcast when a count shows that they are few, else joined by a shuffle in which a frequent payload is dealt out over many keys.
    """
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    keyed = pages.withColumns({"_key": F.unhex(F.sha2(payload, 256)), "_long": F.octet_length(payload) >= least_bytes})
    many = pinned(keyed.filter("_long").groupBy("_key").agg(F.min(id_col).alias("_least"), F.count("*").alias("_n")).filter("_n > 1"))
    if many.count() <= small:
        met = keyed.join(F.broadcast(many.select("_key", "_least")), "_key", "left")
    else:
        hot = F.broadcast(many.filter(F.col("_n") > HOT).select("_key", F.ceil(F.col("_n") / HOT).alias("_spots")))  # one row per HOT rows at most
        dealt = keyed.join(hot, "_key", "left").withColumn("_spot", F.coalesce(F.pmod(F.xxhash64(id_col), F.col("_spots")), F.lit(0).cast("long"))).drop("_spots")
        firsts = many.select("_key", "_least", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / HOT) - 1)).alias("_spot"))
        met = dealt.join(firsts, ["_key", "_spot"], "left").drop("_spot")
    revisit = F.col("_long") & F.col("_least").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_least"))
    return met.withColumn("_revisit", F.coalesce(revisit, F.lit(False))).select("*", F.when(F.col("_revisit"), F.col("_least")).alias("_first"))


def write_archive(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0,
    frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write one WARC record per row and return the index: page_id, record_id, record_type, bundle, frame, at, length.

    Of rows with equal payloads of at least `least_bytes` bytes the one with the smallest id is the response, the others
    revisit it; rows that repeat this smallest id with the payload are responses as well, since the id cannot tell them apart. Rows without an
    id never come first, unless all copies lack one. A null text is an empty payload; a null url is
    written as the record id, control characters and blanks in a url as percent codes. No rows give an empty index. Other columns are
    ignored. A payload longer than a frame has a frame of its own (up to 4 GB plain, the format's limit). `folder` (default: a new one in the
    shared folder) must be open to executors under the same name.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).alias("html"))
    rows = roles(slim, "page_id", "html", least_bytes).select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"), "_first", "_revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for b in batches:
            out = []
            for page, url, payload, first, revisit in zip(*(c for c in b.columns)):
                if bundle is None:
                    bundle = Bundle(folder, frame_bytes, level)
                i = page.as_py()
                data = record(i, url.as_py(), payload.as_py(), first.as_py(), revisit.as_py(), date)
                out.append((i, record_id(i), "revisit" if revisit.as_py() else "response", bundle.name, *bundle.add(data), len(data)))
                if bundle.size >= bundle_bytes:
                    bundle.close()
                    bundle = None
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=[c.split()[0] for c in INDEX.split(", ")])
        if bundle is not None:
            bundle.close()

    return pinned(map_batches(rows, run, INDEX).withColumn("folder", F.lit(folder)))


FRAMES = "bundle string, frame int, offset long, packed long, plain long"


def frames_of(index: DataFrame) -> DataFrame:
    """The seek tables of the bundles that the index names, one row per frame: folder, bundle, frame, offset, packed, plain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for folder, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = filesystem(folder)
                with fs.open_input_file(f"{path}/{name}") as f:
                    out += [(folder, name, i, *spot) for i, spot in enumerate(seek_table(f))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], names=["folder", "bundle", "frame", "offset", "packed", "plain"])

    return map_batches(index.select("folder", "bundle").distinct(), run, "folder string, " + FRAMES)


RECORD = "page_id long, record_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _records(frames: DataFrame, with_payload: bool, spots: bool) -> DataFrame:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, path = filesystem(row["folder"])
                with fs.open_input_file(f"{path}/{row['bundle']}") as f:
                    data = frame_at(f, row["offset"], row["packed"], row["plain"])
                out, at = [], 0
                todo = sorted(row["spots"]) if spots else None
                while (at < len(data)) if todo is None else todo:
                    fields, http, payload, at = parse(data, at if todo is None else todo.pop(0))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    ident, size = fields["WARC-Record-ID"][1:-1], int(http["Content-Length"])
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"payload of {ident} is broken")
                    first = page_of(fields["WARC-Refers-To"][1:-1]) if kind == "revisit" else None
                    out.append((page_of(ident), ident, kind, fields["WARC-Target-URI"], payload if with_payload and kind == "response" else None, size, digest, first))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names=[c.split()[0] for c in RECORD.split(", ")])

    return map_batches(frames, run, RECORD)


def read_archive(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archive, read back from its bundles: page_id, record_id, record_type, url, payload (of responses), payload_bytes,
    payload_digest, refers_to. Length and digest of every response are checked against its payload; broken records are errors.
    """
    frames = pinned(frames_of(index))
    tasks = max(1, min(-(-frames.count() // 8), 100_000))
    return _records(frames.repartition(tasks, "bundle", "frame"), with_payload, False)


def read_records(index: DataFrame, wanted: Column) -> DataFrame:
    """The records that the index rows meeting `wanted` point at; only their frames are fetched, and only they are parsed."""
    spots = index.filter(wanted).groupBy("folder", "bundle", "frame").agg(F.collect_list("at").alias("spots"))  # as many as a frame holds records
    f = frames_of(index.filter(wanted))
    return _records(f.join(spots, ["folder", "bundle", "frame"]), True, True)


def page_roles(pages: DataFrame, **settings) -> DataFrame:
    """Write the archive of `pages` and report what is read back from it: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write_archive(pages, **settings)
    return read_archive(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
