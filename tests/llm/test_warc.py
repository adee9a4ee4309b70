"""WARC bundles: exact round trips, the seek table, roles of equal payloads."""

import base64
import hashlib
import io
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from pulseframe.llm import warc

PAGES = "page_id long, url string, html string, _key string, folder string, record_type int"


def pages_of(spark, rows):
    """Rows (id, url, html) with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "k", "f", 3) for r in rows], PAGES)


ROWS = [
    (1, "http://a/1", "<p>eins</p>"), (2, "http://a/2", "<p>zwei é \U0001f600</p>"), (3, "http://a/3", "<p>eins</p>"), (9, "http://a/9", "<p>eins</p>"), (4, None, None), (5, "http://a/5\r\nX-Bad: 1", ""),
    (6, "http://a/6", "a\r\n\r\nWARC/1.1\r\n\r\n"), (7, "", "x" * 300_000), (8, "http://a/8", "x" * 300_000), (None, "http://a/n", "<p>eins</p>"), (None, None, "alone"), (1, "http://a/1", "<p>eins</p>"), (3, "other", "third"),
]


def roles_by_hand(rows, least=0):
    out = []
    for i, _, t in rows:
        p = (t or "").encode()
        same = [j for j, _, u in rows if (u or "").encode() == p and j is not None]
        first = min(same, default=None)
        revisit = len(p) >= least and first is not None and first != i
        out.append((i or -1, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_roles_by_hand(spark, least):
    got = warc.page_roles(pages_of(spark, ROWS), least_bytes=least, frame_bytes=2000)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(((r.page_id or -1, *r[1:]) for r in got.collect()), key=str) == roles_by_hand(ROWS, least)


def test_frequent_payloads_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 7)
    rows = [(i, "u", "same" if i % 2 else f"text {i // 4}") for i in range(200)]
    got = warc.roles(pages_of(spark, rows).select("page_id", "html"), "page_id", "html", 0, small=0)
    assert {r.page_id: r._first for r in got.collect()} == {i: None if (first := min(j for j, _, u in rows if u == t)) == i else first for i, _, t in rows}


def test_round_trip_and_random_access(spark, tmp_path):
    index = warc.write_archive(pages_of(spark, ROWS).repartition(3), str(tmp_path / "w"), frame_bytes=1500, bundle_bytes=600)
    back = warc.read_archive(index).collect()
    assert len(back) == len(ROWS)
    texts = {(i, t or "") for i, _, t in ROWS}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in back if r.record_type == "response")
    assert {r.url for r in back if r.page_id == 5} == {"http://a/5%0D%0AX-Bad:%201"} and {r.url for r in back if r.page_id == 4} == {"urn:page:4"}
    some = warc.read_records(index, F.col("page_id").isin(2, 6, 7)).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in some) == sorted((i, t) for i, _, t in ROWS if i in (2, 6, 7))
    assert index.select("bundle").distinct().count() > 3
    # A plain Zstandard reader sees one WARC per bundle, with the records where the index says.
    for (name,) in index.select("bundle").distinct().collect():
        data = (tmp_path / "w" / name).read_bytes()
        table = warc.seek_table(_Sized(data))
        plain = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + n], max_output_size=size) for a, n, size in table)
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == plain
        begin = [sum(size for _, _, size in table[:i]) for i in range(len(table))]
        for r in index.filter(F.col("bundle") == name).collect():
            piece = plain[begin[r.frame] + r["at"] :][: r.length]
            assert piece.startswith(b"WARC/1.1\r\n") and f"<{r.record_id}>".encode() in piece and piece.endswith(b"\r\n\r\n")


class _Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_lost_attempts_are_not_read(spark, tmp_path):
    folder = tmp_path / "w"
    index = warc.write_archive(pages_of(spark, ROWS[:3]), str(folder))
    for f in list(folder.glob("*.zst")):
        (folder / f"{'0' * 32}.warc.zst").write_bytes(f.read_bytes()[:40])
    assert warc.read_archive(index).count() == 3


def test_broken_bundles_are_errors(spark, tmp_path):
    index = warc.write_archive(pages_of(spark, ROWS[:2]).coalesce(1), str(tmp_path / "w"))
    (name,) = {Path(f).name for f in map(str, (tmp_path / "w").glob("*.zst"))}
    data = bytearray((tmp_path / "w" / name).read_bytes())
    data[20] ^= 1
    (tmp_path / "w" / name).write_bytes(data)
    with pytest.raises(Exception):
        warc.read_archive(index).count()
    one = warc.record(5, "u", b"abc", None, False, "d")
    with pytest.raises(ValueError):
        warc.parse(one.replace(b"abc", b"abd"))
    assert warc.parse(b"junk" + one, 4)[2:] == (b"abc", 4 + len(one))


def test_no_pages(spark):
    index = warc.write_archive(pages_of(spark, []))
    assert index.count() == 0 and warc.read_archive(index).count() == 0
