"""Archives read back, seek tables, and records fetched by id."""

from __future__ import annotations

import base64
import hashlib

import pytest
import zstandard

from vitalspan.llm import warc

SCHEMA = "page_id bigint, url string, html string"
ROWS = [(5, "http://a/x y\n", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (9, None, None), (8, "u", ""), (4, "http://c", "x" * 900_000),
        (7, "http://d", "\r\n\r\nWARC/1.1\r\n\r\n"), (5, "http://a/x y\n", "<p>é</p>"), (None, "n", "<p>é</p>"), (1, "o", "only")]


def _want(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = first[h or ""] if len(raw) >= least and first[h or ""] != i else None
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 5, 100])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = warc.read_archive(warc.write_archive(pages, least_bytes=least)).collect()
    assert sorted(repr((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == _want(ROWS, least)
    texts = {i: (h or "").encode() for i, _, h in ROWS}
    for r in rows:
        assert (r.payload is None) == (r.record_type == "revisit") and r.payload in (None, texts[r.record_id])
    assert {r.url for r in rows if r.record_id == 5} == {"http://a/x%20y%0A"} and {r.url for r in rows if r.record_id == 9} == {None}


def test_bundles_are_seekable_and_whole(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 6000) for i in range(60)], SCHEMA).coalesce(1)
    archive = warc.write_archive(pages)
    for r in archive.collect():
        table = warc.seek_table(bytes(r.content))
        assert len(table) > 3
        frames = [warc.read_frame(bytes(r.content), *f) for f in table]
        with zstandard.ZstdDecompressor().stream_reader(bytes(r.content), read_across_frames=True) as whole:
            assert whole.read() == b"".join(frames)  # any reader passes over the seek table
        for record in r.records:
            raw = frames[record.frame][record.position : record.position + record.length]
            assert warc.parse_record(raw)[0]["record_id"] == record.record_id
    wanted = spark.createDataFrame([(3,), (44,), (44,), (1000,)], "i int")
    assert {(r.record_id, bytes(r.payload).decode()) for r in warc.fetch(archive, wanted).collect()} == {
        (i, f"page {i} " * 6000) for i in (3, 44)}
    assert warc.index(archive).count() == 60


def test_empty_table_and_damage(spark):
    assert warc.read_archive(warc.write_archive(spark.createDataFrame([], SCHEMA))).count() == 0
    raw = warc.record_bytes(1, "u", b"abc", None, warc.DATE)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw.replace(b"abc", b"abd"))
    clash = spark.createDataFrame([(1, "u", "h", "x", 2)], SCHEMA + ", payload string, record_id int")
    assert warc.read_archive(warc.write_archive(clash)).collect()[0].payload == b"h"
