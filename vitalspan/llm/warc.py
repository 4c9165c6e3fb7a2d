"""Web archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, a bundle is a run of frames and ends with the seek table of the
seekable format (a skippable frame), and an index maps each record to its bundle, frame and place in that frame. Equal
payloads are stored once: the record of the smallest id is a response, the others revisit it.

An archive is a table with a row a bundle, so that Spark's writers commit it and any store can hold it; the ``content`` of a
row is a valid ``.warc.zst`` file by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.texts import sliced
from vitalspan.session import settle

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
# Fixed values of the seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"

ARCHIVE = ("bundle_id string, content binary, "
           "records array<struct<record_id:bigint,frame:int,position:bigint,length:bigint>>")
_RECORDS = pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("position", pa.int64()), ("length", pa.int64())]))
RECORD = {"record_id": "bigint", "url": "string", "record_type": "string", "refers_to": "bigint", "payload_bytes": "bigint",
          "payload_digest": "string", "payload": "binary"}


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(record_id: int | None) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}>"


def _number(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def record_bytes(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit whose HTTP header still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(record_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and where the next one starts; a response whose payload does not fit its digest is an error."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}: {lines[0][:40]!r}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, length = end + 4, int(head["Content-Length"])
    block = raw[start : start + length]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    n_bytes = int(re.search(rb"Content-Length: (\d+)", http)[1])
    response = head["WARC-Type"] == "response"
    if response and (len(payload) != n_bytes or payload_digest(payload) != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not fit its digest")
    return {
        "record_id": _number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
        "refers_to": _number(head.get("WARC-Refers-To")), "payload_bytes": n_bytes, "payload_digest": digest,
        "payload": payload if response else None}, start + length + 4


class _Bundle:
    """A bundle in the making."""

    def __init__(self, bundle_id: str):
        self.bundle_id, self.frames, self.table, self.records = bundle_id, [], [], []
        self.open, self.size = bytearray(), 0
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, record_id: int | None, raw: bytes) -> None:
        if self.open and len(self.open) + len(raw) > FRAME_BYTES:
            self.close_frame()
        self.records.append({"record_id": record_id, "frame": len(self.frames), "position": len(self.open), "length": len(raw)})
        self.open += raw

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(bytes(self.open))
            self.table.append((len(packed), len(self.open)))
            self.frames.append(packed)
            self.size += len(packed)
            self.open = bytearray()

    def finish(self) -> pa.RecordBatch:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        seek = struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer
        return pa.RecordBatch.from_arrays(
            [pa.array([self.bundle_id]), pa.array([b"".join([*self.frames, seek])], pa.binary()), pa.array([self.records], _RECORDS)],
            ["bundle_id", "content", "records"])


def seek_table(content: bytes) -> list[tuple[int, int]]:
    """Start and compressed length of each frame, read from the footer."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    table, at = [], 0
    for i in range(n):
        packed, _ = struct.unpack_from("<II", content, len(content) - 9 - width * (n - i))
        table.append((at, packed))
        at += packed
    return table


def read_frame(content: bytes, start: int, length: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(content[start : start + length])


def _bundled(date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        bundle = _Bundle(f"{part:06d}-{made:06d}")
        for batch in sliced(batches, "payload"):
            for record_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                bundle.add(record_id, record_bytes(record_id, url, payload, refers_to, date))
                if bundle.size >= BUNDLE_BYTES:
                    yield bundle.finish()
                    made += 1
                    bundle = _Bundle(f"{part:06d}-{made:06d}")
        if bundle.records:
            yield bundle.finish()

    return run


def write_archive(pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
                  date: str = DATE) -> DataFrame:
    """Writes one record a row and returns the archive, a table of bundles (``ARCHIVE``) in the shared folder.

    Of the rows with equal payloads of at least ``least_bytes`` the one of the smallest id is a response and the others
    revisit it; rows that repeat that id are responses too. A null payload is an empty one; a null id is larger than all
    others and a null url has no target; an empty table gives an archive without bundles; other columns are not used. The
    smallest ids are found by an aggregation of digests, and rows meet them in a join whose large keys Spark can split.
    """
    rows = pages.select(
        F.col(record_id).cast("long").alias("_id"), F.col(url).cast("string").alias("_url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.octet_length("payload") >= least_bytes).groupBy("_digest").agg(F.min("_id").alias("_first"))
    firsts = firsts.select(F.col("_digest").alias("_of"), "_first")
    joined = rows.join(firsts, F.col("_digest") == F.col("_of"), "left")
    placed = joined.select("_id", "_url", "payload", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_refers"))
    return settle(placed.mapInArrow(_bundled(date), ARCHIVE), compression="uncompressed")


def read_archive(archive: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of an archive: ``RECORD``, without the payload if ``payloads`` is false; it is checked in any case."""
    names = [n for n in RECORD if payloads or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                for start, length in seek_table(raw):
                    yield _as_batch(_records(read_frame(raw, start, length)), names)

    return archive.select("content").mapInArrow(run, ", ".join(f"{n} {RECORD[n]}" for n in names))


def _records(frame: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(frame):
        record, at = parse_record(frame, at)
        out.append(record)
    return out


def _as_batch(records: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], kinds[RECORD[n]]) for n in names], names)


def index(archive: DataFrame) -> DataFrame:
    """Where each record lies: (record_id, bundle_id, frame, position, length); positions count in the unpacked frame."""
    return archive.select("bundle_id", F.explode("records").alias("r")).select("r.record_id", "bundle_id", "r.frame", "r.position", "r.length")


def fetch(archive: DataFrame, ids: DataFrame) -> DataFrame:
    """The records (``RECORD``) whose ids ``ids`` has in its first column; only the frames that hold them are unpacked.

    Wanted places are grouped by bundle, which bounds a group by the records of a bundle.
    """
    wanted = ids.select(F.col(ids.columns[0]).cast("long").alias("_want")).distinct()
    places = index(archive).join(wanted, F.col("record_id") == F.col("_want"), "left_semi")
    by_bundle = places.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("frame", "position", "length"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column("content"), batch.column("places"), strict=True):
                raw, found, unpacked = content.as_py(), [], {}
                table = seek_table(raw)
                for place in places.as_py():
                    if place["frame"] not in unpacked:
                        unpacked = {place["frame"]: read_frame(raw, *table[place["frame"]])}
                    found.append(parse_record(unpacked[place["frame"]], place["position"])[0])
                yield _as_batch(found, list(RECORD))

    joined = archive.select("bundle_id", "content").join(by_bundle, "bundle_id")
    return joined.select("content", "places").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in RECORD.items()))
