"""Substring duplicates: windows of words that the corpus had before.

The corpus is indexed in blocks: a block holds the windows of ``size`` words whose anchor (the smallest hash of their
shorter word sequences) falls into its range, so equal windows of all documents meet in one block. There, runs of
neighbouring windows that occur at an earlier place become factors. Windows are equal when two 64-bit hashes are; a
factor has no one source, so this is not a relative parsing with longest matches. A factor of one window already has
``size`` words; factors of neighbouring blocks touch, and their union is the document's removed words. Before words are
removed, the hash at each factor's boundary is compared with the text it is applied to.

Tasks reduce first: a window that occurs earlier in the same slice of documents is decided there, and only the first
occurrence of a slice is sent. What is sent is a few binary rows a slice and block, not a row a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.texts import Words, mix, sliced, split_words, sums, window_hashes, window_positions, word_hashes

SIZE = 20
ANCHOR_WORDS = 8
#: Characters of text a reference block is made for, which bounds what a task holds.
BLOCK_CHARS = 8_000_000
_RUN = np.dtype([("anchor", "<u8"), ("id", "<i8"), ("start", "<u4"), ("count", "<u4")])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbouring values."""
    reach, out = 1, values
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


def _windows(hashes: np.ndarray, starts: np.ndarray, size: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, hashes and anchors of all windows."""
    at = window_positions(starts, size)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    shorter = mix(window_hashes(hashes, anchor_words) ^ np.uint64(0x5851F42D4C957F2D))
    return at, window_hashes(hashes, size)[at], _sliding_min(shorter, size - anchor_words + 1)[at]


def _repeats(hashes: np.ndarray, anchors: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each window also occurs at an earlier place (smaller id, or the same id and an earlier start)."""
    out = np.zeros(len(hashes), dtype=bool)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    often = np.zeros(len(hashes), dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    some = np.flatnonzero(often)
    if not len(some):
        return out
    some = some[np.lexsort((starts[some], ids[some], anchors[some], hashes[some]))]
    fresh = np.ones(len(some), dtype=bool)
    fresh[1:] = (hashes[some[1:]] != hashes[some[:-1]]) | (anchors[some[1:]] != anchors[some[:-1]])
    first = some[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    out[some] = (ids[some] != ids[first]) | (starts[some] != starts[first])
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs begin: neighbouring entries that agree in all keys, the last of which counts up, are one run."""
    n = len(keys[0])
    fresh = np.ones(n, dtype=bool)
    if n > 1:
        fresh[1:] = keys[-1][1:] != keys[-1][:-1] + 1
        for k in keys[:-1]:
            fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def _factors(ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> bytes:
    """Maximal runs of windows as packed rows: id, first window, number of windows, the first one's hash."""
    begin = _runs(ids, starts)
    return np.stack([ids[begin], starts[begin], np.diff(np.append(begin, len(ids))), hashes[begin].view(np.int64)]).astype("<i8").tobytes()


def _emit(size: int, anchor_words: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches, "_text"):
            words = split_words(batch.column("_text"))
            at, hashes, anchors = _windows(word_hashes(words), words.starts, size, anchor_words)
            if not len(at):
                continue
            row = words.rows[at]
            ids = batch.column("_id").to_numpy(zero_copy_only=False)[row]
            start = at - words.starts[row]
            known = _repeats(hashes, anchors, ids, start)
            out: list[tuple[int, bytes, bytes]] = []
            if known.any():
                out.append((int(hashes[0] % np.uint64(blocks)), b"", packer.compress(_factors(ids[known], start[known], hashes[known]))))
            ids, start, hashes, anchors = (x[~known] for x in (ids, start, hashes, anchors))
            begin = _runs(anchors, ids, start)
            runs = np.empty(len(begin), dtype=_RUN)
            runs["anchor"], runs["id"], runs["start"] = anchors[begin], ids[begin], start[begin]
            runs["count"] = np.diff(np.append(begin, len(ids)))
            block = (anchors[begin] >> np.uint64(20)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                counts = runs["count"][own].astype(np.int64)
                place = np.arange(counts.sum()) + np.repeat(begin[own] - np.cumsum(counts) + counts, counts)
                columns = b"".join(runs[own][c].tobytes() for c in _RUN.names)
                out.append((int(block[own[0]]), packer.compress(columns), hashes[place].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()),
                 pa.array([o[2] for o in out], pa.binary())], ["block", "runs", "windows"])

    return run


def _factor_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of all documents relative to the block of a partition; messages without runs hold what a slice has found itself."""
    messages = pa.Table.from_batches(list(batches), pa.schema([("block", pa.int64()), ("runs", pa.binary()), ("windows", pa.binary())]))
    if not messages.num_rows:
        return
    unpacker = zstandard.ZstdDecompressor()
    found: list[np.ndarray] = []
    runs, hashes = [], []
    for packed, windows in zip(messages.column("runs").to_pylist(), messages.column("windows").to_pylist(), strict=True):
        if not packed:
            found.append(np.frombuffer(unpacker.decompress(windows), "<i8").reshape(4, -1))
            continue
        raw = unpacker.decompress(packed)
        own = np.empty(len(raw) // _RUN.itemsize, dtype=_RUN)
        at = 0
        for name in _RUN.names:
            kind = _RUN[name]
            own[name] = np.frombuffer(raw, kind, len(own), at)
            at += kind.itemsize * len(own)
        runs.append(own)
        hashes.append(np.frombuffer(windows, "<u8"))
    if runs:
        whole, hashed = np.concatenate(runs), np.concatenate(hashes)
        counts = whole["count"].astype(np.int64)
        ids, anchors = np.repeat(whole["id"], counts), np.repeat(whole["anchor"], counts)
        starts = np.arange(counts.sum()) + np.repeat(whole["start"] - np.cumsum(counts) + counts, counts)
        known = _repeats(hashed, anchors, ids, starts)
        found.append(np.frombuffer(_factors(ids[known], starts[known], hashed[known]), "<i8").reshape(4, -1))
    rows = np.concatenate(found, axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["id", "start", "count", "check"])


def factors(docs: DataFrame, size: int = SIZE, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Factors of ``docs`` (_id, _text) that occur at an earlier place: (id, start, count, check).

    A factor is ``count`` neighbouring windows from the word ``start`` on; ``check`` is the hash of the first one.
    """
    chars = docs.agg(F.sum(F.length("_text"))).collect()[0][0] or 0
    blocks = max(64, chars // BLOCK_CHARS)
    sent = docs.select("_id", "_text").mapInArrow(_emit(size, anchor_words, blocks), "block bigint, runs binary, windows binary")
    one_each = sent.repartitionById(blocks, F.col("block").cast("int"))
    return one_each.mapInArrow(_factor_block, "id bigint, start bigint, count bigint, check bigint")


def _remove(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            words = split_words(batch.column("_text"))
            removed = _covered(words, batch.column("_factors"), size)
            kept = np.flatnonzero(~removed)
            gone = sums(removed, words.starts)
            offsets = np.concatenate([[0], np.cumsum(np.diff(words.starts) - gone)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.vocabulary.take(pa.array(words.codes[kept])))
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("_text", "_factors")]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in rest] + [pa.array(np.diff(words.starts), pa.int64()), pa.array(gone, pa.int64()), pc.binary_join(lists, " ")],
                [n for n, _ in rest] + ["n_words", "n_removed", "kept"])

    return run


def _covered(words: Words, found: pa.Array, size: int) -> np.ndarray:
    """The words that the rows' factors cover; a factor whose hash is not that of its place belongs to another row of the id."""
    edge = np.zeros(len(words.codes) + 1, dtype=np.int64)
    lists = pc.list_value_length(pc.fill_null(found, [])).to_numpy(zero_copy_only=False).astype(np.int64)
    if lists.sum():
        flat = pc.list_flatten(found)
        start, count, check = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "count", "check"))
        row = np.repeat(np.arange(len(lists)), lists)
        fits = start + count + size - 1 <= np.diff(words.starts)[row]
        begin = (words.starts[row] + start)[fits]
        own = window_hashes(word_hashes(words), size)
        true = own[begin].view(np.int64) == check[fits] if len(own) else np.zeros(0, bool)
        np.add.at(edge, begin[true], 1)
        np.add.at(edge, begin[true] + count[fits][true] + size - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carried: list[str] | None = None, size: int = SIZE,
                   anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """The carried columns (default: all but the text) with ``n_words``, ``n_removed`` and ``kept``, the text that is left.

    A word goes if it lies in a window of ``size`` words that also starts earlier: in a document of a smaller id, or in the
    same one. Windows are those of the input. Kept words are unchanged and joined by one space. Rows of one id are one
    document for this order, so rows that repeat each other keep the same words. Null ids come before all others; null and
    empty texts have no words; an empty table gives an empty one; a column that has the name of an added one gives way.
    """
    carried = [c for c in (docs.columns if carried is None else carried) if c not in (text, "n_words", "n_removed", "kept") and c[:1] != "_"]
    lowest = F.lit(-(2**63)).cast("long")
    source = docs.select(*carried, F.coalesce(F.col(doc_id).cast("long"), lowest).alias("_id"), F.col(text).cast("string").alias("_text"))
    found = factors(source, size, anchor_words)
    by_doc = found.groupBy(F.col("id").alias("_of")).agg(F.collect_set(F.struct("start", "count", "check")).alias("_factors"))
    joined = source.join(by_doc, F.col("_id") == F.col("_of"), "left").select(*carried, "_text", "_factors")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name not in ("_text", "_id")]
    return joined.mapInArrow(_remove(size), ", ".join([*types, "n_words bigint, n_removed bigint, kept string"]))
