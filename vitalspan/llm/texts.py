"""Words, lines and hashes of whole texts, vectorised over Arrow batches inside Spark tasks.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of a column of texts: row i has ``codes[starts[i]:starts[i + 1]]``, indices into ``vocabulary``."""

    starts: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice has at most ``limit`` bytes of ``column``, or one row: this bounds a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(texts, "")


def _lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row starts and values of a list column without empty values."""
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        offsets, values = kept[offsets], values.filter(pa.array(full))
    return offsets, values


def split_words(texts: pa.Array) -> Words:
    """The words of each text; null texts have none."""
    starts, values = _lists(pc.ascii_split_whitespace(filled(texts)))
    coded = values.dictionary_encode()
    return Words(starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def split_lines(texts: pa.Array) -> Words:
    """The non-empty lines of each text, cut at line feeds."""
    starts, values = _lists(pc.split_pattern(filled(texts), "\n"))
    coded = values.dictionary_encode()
    return Words(starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    spelled = words.vocabulary.to_pylist()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in spelled), dtype=np.uint64, count=len(spelled))
    return own[words.codes]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` values from each position on, in order; windows may run over into the next row."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    last = len(hashes) - size + 1
    out = mix(hashes[:last])
    for i in range(1, size):
        out = out * _MULTIPLIER + hashes[i : last + i]
        if i % 4 == 0 or i == size - 1:
            out = mix(out)
    return out


def window_positions(starts: np.ndarray, size: int) -> np.ndarray:
    """First words of the windows of ``size`` words that lie within one row."""
    counts = np.maximum(np.diff(starts) - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(first[-1]) - np.repeat(first[:-1] - starts[:-1], counts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of ``values`` in each row."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]
