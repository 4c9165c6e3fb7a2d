"""Packing by concatenate and cut: two passes of prefix sums place each document, fixed windows cut the stream.

The first pass tokenizes each partition and writes the ids with each document's place inside its partition. The totals
of the partitions, summed in order, give each partition its place in the stream. The second pass is a projection: a
document's global place tells which windows it falls into. Documents that cross a window's edge leave boundary records.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.llm.texts import sliced, split_words
from vitalspan.session import settle

WINDOW = 4096
END_ID = 2
#: Text that is encoded together; more of it has fewer different words a byte.
SLICE_BYTES = 8 << 20
#: Words whose ids a worker remembers; the memory starts anew when it is full.
REMEMBERED_WORDS = 500_000
#: Latin letters, whose small forms all Unicode versions agree on, and ASCII punctuation.
LETTERS_THEN_MARKS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of words, remembered.

    Right for tokenizers that put texts in lower case, drop white space and merge letters, digits and other characters
    apart: the ids of a text are then those of its words in order.
    """

    def __init__(self, specification: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(specification)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 20, dtype=np.uint32), 0
        self.begins, self.lengths = np.empty(1 << 16, dtype=np.int64), np.empty(1 << 16, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        ids = np.fromiter(chain.from_iterable(coded), dtype=np.uint32, count=int(lengths.sum()))
        slot, end = len(self.slots), self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), end))
        if slot + len(words) > len(self.begins):
            room = max(2 * len(self.begins), slot + len(words))
            self.begins, self.lengths = np.resize(self.begins, room), np.resize(self.lengths, room)
        self.ids[self.used : end] = ids
        self.begins[slot : slot + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[slot : slot + len(words)] = lengths
        self.used = end
        self.slots.update(zip(words, range(slot, slot + len(words)), strict=True))

    def _slots(self, words: pa.Array) -> np.ndarray:
        """The slot of each word."""
        coded = words.dictionary_encode()
        spelled = coded.dictionary.to_pylist()
        found = list(map(self.slots.get, spelled))
        unknown = [i for i, slot in enumerate(found) if slot is None]
        if unknown:
            self._learn([spelled[i] for i in unknown])
            for i in unknown:
                found[i] = self.slots[spelled[i]]
        return np.array(found, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and where each text's ids start.

        Words of letters with punctuation behind them are looked up as two words, since the tokenizer parts them there.
        """
        words = split_words(texts)
        if len(self.slots) > REMEMBERED_WORDS:
            self.forget()
        parted = pc.extract_regex(words.vocabulary, LETTERS_THEN_MARKS)
        letters, marks = pc.struct_field(parted, "letters"), pc.struct_field(parted, "marks")
        fronts = self._slots(pc.coalesce(pc.utf8_lower(letters), words.vocabulary))
        backs = self._slots(pc.fill_null(marks, ""))
        both = np.stack([fronts, backs], axis=1).ravel()
        spelled = self.ids[spread(self.begins[both], self.lengths[both])]  # of the vocabulary, word after word
        sizes = self.lengths[fronts] + self.lengths[backs]
        begins = np.cumsum(sizes) - sizes
        lengths = sizes[words.codes]
        at = np.concatenate([[0], np.cumsum(lengths)])
        starts = at[words.starts] + np.arange(len(texts) + 1)
        out = np.full(int(starts[-1]), end_id, dtype=np.uint32)
        own = np.ones(len(out), dtype=bool)
        own[starts[1:] - 1] = False
        out[own] = spelled[spread(begins[words.codes], lengths)]
        return out, starts


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of ranges, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(begins - before, lengths)


def encoder(specification: Broadcast) -> WordEncoder:
    key = hashlib.sha256(specification.value.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(specification.value)
    return _ENCODERS[key]


def _tokenize(specification: Broadcast, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, before = encoder(specification), TaskContext.get().partitionId(), 0
        for batch in sliced(batches, "_text", SLICE_BYTES):
            ids, starts = known.encode(batch.column("_text"), end_id)
            small = not len(ids) or int(ids.max()) < 1 << 16
            ids = ids.astype("<u2") if small else ids.astype("<u4")
            ends = (starts * ids.itemsize).tolist()
            raw = ids.tobytes()
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [c for _, c in rest] + [
                    pa.array(np.full(n, part), pa.int64()), pa.array(before + starts[:-1], pa.int64()),
                    pa.array(np.diff(starts), pa.int64()), pa.array(np.full(n, ids.itemsize), pa.int32()),
                    pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())],
                [n for n, _ in rest] + ["_part", "_before", "_tokens", "_width", "_ids"])
            before += int(starts[-1])

    return run


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_ids"):
            at = batch.column("_at").to_numpy(zero_copy_only=False)
            tokens = batch.column("_tokens").to_numpy(zero_copy_only=False)
            first = at // window
            pieces = (at + tokens - 1) // window - first + 1
            doc = np.repeat(np.arange(len(at)), pieces)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(sequence * window - at[doc], 0)
            end = np.minimum((sequence + 1) * window - at[doc], tokens[doc])
            raw, width = batch.column("_ids").to_pylist(), batch.column("_width").to_pylist()
            wide = [np.frombuffer(r, dtype=f"<u{w}").astype("<u4") for r, w in zip(raw, width, strict=True)]
            ids = [wide[d][a:b].tobytes() for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)]
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if not n.startswith("_")]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [c.take(take) for _, c in rest] + [
                    pa.array(start, pa.int64()), pa.array(end - start, pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(tokens[doc], pa.int64()), pa.array(sequence, pa.int64()),
                    pa.array(at[doc] + start - sequence * window, pa.int64()),
                    pa.array(start > 0, pa.bool_()), pa.array(end < tokens[doc], pa.bool_())],
                [n for n, _ in rest] + list(PIECE))

    return run


PIECE = {"start": "bigint", "length": "bigint", "ids": "binary", "doc_tokens": "bigint", "sequence_id": "bigint",
         "offset": "bigint", "continues": "boolean", "continued": "boolean"}


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", carried: list[str] | None = None, window: int = WINDOW,
         end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens: the carried columns (default: all but the text) and ``PIECE``.

    ``ids`` are little-endian unsigned 32-bit integers. ``continues`` and ``continued`` mark the boundary records: pieces
    whose document began in the sequence before, or goes on in the next one. Only the last sequence can be short. Null and
    empty texts have the end id alone; repeated rows are packed each; an empty table gives no pieces. A carried column
    that has the name of an added one gives way to it; one whose name starts with an underscore is not carried.

    The stream has the documents in the order of the partitions that read them, so nothing is sorted or shuffled; which
    place a document gets is fixed when the first pass is written.
    """
    spark = docs.sparkSession
    with open(tokenizer_path) as f:
        specification = spark.sparkContext.broadcast(f.read())
    carried = [c for c in (docs.columns if carried is None else carried) if c != text and c not in PIECE and c[:1] != "_"]
    source = docs.select(*carried, F.col(text).cast("string").alias("_text"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text"]
    added = ["_part bigint", "_before bigint", "_tokens bigint", "_width int", "_ids binary"]
    tokens = settle(source.mapInArrow(_tokenize(specification, end_id), ", ".join(types + added)), compression="zstd")
    totals = tokens.groupBy("_part").agg(F.sum("_tokens").alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row of two integers for each task of the first pass, so a window over all of them and a broadcast are small.
    bases = settle(totals.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base")))
    placed = tokens.join(F.broadcast(bases), F.col("_part") == F.col("_of")).select(
        *carried, (F.col("_base") + F.col("_before")).alias("_at"), "_tokens", "_width", "_ids")
    return placed.mapInArrow(_cut(window), ", ".join(types + [f"{k} {v}" for k, v in PIECE.items()]))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The sequences of ``pack``: (sequence_id, n_tokens, ids), padded to the window unless they end at a power of two.

    A group is one sequence and has at most ``window`` pieces.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    n = F.col("n_tokens")
    power = n.bitwiseAND(n - 1) == 0
    one = F.lit(pad_id.to_bytes(4, "little"))
    padding = F.aggregate(F.array_repeat(one, F.when(power, 0).otherwise(window - n).cast("int")), F.lit(b""), lambda a, b: F.concat(a, b))
    return whole.select("sequence_id", "n_tokens", F.concat(joined, padding).alias("ids"))
