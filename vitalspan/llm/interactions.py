"""How filters interact: what each removes, in every order of them, counted with one wide packed integer a part.

A document is described by the set of filters it fails, a mask, and by its two labels. Each such kind maps to one big
integer whose 64-bit fields hold all outcomes of all steps of all orders; the integers of a part's documents are summed and
the sum is unpacked. A field adds up to the number of the part's documents at most, a long, so no field can run over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.texts import filled, sliced, split_words
from vitalspan.session import settle

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 2
MARKS = "#$%&*|"
FIELD_BITS = 64
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(len(FILTERS))]
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, " \
    "good_lost bigint, toxic_lost bigint, shapley bigint"


def _bytes_among(texts: pa.Array, wanted: bytes) -> np.ndarray:
    """How many bytes of each text are among ``wanted``."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    table = np.zeros(256, dtype=bool)
    table[list(wanted)] = True
    total = np.concatenate([[0], np.cumsum(table[raw])])
    return total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]]


def text_mask(texts: pa.Array) -> np.ndarray:
    """The bits of filters A to D that each whole text fails; null texts are empty."""
    texts = filled(texts)
    words = split_words(texts)
    n = np.diff(words.starts)
    distinct = np.bincount(np.unique(words.rows * max(1, len(words.vocabulary)) + words.codes) // max(1, len(words.vocabulary)), minlength=len(n))
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    fails = [
        n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n,
        100 * _bytes_among(texts, bytes(range(65, 91))) > MAX_CAPITALS_PERCENT * length, _bytes_among(texts, MARKS.encode()) > 0]
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "_text"):
        rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
        mask = pa.array(text_mask(batch.column("_text")), pa.int32())
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [mask], [n for n, _ in rest] + ["mask"])


def kinds(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> DataFrame:
    """How many documents of each part there are of each kind: (part, mask, good, toxic, n), at most 128 rows a part.

    Filter E fails a text that some smaller id has too. Equal texts are told by their SHA-256. Rows are put together by
    text, part and labels before they meet, so a text that a third of all rows have is a few rows by then.
    """
    own = docs.select(
        F.col(id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"),
        F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("_hash"), F.col(text).cast("string").alias("_text"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "_text"]
    masked = own.mapInArrow(_masked, ", ".join([*types, "mask int"]))
    known = labels.groupBy(F.col("doc_id").alias("_of")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_bad"))
    marked = masked.join(known, F.col("_id") == F.col("_of"), "left").select(
        "_id", "_part", "_hash", "mask", F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_bad", F.lit(False)).alias("toxic"))
    rows = marked.groupBy("_hash", "_part", "mask", "good", "toxic", "_id").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n")))
    unsure = F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0))  # without an id a text fails no comparison
    texts = settle(rows.groupBy("_hash", "_part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), unsure.alias("unsure")))
    first = texts.groupBy(F.col("_hash").alias("_same")).agg(F.min("least._id").alias("_first"))
    joined = texts.join(first, F.col("_hash") == F.col("_same"))
    not_later = F.col("unsure") + F.when(F.col("least._id") == F.col("_first"), F.col("least.n")).otherwise(0)
    bit = 1 << FILTERS.index("E")
    split = joined.select("_part", "good", "toxic", F.explode(F.array(
        F.struct("mask", not_later.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - not_later).alias("n")))).alias("k"))
    return split.groupBy(F.col("_part").alias("part"), F.col("k.mask").alias("mask"), "good", "toxic").agg(F.sum("k.n").alias("n")).where("n > 0")


@cache
def packed(mask: int, good: bool, toxic: bool) -> int:
    """One document's outcomes at all steps: field ``step * len(OUTCOMES) + outcome`` is 1 where it has that outcome."""
    whole = 0
    for at, (order, step) in enumerate(STEPS):
        fails = [mask >> FILTERS.index(f) & 1 for f in order[: step + 1]]
        gone, now = any(fails[:-1]), bool(fails[-1])
        removed = now and not gone
        outcome = (not gone and not now, removed, now and gone, removed and good, removed and toxic)
        for i, holds in enumerate(outcome):
            if holds:
                whole |= 1 << FIELD_BITS * (at * len(OUTCOMES) + i)
    return whole


def unpacked(whole: int) -> np.ndarray:
    """The fields of a sum of packed integers, one row a step."""
    raw = whole.to_bytes(FIELD_BITS // 8 * len(STEPS) * len(OUTCOMES), "little")
    return np.frombuffer(raw, dtype="<u8").astype(np.int64).reshape(len(STEPS), len(OUTCOMES))


def _unfold(group: pd.DataFrame) -> pd.DataFrame:
    """All steps of one part, from the at most 128 kinds of its documents."""
    whole, alone = 0, dict.fromkeys(FILTERS, 0)
    for mask, good, toxic, n in zip(group["mask"], group["good"], group["toxic"], group["n"], strict=True):
        whole += int(n) * packed(int(mask), bool(good), bool(toxic))
        if mask in (only := {1 << i: f for i, f in enumerate(FILTERS)}):
            alone[only[int(mask)]] += int(n)
    out = pd.DataFrame(unpacked(whole), columns=list(OUTCOMES))
    letter = pd.Series([order[step] for order, step in STEPS])
    return out.assign(
        part=group["part"].iloc[0], filter_order=[o for o, _ in STEPS], step=[s + 1 for _, s in STEPS],
        unique_fails=letter.map(alone), shapley=letter.map(out["removed"].groupby(letter).sum()))


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> DataFrame:
    """What five filters do to each part in each of their 120 orders: one row per part, order and step (``RESULT``).

    Failing conditions: A under 200 words; B fewer distinct words than half; C more than 2 % of the code points in A-Z;
    D any of ``#$%&*|``; E a text that a smaller id has as well. Counts: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (fails its filter, removed earlier), ``unique_fails`` (fails its filter alone), ``good_lost`` and
    ``toxic_lost`` (removed by it, labelled quality 1 or toxic 1 in any label row of the id), and ``shapley``: what its
    filter removes, summed over all orders.

    Null texts are empty, null parts are the empty part; a row without an id never fails E and makes no other fail;
    rows that repeat an id and its text count each and fail E together or not at all. An empty table gives no rows, and
    columns other than those named are not looked at.
    """
    return kinds(docs, labels, text, id, part).groupBy("part").applyInPandas(lambda g: _unfold(g)[[c.split()[0] for c in RESULT.split(", ")]], RESULT)
