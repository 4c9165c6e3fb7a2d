"""Language-model scores of whole texts: a causal self-attention model over piece ids, learned from the corpus on Spark.

Texts are read once into slices: their words as codes into the slice's vocabulary, and the piece ids of each word there, so
that a word is spelled and encoded once a slice. Slices hold all that follows: word counts, counts of ids, the training
rounds and the scoring. In a round each task trains its own copy of the model on its slices; tasks' models are averaged,
row by row of the tables by how often each task met the row, and their expected counts are summed. A slice is one row of
several MB: a task holds one at a time as it writes, reads and sends them, however many it has.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.llm.attention import MIXTURE, WIDTH, Learner, Model, Pass, cut, log_likelihoods, windows
from vitalspan.llm.texts import filled, mix, sliced, split_words
from vitalspan.session import arrow_batches, settle

#: Folds of documents: those with remainder 0 are not learned from.
FOLDS = 10
#: Added to the count of each word in the base score.
BASE_PRIOR = 0.1
#: The training windows are dealt over the rounds by a hash: each one is learned from, in one round.
ROUNDS = 2
#: Windows of a training step.
STEP_WINDOWS = 64
#: The weight of the corpus's id counts in each distribution of the mixture.
PRIOR = 20.0
#: Frequent ids that start as groups of their own; the others share the rest of the mixture.
OWN_GROUPS = MIXTURE - 8
#: Rows of the model's tables that travel together, and such blocks that a task makes ready at once.
ROWS, BLOCKS = 256, 32
SLICE_BYTES = 6 << 20
#: Documents that reach a worker at once; slices are put together from them.
BATCH_DOCS = 256

SLICE = "slice bigint, ids array<{}>, learn binary, starts binary, codes binary, lengths binary, pieces binary, words array<string>, counts array<bigint>"


@dataclass(frozen=True)
class Counts:
    """Word counts of the documents learned from: ``known`` has those of each slice's words in their order; all tokens,
    distinct tokens and ends of texts."""

    known: DataFrame
    tokens: int
    distinct: int
    ends: int


def is_held_out(id: Column) -> Column:
    """Whether a document is not learned from; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Speller:
    """Piece ids of words, each with a space before it: no two texts of words have the same ids."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.size = self.end + 1
        self.opens = np.zeros(self.size, dtype=bool)
        self.opens[[i for piece, i in table.items() if piece[:1] == b" "]] = True

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        spelled = words.to_pylist()
        if not spelled:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        ids = np.asarray(self.encoding.encode_to_numpy(" " + " ".join(spelled), disallowed_special=()), dtype=np.uint32)
        first = np.flatnonzero(self.opens[ids])
        if len(first) == len(spelled) and first[0] == 0:
            return ids, np.diff(first, append=len(ids))
        each = [self.encoding.encode_ordinary(" " + w) for w in spelled]  # white space other than blanks can run into the next word
        return np.array([i for e in each for i in e], dtype=np.uint32), np.array([len(e) for e in each], dtype=np.int64)


_SPELLERS: dict[int, Speller] = {}


def _speller(source: Broadcast) -> Speller:
    key = hash(source.value)
    if key not in _SPELLERS:
        _SPELLERS[key] = Speller(*source.value)
    return _SPELLERS[key]


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as their lowest bytes, then the next ones, and so on: most of the later bytes are 0."""
    return np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype="u1").reshape(4, -1).T).view("<u4").ravel()


def _gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, and cut, so that each has at most ``limit`` bytes of ``column``, or one row."""
    kept, size = [], 0
    for batch in sliced(batches, column, limit):
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if kept and size + own > limit:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, size = [], 0
        kept.append(batch)
        size += own
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _slice(source: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, number = _speller(source), TaskContext.get().partitionId() << 32
        for batch in _gathered(batches, "_text", SLICE_BYTES):
            words = split_words(pc.ascii_lower(filled(batch.column("_text"))))
            learn = ~batch.column("_held").to_numpy(zero_copy_only=False)
            often = np.argsort(-np.bincount(words.codes, minlength=len(words.vocabulary)), kind="stable")  # small codes for frequent words
            code = np.empty(len(often), dtype=np.int64)
            code[often] = np.arange(len(often))
            codes, vocabulary = code[words.codes], words.vocabulary.take(pa.array(often))
            counts = np.bincount(codes[learn[words.rows]], minlength=len(vocabulary))
            pieces, lengths = speller.spell(vocabulary)
            one = lambda x: pa.array([_planes(x)], pa.binary())
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), whole(batch.column("_id")), pa.array([learn.astype("u1").tobytes()], pa.binary()),
                 one(words.starts), one(codes), one(lengths), one(pieces), whole(vocabulary), whole(pa.array(counts, pa.int64()))],
                ["slice", "ids", "learn", "starts", "codes", "lengths", "pieces", "words", "counts"])
            number += 1

    return run


def slices(docs: DataFrame, pieces_path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """All documents in slices of about ``SLICE_BYTES`` of text, written to the shared folder."""
    with open(pieces_path) as f:
        source = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    own = docs.select(F.col(id).alias("_id"), is_held_out(F.col(id)).alias("_held"), F.col(text).cast("string").alias("_text"))
    cut_docs = own.mapInArrow(_slice(source), SLICE.format(own.schema["_id"].dataType.simpleString()))
    with arrow_batches(docs.sparkSession, BATCH_DOCS):
        return settle(cut_docs, compression="zstd", group_rows=1)


def _gather(group: pa.Table) -> pa.Table:
    """The counts of a slice's words, in the order of its vocabulary, and how many words are first met there."""
    order = np.argsort(group.column("at").to_numpy(), kind="stable")
    counts = group.column("c").to_numpy()[order].astype("<i8")
    first = int(pc.sum(group.column("first").cast(pa.int64())).as_py())
    return pa.table({"of": pa.array([group.column("of")[0].as_py()], pa.int64()), "known": pa.array([counts.tobytes()], pa.binary()),
                     "firsts": pa.array([first], pa.int64())})


def word_counts(cut_docs: DataFrame) -> Counts:
    """How often each word occurs in the documents learned from; an end of a text is a token too.

    A slice sends each of its words once, with its count, and gets the sum of all slices back.
    """
    words = cut_docs.select(F.col("slice").alias("of"), F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    same = Window.partitionBy("w.words")
    summed = words.select("of", "at", F.sum("w.counts").over(same).alias("c"), (F.min(F.struct("of")).over(same)["of"] == F.col("of")).alias("first"))
    summed = summed.withColumn("first", F.col("first") & (F.col("c") > 0))
    known = settle(summed.groupBy("of").applyInArrow(_gather, "of bigint, known binary, firsts bigint"), compression="zstd", group_rows=16)
    distinct = known.agg(F.coalesce(F.sum("firsts"), F.lit(0))).first()[0]
    each = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)
    ends = F.length(F.regexp_replace(F.hex("learn"), "00", "")) / 2
    total, n = cut_docs.agg(F.coalesce(F.sum(each), F.lit(0)), F.coalesce(F.sum(ends).cast("bigint"), F.lit(0))).first()
    return Counts(known, total + n, distinct + (n > 0), n)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of slices one by one, their numbers as they lie in the batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_buffer() if pa.types.is_binary(column.type) else column[i].values.to_numpy() if pa.types.is_list(column.type)
                   else column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


@dataclass(frozen=True)
class _Read:
    """A slice's texts as rows of the model's tables: position by position, the id before it and its own."""

    inputs: np.ndarray
    nexts: np.ndarray
    starts: np.ndarray
    learn: np.ndarray


def _read(row: dict, size: int, rows: np.ndarray | None) -> _Read:
    """The ids of a slice, an end id after each text and before the first; as table rows if they are known.

    Four bytes a number, since a slice has millions of positions.
    """
    lengths, codes = _numbers(row["lengths"]).astype(np.int32), _numbers(row["codes"])
    pieces, word_starts = _numbers(row["pieces"]), _numbers(row["starts"]).astype(np.int64)
    begins = np.cumsum(lengths, dtype=np.int32) - lengths
    each = lengths[codes]
    at = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    starts = at[word_starts] + np.arange(len(word_starts))
    nexts = np.full(int(starts[-1]), size - 1, dtype=np.int32)
    own = np.ones(len(nexts), dtype=bool)
    own[starts[1:] - 1] = False
    piece = np.repeat(begins[codes] - at[:-1].astype(np.int32), each)
    piece += np.arange(len(piece), dtype=np.int32)
    nexts[own] = pieces[piece]
    if rows is not None:
        nexts = rows.astype(np.int32)[nexts]
    inputs = np.empty_like(nexts)
    inputs[1:] = nexts[:-1]  # what comes before a text's first id is the end of another text
    inputs[starts[:-1]] = size - 1 if rows is None else rows[size - 1]
    return _Read(inputs, nexts, starts, np.frombuffer(row["learn"], dtype="u1").astype(bool))


def _summed(parts: DataFrame, kind: str = "<f8") -> dict[int, np.ndarray]:
    """Sums of arrays by key, first by (key, salt) and then by key, so that no group has every task's array."""
    def add(group: pa.Table) -> pa.Table:
        total = None
        for raw in group.column("values"):
            own = np.frombuffer(raw.as_py(), dtype=kind).astype(np.float64)
            total = own if total is None else total + own
        keys = [group.column(c)[0].as_py() for c in ("key", "salt")]
        return pa.table({"key": pa.array(keys[:1], pa.int64()), "salt": pa.array(keys[1:], pa.int64()), "values": pa.array([total.astype(kind).tobytes()], pa.binary())})

    once = parts.groupBy("key", "salt").applyInArrow(add, _PARTS).withColumn("salt", F.lit(0).cast("bigint"))
    with arrow_batches(parts.sparkSession, 1):  # a row is a slice, or a block of a table
        found = once.groupBy("key", "salt").applyInArrow(add, _PARTS).collect()
    return {r["key"]: np.frombuffer(r["values"], dtype=kind).astype(np.float64) for r in found}


_PARTS = "key bigint, salt bigint, values binary"


def _parts(key_values: list[tuple[int, np.ndarray]], salts: int, kind: str = "<f8") -> pa.RecordBatch:
    salt = TaskContext.get().partitionId() % salts
    return pa.RecordBatch.from_pydict({
        "key": pa.array([k for k, _ in key_values], pa.int64()), "salt": pa.array([salt] * len(key_values), pa.int64()),
        "values": pa.array([np.ascontiguousarray(v, dtype=kind).tobytes() for _, v in key_values], pa.binary())})


def _count_ids(size: int, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for row in _rows(batches):
            counts = np.repeat(row["counts"].astype(np.float64), _numbers(row["lengths"]))
            total += np.bincount(_numbers(row["pieces"]), weights=counts, minlength=size)
            total[-1] += np.frombuffer(row["learn"], dtype="u1").sum()
        yield _parts([(0, total)], salts)

    return run


def _table_parts(table: Callable[[slice], np.ndarray], used: np.ndarray, salts: int, kind: str = "<f8") -> Iterator[pa.RecordBatch]:
    """Blocks of ``ROWS`` rows that have a used row, made from ``table`` a few at a time."""
    def block(b: int) -> np.ndarray:
        own = table(slice(b * ROWS, (b + 1) * ROWS))
        return np.pad(own, ((0, ROWS - len(own)), (0, 0))).ravel()

    blocks = np.unique(np.flatnonzero(used) // ROWS).tolist()
    for at in range(0, len(blocks), BLOCKS):
        yield _parts([(b, block(b)) for b in blocks[at : at + BLOCKS]], salts, kind)


def _joined(found: dict[int, np.ndarray], rows: int, columns: int) -> np.ndarray:
    out = np.zeros((-(-rows // ROWS) * ROWS, columns))
    for b, values in found.items():
        if b >= 0:
            out[b * ROWS : (b + 1) * ROWS] = values.reshape(ROWS, columns)
    return out[:rows]


def _count_followers(size: int, rows: Broadcast, group: Broadcast, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each id follows each group of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, groups = len(group.value), group.value.astype(np.int32)
        total = np.zeros(n * MIXTURE)
        for row in _rows(batches):
            read = _read(row, size, rows.value)
            kept = np.repeat(read.learn, np.diff(read.starts))
            total += np.bincount(read.nexts[kept] * np.int32(MIXTURE) + groups[read.inputs[kept]], minlength=len(total))
        table = total.reshape(n, MIXTURE)
        yield from _table_parts(lambda rows: table[rows], table.any(axis=1), salts)

    return run


_SMALL = ("place", "query", "key", "value", "out")


def _train(size: int, rows: Broadcast, model: Broadcast, round_number: int, rounds: int, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trains a task's own copy on the round's windows: tables weighted by use, the rest by positions, and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = model.value
        learner = Learner(replace(begun, **{n: getattr(begun, n).copy() for n in begun.trained}))
        for row in _rows(batches):
            read = _read(row, size, rows.value)
            text, first, _ = windows(np.diff(read.starts))
            drawn = mix(np.arange(len(text), dtype=np.uint64) + mix(np.array([row["slice"]], dtype=np.uint64))).astype(np.int64)
            mine = np.flatnonzero(read.learn[text] & (drawn % rounds == round_number))
            mine = mine[np.argsort(drawn[mine], kind="stable")]
            for at in range(0, len(mine), STEP_WINDOWS):
                own = mine[at : at + STEP_WINDOWS]
                place, real = cut(read.starts, text[own], first[own], len(read.inputs) - 1)
                learner.learn(read.inputs[place], read.nexts[place], real)
        if learner.positions:
            m = learner.model

            def table(rows: slice) -> np.ndarray:
                seen = learner.seen[rows, None].astype(np.float64)
                return np.concatenate([seen, (m.gate[rows] - begun.gate[rows]) * seen, (m.embed[rows] - begun.embed[rows]) * seen, learner.counts[rows]], axis=1)

            yield from _table_parts(table, (learner.seen > 0) | learner.counts.any(axis=1), salts, "<f4")
            small = np.concatenate([(getattr(m, n) - getattr(begun, n)).ravel() for n in _SMALL]) * learner.positions
            yield _parts([(-1, np.append(small, learner.positions))], salts, "<f4")

    return run


def _normal(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Distributions over all ids, one a column; the row of unseen ids gives what one of them gets."""
    smooth = counts + PRIOR * share[:, None]
    return smooth / smooth.sum(axis=0)


@dataclass(frozen=True)
class Trained:
    """A model, the row of each id in its tables, and how many ids there are."""

    model: Model
    rows: np.ndarray
    size: int


def fit(cut_docs: DataFrame, size: int, rounds: int = ROUNDS) -> Trained:
    """The model learned from the slices' documents outside the held-out fold.

    What reaches the driver are the model's tables: their rows are ids of the tokenizer, a fixed number.
    """
    spark = cut_docs.sparkSession
    salts = max(1, math.isqrt(cut_docs.rdd.getNumPartitions()))
    found = _summed(cut_docs.select("learn", "lengths", "pieces", "counts").mapInArrow(_count_ids(size, salts), _PARTS))
    counts = found.get(0, np.zeros(size))
    known = np.flatnonzero(counts)
    n = len(known) + 1
    rows = np.full(size, n - 1, dtype=np.int64)
    rows[known] = np.arange(n - 1)
    rank = np.empty(n, dtype=np.int64)
    rank[:-1][np.argsort(-counts[known], kind="stable")] = np.arange(n - 1)
    rank[-1] = n
    group = np.where(rank < OWN_GROUPS, rank, OWN_GROUPS + rank % (MIXTURE - OWN_GROUPS))
    unseen = max(1, size - n + 1)
    share = np.append(counts[known] + BASE_PRIOR, BASE_PRIOR * unseen)
    share /= share.sum()
    spread = lambda c: np.ascontiguousarray(_normal(c, share) / np.append(np.ones(n - 1), unseen)[:, None], dtype=np.float32)
    send = spark.sparkContext.broadcast
    texts = cut_docs.select("slice", "learn", "starts", "codes", "lengths", "pieces")
    sent = send(rows)
    followers = _joined(_summed(texts.mapInArrow(_count_followers(size, sent, send(group), salts), _PARTS)), n, MIXTURE)
    model = Model.start(n, group, spread(followers))
    for r in range(rounds):
        found = _summed(texts.mapInArrow(_train(size, sent, send(model), r, rounds, salts), _PARTS), "<f4")
        if -1 not in found:
            continue
        tables = _joined(found, n, 1 + 2 * MIXTURE + WIDTH)
        seen, gate, embed, expected = np.split(tables, np.cumsum([1, MIXTURE, WIDTH]), axis=1)
        weight = np.maximum(seen, 1)
        moved = {"gate": model.gate + gate / weight, "embed": model.embed + embed / weight}
        at = 0
        for name in _SMALL:
            old = getattr(model, name)
            moved[name] = old + found[-1][at : at + old.size].reshape(old.shape) / found[-1][-1]
            at += old.size
        model = replace(model, **{k: v.astype(np.float32) for k, v in moved.items()}, spread=spread(expected))
    return Trained(model, rows, size)


def _score(trained: Broadcast, log10: Callable[[np.ndarray], np.ndarray], ends: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The scores of one slice's texts, given the slice and the counts of its words."""
    ready: list[Pass] = []  # once a task

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        model = trained.value
        if not ready:
            ready.append(Pass(model.model))
        ids = own.column("ids").combine_chunks()
        row = {n: own.column(n)[0].as_buffer() for n in ("learn", "starts", "codes", "lengths", "pieces")}
        read = _read(row, model.size, model.rows)
        codes, word_starts = _numbers(row["codes"]), _numbers(row["starts"]).astype(np.int64)
        counts = np.frombuffer(known.column("known")[0].as_buffer() if known.num_rows else b"", dtype="<i8")[codes]
        n = np.diff(word_starts)
        text = np.repeat(np.arange(len(n)), n)
        add = lambda x: np.bincount(text, weights=x, minlength=len(n))
        return pa.table(
            [pc.list_flatten(ids), pa.array(~read.learn), pa.array(n + 1, pa.int64()),
             pa.array((add(counts > 0) + (ends > 0)).astype(np.int64), pa.int64()), pa.array(add(log10(counts)) + log10(np.array([ends]))[0]),
             pa.array(log_likelihoods(ready[0], read.inputs, read.nexts, read.starts))],
            ["_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(cut_docs: DataFrame, trained: Trained, counts: Counts, id: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document of the slices."""
    texts = cut_docs.select("slice", "ids", "learn", "starts", "codes", "lengths", "pieces")
    id_type = texts.schema["ids"].dataType.elementType.simpleString()
    out = f"_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    model = cut_docs.sparkSession.sparkContext.broadcast(trained)
    log10 = partial(_log10, tokens=counts.tokens, distinct=counts.distinct)
    known = counts.known.select("of", "known")  # a group is a slice and its counts, so the worker gets one slice at a time
    scored = texts.groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(_score(model, log10, counts.ends), out)
    return scored.select(F.col("_id").alias(id), "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
                         "base_score", "score")


def _log10(c: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    return np.log10((c + BASE_PRIOR) / (tokens + BASE_PRIOR * (distinct + 1)))


def score_documents(docs: DataFrame, pieces_path: str, pattern: str, text: str = "text", id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """log10 probabilities of all whole texts, under a unigram base and under the model learned from the corpus.

    A-Z are put in lower case; tokens are the words and one end a text. Documents whose CRC-32 of the id, as text, leaves
    a remainder by ``FOLDS`` are learned from. ``n_known`` counts tokens that these have, ``train_tokens`` is how many
    tokens they have. ``score`` is the probability of the words' piece ids, each word with a space before it, and of the
    end; each position is scored once, after up to ``WINDOW - 1`` positions before it, ``WINDOW - STEP`` of them at least
    where the text has them. Null and empty texts are an end alone. Repeated rows are scored, and learned from, each; a
    null id counts as empty text; an empty table gives no rows, and one without documents to learn from has a base
    and a model of equal chances. Columns other than these two are not looked at.
    """
    with open(pieces_path) as f:
        size = len(f.read().splitlines()) + 1
    cut_docs = slices(docs, pieces_path, pattern, text, id)
    return score(cut_docs, fit(cut_docs, size, rounds), word_counts(cut_docs), id)
