"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and beginnings of words. All terms of all examples are indexed; one that labelled examples of one class have
more often weighs more, by its likelihood ratio, and none is left out. Terms of very many or of few examples are scored for
every example; the postings of the others lie in blocks of examples with the largest weight of each term and block. A
document's bound in a block is the best score so far of an example in it and the sum of its other terms' block maxima;
the blocks of the best bounds are scored first, then all whose bounds reach the k-th best score, so the neighbours are exact.
Their votes, weighted by cosine and shrunk towards the share of toxic examples, are the score; the neighbours are the
evidence. A document's length is taken over the terms that examples have, as the others have no counted frequency; this
changes no order of neighbours.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.near import node_of
from vitalspan.llm.texts import sliced, split_words
from vitalspan.session import settle

#: Labelled rows that are learned from at most: those of smallest hash of their id.
MAX_EXAMPLES = 8_000
#: Lengths of the beginnings of words that are terms too.
PREFIXES = (5,)
NEIGHBOURS = 25
BLOCK_EXAMPLES = 256
#: Terms of one in so many examples are columns of a matrix (of so many columns at most); terms of fewer examples than a
#: block has get no block maxima. Both change the layout only.
HEAD_SHARE = 16
HEAD_TERMS = 512
#: Blocks that are scored before all others, for a first bound, and the largest share of block maxima, one in so many, up to
#: which the remaining blocks are scored by themselves.
FIRST_BLOCKS = 4
FEW_BLOCKS = 5
#: Documents whose scores in the matrix are computed together.
TOGETHER = 64
#: Weight of the examples' share of toxic ones, in neighbours of cosine 1.
PRIOR_WEIGHT = 1.0
_SIGNS = ".,;:!?|#$%&*\"'()[]{}<>-_"


def _spellings(vocabulary: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Terms of words, kind by kind: the words that have one, and their terms.

    A word's terms are the word in lower case without signs at its ends, and the beginnings of a longer one.
    """
    small = pc.utf8_trim(pc.utf8_lower(vocabulary), characters=_SIGNS)
    size = pc.utf8_length(small).to_numpy(zero_copy_only=False)
    for n in (0, *PREFIXES):
        own = np.flatnonzero(size > n)
        names = small.take(pa.array(own))
        yield own, pc.binary_join_element_wise(pc.utf8_slice_codeunits(names, 0, n), "~", "") if n else names


class Terms:
    """Spelled terms and their numbers; kept as one Arrow array, as there may be millions."""

    def __init__(self, spelled: pa.Array):
        self.spelled = spelled

    def __len__(self) -> int:
        return len(self.spelled)

    def __iter__(self) -> Iterator[str]:
        return iter(self.spelled.to_pylist())

    def numbers(self, names: pa.Array) -> np.ndarray:
        """The number of each name; -1 for others."""
        return pc.fill_null(pc.index_in(names, value_set=self.spelled), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def document_terms(texts: pa.Array, known: Terms | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, frequency) of the distinct terms of each text, and the terms; only ``known`` ones if given."""
    words = split_words(texts)
    kinds = list(_spellings(words.vocabulary))
    coded = pa.concat_arrays([pa.array([], pa.string()), *(names for _, names in kinds)]).dictionary_encode()
    number = np.arange(len(coded.dictionary)) if known is None else known.numbers(coded.dictionary)
    number = number[coded.indices.to_numpy(zero_copy_only=False)]
    size, width = max(1, len(words.vocabulary)), max(1, len(coded.dictionary) if known is None else len(known))
    pair, often = np.unique(words.rows * size + words.codes, return_counts=True)
    row, word = pair // size, pair % size
    keys, counts, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for own, names in kinds:
        term = np.full(size, -1, dtype=np.int64)
        term[own] = number[begin : begin + len(names)]
        begin += len(names)
        found = np.flatnonzero(term[word] >= 0)
        keys.append(row[found] * width + term[word[found]])
        counts.append(often[found])
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    return key[first] // width, key[first] % width, np.add.reduceat(count, first) if len(key) else count, coded.dictionary


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each slice the numbers of documents, and of toxic ones, that have a term."""
    for batch in sliced(batches, "_text"):
        row, term, _, names = document_terms(batch.column("_text"))
        toxic = batch.column("_toxic").to_numpy(zero_copy_only=False)
        n, t = np.bincount(term, minlength=len(names)), np.bincount(term, toxic[row], minlength=len(names))
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(n, pa.int64()), pa.array(t.astype(np.int64), pa.int64())], ["term", "n", "t"])


def _known_counts(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In each slice the numbers of documents that have a known term, by the term's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            n = np.bincount(document_terms(batch.column("_text"), known.value)[1])
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["term", "n"])

    return run


class ExampleIndex:
    """A block-max inverted index of labelled examples with unit vectors; ``idf`` is the weight of each term."""

    def __init__(self, terms: Collection[str], idf: np.ndarray, examples: list[tuple[int, int, Sequence[int], Sequence[int]]], base: float):
        self.terms, self.idf, self.base = terms, idf, base
        lengths = [self._length(np.asarray(t), np.asarray(n)) for _, _, t, n in examples]
        # alike ones share a block
        alike = sorted(range(len(examples)), key=lambda e: (lengths[e][1], examples[e][0]))
        self.ids = np.array([examples[e][0] for e in alike], dtype=np.int64)
        self.labels = np.array([examples[e][1] for e in alike], dtype=np.int64)
        self.lengths = np.array([lengths[e][0] for e in alike])
        self.n, self.blocks = len(alike), -(-len(alike) // BLOCK_EXAMPLES)
        term = np.concatenate([np.zeros(0, np.int32), *(np.asarray(examples[e][2], np.int32) for e in alike)])
        order = np.argsort(term, kind="stable")
        self.range = np.append(0, np.cumsum(np.bincount(term, minlength=len(terms))))
        del term
        self.at = np.repeat(np.arange(self.n, dtype=np.min_scalar_type(self.n)), [len(examples[e][2]) for e in alike])[order]
        self.often = np.concatenate([np.zeros(0, np.int32), *(np.asarray(examples[e][3], np.int32) for e in alike)])[order]
        self.often = self.often.astype(np.min_scalar_type(self.often.max(initial=0)))
        self.dense: np.ndarray | None = None  # until the first query, as the postings are what is shipped

    def _length(self, term: np.ndarray, often: np.ndarray) -> tuple[float, int]:
        """The length of a vector before it is cut to 1, and its term of largest weight."""
        raw = (1 + np.log(often)) * self.idf[term]
        return float(np.sqrt((raw * raw).sum())), int(term[np.argmax(raw)])

    def _open(self) -> None:
        """Weights, matrix and block maxima of the postings."""
        holders = np.diff(self.range)
        term = np.repeat(np.arange(len(holders), dtype=np.int32), holders)
        weight = (1 + np.log(self.often.astype(np.float64))) * self.idf[term] / self.lengths[self.at]
        heads = np.flatnonzero(holders * HEAD_SHARE >= max(1, self.n))
        heads = heads[np.argsort(-holders[heads], kind="stable")[:HEAD_TERMS]]
        self.column = np.full(len(holders), -1, dtype=np.int32)
        self.column[heads] = np.arange(len(heads))
        self.dense = np.zeros((len(heads), self.n))
        for i, head in enumerate(heads.tolist()):
            own = slice(self.range[head], self.range[head + 1])
            self.dense[i, self.at[own]] = weight[own]
        rest = self.column[term] < 0
        term, self.at, self.weight = term[rest], self.at[rest].astype(np.int32), weight[rest]
        self.range = np.append(0, np.cumsum(np.where(self.column < 0, holders, 0)))
        del self.often
        self.blocked = (holders >= BLOCK_EXAMPLES) & (self.column < 0)
        posting = np.flatnonzero(self.blocked[term])
        key = term[posting].astype(np.int64) * max(1, self.blocks) + self.at[posting] // BLOCK_EXAMPLES
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        pair = key[first]
        self.pair_block = (pair % max(1, self.blocks)).astype(np.int32)
        self.pair_start, self.pair_end = posting[first], posting[np.append(first[1:], len(key)) - 1] + 1 if len(key) else first
        self.pair_max = np.maximum.reduceat(self.weight[posting], first) if len(key) else np.zeros(0)
        self.term_range = np.searchsorted(pair, np.arange(len(holders) + 1) * max(1, self.blocks))

    def __reduce__(self) -> tuple:
        """Compressed, as every executor keeps a copy on disk."""
        state = pickle.dumps(self.__dict__, pickle.HIGHEST_PROTOCOL)
        return _unpacked, (pa.compress(state, "zstd", asbytes=True), len(state))

    def weights(self, term: np.ndarray, often: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(often)) * self.idf[term]
        return raw / np.sqrt((raw * raw).sum())

    def nearest(self, term: np.ndarray, often: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (all positive ones if fewer), ties in index order, and the cosines."""
        return next(self.nearest_each([(term, often)], k))

    def nearest_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each query."""
        if self.dense is None:
            self._open()
        for begin in range(0, len(queries), TOGETHER):
            some = [(term, self.weights(term, often)) for term, often in queries[begin : begin + TOGETHER]]
            own = np.zeros((len(some), len(self.dense)))
            for i, (term, weight) in enumerate(some):
                column = self.column[term]
                own[i, column[column >= 0]] = weight[column >= 0]
            for (term, weight), cosine in zip(some, own @ self.dense, strict=True):
                rest = self.column[term] < 0
                yield self._nearest(term[rest], weight[rest], cosine, k)

    def _nearest(self, term: np.ndarray, weight: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``cosine`` has the sums over the terms of the matrix."""
        if not self.n:
            return np.zeros(0, np.int64), cosine
        blocked = self.blocked[term]
        cosine = cosine + self._sums(self.range[term[~blocked]], self.range[term[~blocked] + 1], weight[~blocked])
        term, weight = term[blocked], weight[blocked]
        which, pair = _ranges(self.term_range[term], self.term_range[term + 1])
        block = self.pair_block[pair]
        bound = np.maximum.reduceat(cosine, np.arange(0, self.n, BLOCK_EXAMPLES))
        bound = bound + np.bincount(block, weight[which] * self.pair_max[pair], minlength=self.blocks)
        k = min(k, self.n)
        first = np.zeros(self.blocks, dtype=bool)
        first[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        sums = cosine + self._block_sums(first, block, pair, which, weight)
        least = np.partition(sums, self.n - k)[self.n - k]  # sums of some terms are no larger than cosines
        able = ~first & (bound > 0) & (bound * (1 + 1e-9) >= least)
        if able[block].sum() * FEW_BLOCKS <= len(block):
            cosine = sums + self._block_sums(able, block, pair, which, weight)
        else:  # whole ranges of postings are read faster than parts of them
            cosine = cosine + self._sums(self.range[term], self.range[term + 1], weight)
        least = np.partition(cosine, self.n - k)[self.n - k]
        able = np.flatnonzero(cosine >= least - 2e-12)
        best = able[np.argsort(-np.round(cosine[able], 12), kind="stable")[:k]]
        best = best[cosine[best] > 0]
        return best, cosine[best]

    def _sums(self, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each example's sum over ranges of postings, which are copied whole."""
        if not len(starts):
            return np.zeros(self.n)
        ranges = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        products = np.concatenate([self.weight[r] for r in ranges])
        products *= np.repeat(weight, ends - starts)
        return np.bincount(np.concatenate([self.at[r] for r in ranges]), products, minlength=self.n)

    def _block_sums(self, chosen: np.ndarray, block: np.ndarray, pair: np.ndarray, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each example's sum over the postings that lie in the chosen blocks."""
        own = chosen[block]
        again, posting = _ranges(self.pair_start[pair[own]], self.pair_end[pair[own]])
        return np.bincount(self.at[posting], weight[which[own]][again] * self.weight[posting], minlength=self.n)

    def score(self, neighbours: np.ndarray, cosine: np.ndarray) -> float:
        votes = float((cosine * self.labels[neighbours]).sum())
        return (votes + PRIOR_WEIGHT * self.base) / (float(cosine.sum()) + PRIOR_WEIGHT)


def _unpacked(state: bytes, size: int) -> ExampleIndex:
    index = ExampleIndex.__new__(ExampleIndex)
    index.__dict__.update(pickle.loads(pa.decompress(state, size, "zstd", asbytes=True)))
    return index


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of positions: the range and the position of each."""
    counts = ends - starts
    which = np.repeat(np.arange(len(starts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]


@dataclass
class Model:
    """The index, and the share of toxic examples among those without any term."""

    index: ExampleIndex
    silent: float


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        most: int = MAX_EXAMPLES) -> Model:
    """Learns from at most ``most`` labelled rows, those of smallest hash of their id; rows that repeat an id are toxic if one is.

    Only labelled rows and their terms reach the driver: ``most`` rows as numbers of terms, and each term with its counts.
    How many documents have a term is counted over all of ``docs``.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(
        F.max(F.col(label).cast("long")).alias("_toxic"))
    chosen = settle(known.orderBy(F.xxhash64("_id"), "_id").limit(most))  # so many rows at most, hence broadcast
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    examples = settle(texts.join(F.broadcast(chosen), "_id"))  # every row is an example, equal texts too
    # In the choice of weights equal texts are one of each label: what they share would otherwise look like a sign.
    different = settle(examples.groupBy(node_of(F.col("_text")).alias("_node"), "_toxic").agg(F.min("_text").alias("_text")))
    rows = [d.agg(F.count(F.lit(1)), F.coalesce(F.sum("_toxic"), F.lit(0))).collect()[0] for d in (examples, different)]
    (n, toxic), (texts_n, texts_toxic) = [(int(r[0]), int(r[1])) for r in rows]
    counted = different.select("_text", "_toxic").mapInArrow(_term_counts, "term string, n bigint, t bigint")
    table = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    base = (texts_toxic + 0.5) / (texts_n + 1)
    gain = lambda count, share: F.when(count > 0, count * F.log(count / (F.col("n") * share))).otherwise(0.0)
    ratio = F.greatest(F.lit(0.0), 2 * (gain(F.col("t"), base) + gain(F.col("n") - F.col("t"), 1 - base)))
    rows = table.select("term", ratio.alias("g")).toArrow().sort_by("term")
    terms = Terms(_whole(rows["term"]))
    by_chance = 2 * np.log(max(2, len(terms)))  # a term that tells nothing reaches this once in all terms, about
    telling = 1 + rows["g"].to_numpy() / by_chance
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    spread = texts.select("_text").mapInArrow(_known_counts(shared), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    idf = np.ones(len(terms))
    idf[spread["term"].to_numpy()] = 1 + np.log((1 + texts.count()) / (1 + spread["n"].to_numpy()))
    vectors = examples.mapInArrow(_vectors(shared), "id bigint, toxic bigint, terms array<int>, often array<int>").toArrow()
    ids, labels_of = vectors["id"].to_pylist(), vectors["toxic"].to_pylist()
    parts = [[x.values.to_numpy()[a:b] for x in vectors[c].chunks for a, b in pairwise(x.offsets.to_numpy())] for c in ("terms", "often")]
    own = list(zip(ids, labels_of, *parts, strict=True))
    spoken = sum(labels_of)
    return Model(ExampleIndex(terms, idf * telling, own, (toxic + 0.1) / (n + 1)), (toxic - spoken + 0.1) / (n - len(own) + 1))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([pa.array([], column.type), *column.chunks])


def _vectors(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The terms of the examples that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            row, term, often, _ = document_terms(batch.column("_text"), known.value)
            has, begins = np.unique(row, return_index=True)
            offsets = pa.array(np.append(begins, len(row)), pa.int32())
            take = pa.array(has)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(take), batch.column("_toxic").take(take),
                 pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(often, pa.int32()))],
                ["id", "toxic", "terms", "often"])

    return run


EVIDENCE = "array<struct<id:bigint,label:bigint,cosine:double>>"
_EVIDENCE = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int64()), ("cosine", pa.float64())]))


def score(docs: DataFrame, model: Model, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all but the text) with ``score`` (0 to 1) and ``evidence``, the nearest examples.

    Null and empty texts, and texts that share no term with any example, get the share of toxic ones among such examples and no
    evidence. Repeated rows are scored each; an empty table gives an empty one; columns of the added names give way,
    and those whose names begin with an underscore are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in (docs.columns if carried is None else carried) if c not in (text, "score", "evidence") and c[:1] != "_"]
    source = docs.select(*carried, F.col(text).cast("string").alias("_text"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, silent = shared.value.index, shared.value.silent
        for batch in sliced(batches, "_text"):
            row, term, often, _ = document_terms(batch.column("_text"), index.terms)
            scores, evidence = np.full(batch.num_rows, silent), [[] for _ in range(batch.num_rows)]
            has, begins = np.unique(row, return_index=True)
            ends = np.append(begins, len(row))[1:]
            queries = [(term[a:b], often[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            for i, (near, cosine) in zip(has.tolist(), index.nearest_each(queries), strict=True):
                if len(near):
                    scores[i] = index.score(near, cosine)
                    evidence[i] = [{"id": int(index.ids[e]), "label": int(index.labels[e]), "cosine": float(c)}
                                   for e, c in zip(near, cosine, strict=True)]
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in rest] + [pa.array(scores), pa.array(evidence, _EVIDENCE)], [n for n, _ in rest] + ["score", "evidence"])

    return source.mapInArrow(run, ", ".join([*types, "score double", f"evidence {EVIDENCE}"]))


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the row's fold, the CRC of its id as text, is the first."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
