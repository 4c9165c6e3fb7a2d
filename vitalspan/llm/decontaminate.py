"""Benchmark decontamination: every passage of the training documents is a query to an inverted index of the test items.

The index holds, for each word of the items, its BM25 impacts in blocks of items with the largest impact of each block. A
passage's upper bound in a block is the sum of its words' block maxima; only blocks whose bound reaches the lowest
threshold of their items are scored, so all items above their thresholds are found and no others are scored in full. What
is found is then verified by the share of the question's and the answer's word sequences that the document has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.texts import sliced, split_words

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
#: A passage's BM25 score of an item must reach this share of the score of the item's own text.
MIN_SCORE_SHARE = 0.5
#: Word sequences of this length (or all words of shorter parts) are compared.
GRAM_WORDS = 5
#: Of the question's, or of the answer's and the question's together, so many sequences must be in the document.
MIN_OVERLAP = 0.6
#: The index and the items' texts are shipped to every task; larger benchmarks go in parts.
MAX_ITEM_CHARS = 64 << 20
#: Passages that are looked up together, which bounds memory.
PASSAGES_AT_ONCE = 2048

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: str) -> str:
    """A word in lower case without signs at its ends, if anything is left of it."""
    small = word.lower()
    if small.isalnum():
        return small
    return _EDGE.sub("", small) or small


def plain_words(text: str | None) -> list[str]:
    return [plain(w) for w in _WORD.findall(text or "")]


def parts(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer: an item's last line, or its last sentence, is the answer; a single sentence has none."""
    whole = (text or "").strip()
    cut = max((m.end() for m in re.finditer(r"\n|[.?!:](?=\s)", whole)), default=0)
    return (plain_words(whole[:cut]), plain_words(whole[cut:])) if cut else (plain_words(whole), [])


def grams(words: list[str]) -> set[tuple[str, ...]]:
    size = min(GRAM_WORDS, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


@dataclass
class Item:
    item_id: int
    question: set[tuple[str, ...]]
    answer: set[tuple[str, ...]]


class ItemIndex:
    """A block-max inverted index of benchmark items with BM25 impacts."""

    def __init__(self, items: list[tuple[int, str | None]]):
        bags = [(i, t, Counter(plain_words(t))) for i, t in sorted(items, key=lambda x: (len(x[1] or ""), x[0]))]
        bags = [b for b in bags if b[2]]
        self.items = [Item(i, *map(grams, parts(t))) for i, t, _ in bags]
        self.n, self.passage = len(bags), 2 * max((sum(b.values()) for _, _, b in bags), default=1)
        self.blocks = -(-self.n // BLOCK_ITEMS)
        spread = Counter(w for _, _, b in bags for w in b)
        mean = sum(sum(b.values()) for _, _, b in bags) / max(1, self.n)
        self.words = {w: k for k, w in enumerate(sorted(spread))}
        rows = []
        for at, (_, _, bag) in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / mean)
            for w, n in bag.items():
                idf = np.log1p((self.n - spread[w] + 0.5) / (spread[w] + 0.5))
                rows.append((self.words[w], at, idf * n * (K1 + 1) / (n + norm)))
        rows.sort()
        self.word, self.item = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
        self.impact = np.array([r[2] for r in rows])
        self.least = MIN_SCORE_SHARE * np.bincount(self.item, self.impact, minlength=self.n)
        # Postings of a (word, block) pair lie together; `pair` finds them and their maximum.
        keys = self.word * max(1, self.blocks) + self.item // BLOCK_ITEMS
        self.pairs, self.pair_start = np.unique(keys, return_index=True)
        self.pair_end = np.append(self.pair_start[1:], len(keys))
        self.pair_max = np.maximum.reduceat(self.impact, self.pair_start) if len(keys) else np.zeros(0)
        self.word_start = np.searchsorted(self.pairs, np.arange(len(self.words) + 1) * max(1, self.blocks))
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, self.n, BLOCK_ITEMS)) if self.n else np.zeros(0)

    def search(self, passages: np.ndarray, words: np.ndarray, n_passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, item, score) with a score of the item's threshold or more; (passage, word) pairs are distinct."""
        at, pair = _ranges(self.word_start[words], self.word_start[words + 1])
        slot = passages[at] * self.blocks + self.pairs[pair] % self.blocks
        bound = np.bincount(slot, self.pair_max[pair], minlength=n_passages * self.blocks)
        good = bound.reshape(n_passages, self.blocks) * (1 + 1e-9) >= self.block_least
        chosen = good.ravel()[slot]
        again, posting = _ranges(self.pair_start[pair[chosen]], self.pair_end[pair[chosen]])
        hits, inverse = np.unique(passages[at][chosen][again] * self.n + self.item[posting], return_inverse=True)
        score = np.bincount(inverse, self.impact[posting], minlength=len(hits))
        passage, item = hits // max(1, self.n), hits % max(1, self.n)
        kept = score * (1 + 1e-9) >= self.least[item]
        return passage[kept], item[kept], score[kept]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of positions: the range and the position of each."""
    counts = ends - starts
    which = np.repeat(np.arange(len(starts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]


def overlap(item: Item, words: list[str]) -> tuple[float, float]:
    """The shares of the question's and of the answer's word sequences that ``words`` has; without an answer both are the first."""
    found = {size: {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
             for size in {len(next(iter(g))) for g in (item.question, item.answer) if g}}
    share = lambda own: sum(g in found[len(g)] for g in own) / len(own)
    question = share(item.question) if item.question else share(item.answer)
    return question, share(item.answer) if item.answer else question


def contaminated(question: float, answer: float, item: Item) -> bool:
    """The question is there, or question and answer together are."""
    n, m = len(item.question), len(item.answer)
    return question >= MIN_OVERLAP or (question * n + answer * m) / max(1, n + m) >= MIN_OVERLAP


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """Documents and the items they contain: the id, the ``extra`` columns, item_id, bm25, question_overlap, answer_overlap.

    Passages of twice the longest item's words begin every half passage, so one passage holds the whole of any item that a
    document contains. Items without words match nothing, null and empty texts match nothing, repeated rows match each, and
    empty tables give an empty result. An item's part that is shorter than five words must be found as a whole.
    """
    size = benchmark.agg(F.sum(F.length(item_text))).collect()[0][0] or 0
    if size > MAX_ITEM_CHARS:
        raise ValueError(f"the benchmark has {size} characters, more than {MAX_ITEM_CHARS}: decontaminate by parts of it")
    index = ItemIndex([(r[0], r[1]) for r in benchmark.select(F.col(item_id).cast("long"), item_text).collect()])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kept = [c for c in (extra or [])]
    source = docs.select(F.col(doc_id).alias("_id"), *(F.col(c).alias(f"_e{i}") for i, c in enumerate(kept)),
                         F.col(text).cast("string").alias("_text"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text"]
    added = {"item_id": pa.int64(), "bm25": pa.float64(), "question_overlap": pa.float64(), "answer_overlap": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in sliced(batches, "_text"):
            rows = _find(batch.column("_text"), known)
            if rows:
                take = pa.array([r[0] for r in rows])
                rest = [(n, c.take(take)) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
                yield pa.RecordBatch.from_arrays(
                    [c for _, c in rest] + [pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(added.values())],
                    [n for n, _ in rest] + list(added))

    found = source.mapInArrow(run, ", ".join([*types, "item_id bigint", *(f"{n} double" for n in list(added)[1:])]))
    return found.select(F.col("_id").alias(doc_id), *(F.col(f"_e{i}").alias(c) for i, c in enumerate(kept)), *added)


def _find(texts: pa.Array, index: ItemIndex) -> list[tuple[int, int, float, float, float]]:
    """Verified (row, item_id, best BM25 score, overlaps)."""
    if not index.n:
        return []
    words = split_words(texts)
    known = np.fromiter((index.words.get(plain(w), -1) for w in words.vocabulary.to_pylist()), dtype=np.int64,
                        count=len(words.vocabulary))[words.codes]
    step = max(1, index.passage // 2)
    lengths = np.diff(words.starts)
    counts = np.maximum(1, -(-lengths // step) - 1)  # passages of a document, each of two steps
    first = np.cumsum(counts) - counts
    row_of = np.repeat(np.arange(len(texts)), counts)
    known_at = np.flatnonzero(known >= 0)
    row = words.rows[known_at]
    half = (known_at - words.starts[row]) // step  # a word is in the passages that begin at its step and at the one before
    code, size = known[known_at], len(index.words) + 1
    later, earlier = half < counts[row], half > 0
    pairs = np.sort(np.concatenate([
        (first[row] + half)[later] * size + code[later], (first[row] + half - 1)[earlier] * size + code[earlier]]))
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    best: dict[tuple[int, int], float] = {}
    for begin in range(0, int(counts.sum()), PASSAGES_AT_ONCE):
        own = pairs[np.searchsorted(pairs, begin * size) : np.searchsorted(pairs, (begin + PASSAGES_AT_ONCE) * size)]
        passage, item, score = index.search(own // size - begin, own % size, PASSAGES_AT_ONCE)
        for p, i, s in zip(row_of[passage + begin].tolist(), item.tolist(), score.tolist(), strict=True):
            best[p, i] = max(best.get((p, i), 0.0), s)
    out = []
    spelled: dict[int, list[str]] = {}
    for (p, i), s in sorted(best.items()):
        if p not in spelled:
            spelled[p] = plain_words(texts[p].as_py())
        question, answer = overlap(index.items[i], spelled[p])
        if contaminated(question, answer, index.items[i]):
            out.append((p, index.items[i].item_id, s, question, answer))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, unchanged; one pass over the texts, which stay where they are.

    Null and empty texts contain none, repeated rows stay or go together, an empty benchmark or table removes nothing, and
    columns of any name stay as they are.
    """
    items = benchmark.select(item_text).distinct()
    size = items.agg(F.sum(F.length(item_text))).collect()[0][0] or 0
    if size > MAX_ITEM_CHARS:
        raise ValueError(f"the benchmark has {size} characters, more than {MAX_ITEM_CHARS}: decontaminate by parts of it")
    shared = docs.sparkSession.sparkContext.broadcast(ItemIndex([(i, r[0]) for i, r in enumerate(items.orderBy(item_text).collect())]))
    at, name = docs.columns.index(text), text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, name):
            bad = {r[0] for r in _find(batch.column(at), shared.value)}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)])) if bad else batch

    return docs.mapInArrow(run, docs.schema)
