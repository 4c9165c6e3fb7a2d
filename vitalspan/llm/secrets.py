"""Secret scans by grammar inference.

Labelled credentials of each kind are put into a prefix tree; states of the tree whose outgoing frequencies do not differ
more than chance allows (a Hoeffding bound) are merged, which gives a probabilistic automaton of the kind's format. Every
candidate string of every text is then scored by its likelihood under the automata, and those that fit a format as well as
labelled credentials do, and better than ordinary strings, are reported beside the matches of the fixed rules.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.texts import sliced
from vitalspan.session import settle

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEARNED, ORDINARY = "learned", "ordinary"
#: Labelled credentials of a kind, and ordinary strings, that a format is learned from at most: those of smallest hash.
MAX_EXAMPLES = 1000
#: Fewer labelled credentials than this give no automaton.
MIN_EXAMPLES = 20
ALPHABET = 67  # of candidates, and the end


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Matches of the fixed rules: (start, end, kind, the credential itself), each kind leftmost and non-overlapping."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, spans: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str]]:
    """Strings of the credentials' alphabet that touch no match of the fixed rules."""
    at = 0
    ordered = sorted((a, b) for a, b, _, _ in spans)
    reach = 0
    for m in CANDIDATE.finditer(text):
        while at < len(ordered) and ordered[at][0] < m.end():
            reach = max(reach, ordered[at][1])
            at += 1
        if reach <= m.start():
            yield m.start(), m.end(), m[0]


@dataclass
class State:
    seen: int = 0
    ended: int = 0
    next: dict[str, int] = field(default_factory=dict)
    taken: Counter = field(default_factory=Counter)


class Automaton:
    """A deterministic probabilistic automaton, learned by merging states of the prefix tree of example strings.

    States are visited from the root on: a state that no kept state is compatible with is kept, otherwise it is folded
    into the first compatible one, together with what follows it. Lengths have a likelihood of their own, since merging
    states loses them.
    """

    def __init__(self, examples: Iterable[str], confidence: float = 0.05):
        self.states = [State()]
        self.slack = math.sqrt(0.5 * math.log(2 / confidence))
        self.lengths: Counter = Counter()
        for text in examples:
            self.lengths[len(text)] += 1
            q = 0
            self.states[q].seen += 1
            for c in text:
                s = self.states[q]
                if c not in s.next:
                    s.next[c] = len(self.states)
                    self.states.append(State())
                s.taken[c] += 1
                q = s.next[c]
                self.states[q].seen += 1
            self.states[q].ended += 1
        self._merge()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.slack * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            if self._differ(p.ended, p.seen, q.ended, q.seen):
                return False
            for c in p.taken.keys() | q.taken.keys():
                if self._differ(p.taken[c], p.seen, q.taken[c], q.seen):
                    return False
                if c in p.next and c in q.next:
                    todo.append((p.next[c], q.next[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to the state ``a`` and those it leads to."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            p.seen += q.seen
            p.ended += q.ended
            for c, to in q.next.items():
                p.taken[c] += q.taken[c]
                if c in p.next:
                    todo.append((p.next[c], to))
                else:
                    p.next[c] = to

    def _merge(self) -> None:
        kept, at = [0], 0
        while at < len(kept):
            state = self.states[kept[at]]
            known = set(kept)
            fresh = sorted(c for c, to in state.next.items() if to not in known)
            if not fresh:
                at += 1
                continue
            blue = state.next[fresh[0]]
            into = next((k for k in kept if self._compatible(k, blue)), None)
            if into is None:
                kept.append(blue)
            else:
                state.next[fresh[0]] = into
                self._fold(into, blue)
                at = 0  # folding may have given an earlier state new successors
        place = {k: i for i, k in enumerate(kept)}
        self.states = [self.states[k] for k in kept]
        for s in self.states:
            s.next = {c: place[to] for c, to in s.next.items()}

    def score(self, text: str) -> float:
        """Bits of likelihood a symbol, the end and the length included; an unseen step costs its smoothed probability."""
        n = sum(self.lengths.values())
        bits = math.log2((self.lengths[len(text)] + 0.5) / (n + 0.5 * (len(self.lengths) + 1)))
        q = 0
        for c in text:
            s = self.states[q]
            bits += math.log2((s.taken[c] + 1 / ALPHABET) / (s.seen + 1))
            q = s.next.get(c, 0)
        s = self.states[q]
        return (bits + math.log2((s.ended + 1 / ALPHABET) / (s.seen + 1))) / (len(text) + 1)


@dataclass
class Formats:
    """One automaton and threshold a kind, and the automaton of ordinary strings."""

    kinds: dict[str, tuple[Automaton, float]]
    ordinary: Automaton | None

    def best(self, text: str) -> tuple[str, float] | None:
        """The kind whose format the text fits, and its likelihood, or None."""
        plain = self.ordinary.score(text) if self.ordinary else -math.inf
        fits = [(s, kind) for kind, (a, least) in self.kinds.items() if (s := a.score(text)) >= least and s > plain]
        return (max(fits)[1], max(fits)[0]) if fits else None


def learn(examples: Iterable[tuple[str, str]]) -> Formats:
    """Formats from labelled strings (kind, text); the kind ``ordinary`` is what credentials must differ from.

    Each kind's threshold is the first percentile of its examples, each half scored by the automaton of the other half.
    """
    by_kind: dict[str, list[str]] = {}
    for kind, text in sorted(set(examples), key=lambda e: (e[0], xxhash.xxh64_intdigest(e[1]), e[1])):
        by_kind.setdefault(kind, []).append(text)
    kinds = {}
    for kind, own in by_kind.items():
        if kind != ORDINARY and len(own) >= MIN_EXAMPLES:
            halves = own[::2], own[1::2]
            crossed = sorted(a.score(t) for fit, rest in (halves, halves[::-1]) for a in [Automaton(fit)] for t in rest)
            kinds[kind] = (Automaton(own), crossed[len(crossed) // 100])
    plain = by_kind.get(ORDINARY, [])
    return Formats(kinds, Automaton(plain) if plain else None)


def _examples(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In each task the ``most`` distinct strings of smallest hash of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[tuple[int, str], None]] = {k: {} for k in (*KINDS, ORDINARY)}

        def trim(kind: str) -> None:
            kept[kind] = dict.fromkeys(heapq.nsmallest(most, kept[kind]))

        for batch in sliced(batches, "_text"):
            for text in batch.column("_text").to_pylist():
                spans = base_spans(text or "")
                found = [(kind, value) for _, _, kind, value in spans]
                found += [(ORDINARY, value) for _, _, value in candidates(text or "", spans)]
                for kind, value in found:
                    kept[kind][xxhash.xxh64_intdigest(value), value] = None
                    if len(kept[kind]) > 8 * most:
                        trim(kind)
        for kind in kept:
            trim(kind)
        rows = [(kind, f"{h:016x}", value) for kind, own in kept.items() for h, value in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "hash", "value"])

    return run


def fit(docs: DataFrame, text: str = "text", most: int = MAX_EXAMPLES) -> Formats:
    """Formats learned from the credentials that the fixed rules find in ``docs``, which serve as labelled ones.

    A kind is learned from its ``most`` distinct credentials of smallest hash (``MAX_EXAMPLES``), and so are ordinary
    strings; each task sends that many at most, and the driver gets four times that many rows at most.
    """
    found = settle(docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(
        _examples(most), "kind string, hash string, value string"))
    chosen = []
    for kind in (*KINDS, ORDINARY):
        rows = found.where(F.col("kind") == kind).distinct().orderBy("hash", "value").limit(most).collect()
        chosen += [(r["kind"], r["value"]) for r in rows]
    return learn(chosen)


def all_spans(text: str, formats: Formats) -> list[tuple[int, int, str, float]]:
    """Matches of the fixed rules (likelihood 0 bits) and candidates that fit a learned format, by start, then kind."""
    base = base_spans(text)
    out = [(a, b, kind, 0.0) for a, b, kind, _ in base]
    for a, b, value in candidates(text, base):
        if fits := formats.best(value):
            out.append((a, b, LEARNED, fits[1]))
    order = (*KINDS, LEARNED)
    return sorted(out, key=lambda s: (s[0], order.index(s[2])))


SPANS = "array<struct<start:bigint,end:bigint,kind:string,bits:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("bits", pa.float64())]))


def scan(docs: DataFrame, formats: Formats, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all but the text) and ``spans``: start, end (code points, end exclusive), kind, bits.

    Null and empty texts have no spans; repeated rows are scanned each; an empty table gives an empty one; a carried column
    named ``spans`` gives way to the result, and one whose name begins with an underscore is not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    carried = [c for c in (docs.columns if carried is None else carried) if c not in (text, "spans") and c[:1] != "_"]
    source = docs.select(*carried, F.col(text).cast("string").alias("_text"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            spans = [[{"start": a, "end": b, "kind": k, "bits": s} for a, b, k, s in all_spans(t or "", shared.value)]
                     for t in batch.column("_text").to_pylist()]
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(spans, _SPAN_TYPE)], [n for n, _ in rest] + ["spans"])

    return source.mapInArrow(run, ", ".join([*types, f"spans {SPANS}"]))


def redact_text(text: str, formats: Formats, mark: str) -> str:
    out, at = [], 0
    for a, b, _, _ in all_spans(text, formats):
        if b > at:
            out += [text[at:a], mark] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, formats: Formats, text: str = "text", length: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` (overlapping spans by one); nulls stay null.

    The column named by ``length``, if any, gets the new number of code points of changed texts. Other rows stay as they are.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(formats)
    names, at = docs.columns, docs.columns.index(text)
    size_at = names.index(length) if length else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, names[at]):
            old = batch.column(at).to_pylist()
            new = [None if t is None else redact_text(t, shared.value, mark) for t in old]
            if size_at is not None:
                sizes = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column(size_at).to_pylist(), strict=True)]
                batch = batch.set_column(size_at, names[size_at], pa.array(sizes, batch.schema.field(size_at).type))
            yield batch.set_column(at, names[at], pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digest(spans: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
