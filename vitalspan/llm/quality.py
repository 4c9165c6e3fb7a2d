"""Quality rules by host: rule failures are counted per host, shrunk towards the corpus by a beta prior, and joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.texts import sliced, split_lines, split_words, sums
from vitalspan.session import settle

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if the shrunk rate of one of the rules exceeds this.
MAX_HOST_RATE = 0.8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts over whole texts; null and empty texts count 0 everywhere."""
    words = split_words(texts)
    n_words = np.diff(words.starts)
    lengths = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.fill_null(pc.count_substring_regex(texts, SYMBOLS), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = split_lines(texts)
    spoken = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines.vocabulary)), 0).to_numpy(zero_copy_only=False)[lines.codes]
    rows, codes = lines.rows[spoken], lines.codes[spoken]
    size = max(1, len(lines.vocabulary))
    distinct = np.unique(rows * size + codes) // size
    n = len(n_words)
    return {
        "n_words": n_words, "word_chars": sums(lengths[words.codes], words.starts), "n_symbols": symbols,
        "n_dup_lines": np.bincount(rows, minlength=n) - np.bincount(distinct, minlength=n),
        "n_repeat_words": _repeated(words.codes, words.starts, words.rows),
    }


def _repeated(codes: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words of each row in three-word windows that the row has twice or more."""
    inner = np.zeros(len(codes), dtype=bool)
    if len(codes) >= 3:
        size = int(codes.max()) + 1
        _, pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)
        _, thirds = np.unique(pairs[:-1] * size + codes[2:], return_inverse=True)
        whole = rows[:-2] == rows[2:]
        key = rows[:-2] * (int(thirds.max()) + 1) + thirds
        _, which, counts = np.unique(key[whole], return_inverse=True, return_counts=True)
        twice = np.zeros(len(codes) - 2, dtype=bool)
        twice[whole] = counts[which] >= 2
        for i in range(3):
            inner[i : len(codes) - 2 + i] |= twice
    return sums(inner, starts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "_text"):
        counts = text_counts(batch.column("_text"))
        rest = [(name, c) for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_text"]
        yield pa.RecordBatch.from_arrays(
            [c for _, c in rest] + [pa.array(counts[k], pa.int64()) for k in COUNTS], [name for name, _ in rest] + list(COUNTS))


RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
}


def measure(docs: DataFrame, text: str, carried: list[str]) -> DataFrame:
    """The carried columns, the counts of each whole text, and one boolean a rule that tells whether it fails."""
    source = docs.select(*carried, F.col(text).cast("string").alias("_text"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text"]
    counted = source.mapInArrow(_counted, ", ".join(types + [f"{k} bigint" for k in COUNTS]))
    return counted.withColumns({f"fails_{name}": F.expr(rule) for name, rule in RULES.items()})


def host_verdicts(measured: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host whether it is rejected: (verdict_host, host_docs, host_rate, host_rejected).

    Failures of each rule are summed by host and shrunk with a beta prior whose mean and strength are those of the
    hosts' rates by the method of moments, each host counting once. Where all rates are equal the prior's mean is each
    host's rate. ``host_rate`` is the largest shrunk rate of a rule. Hosts are aggregated before the shuffle.
    """
    hosts = measured.groupBy(F.col(host).alias("verdict_host")).agg(
        F.count(F.lit(1)).alias("host_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES))
    share = {r: F.col(r) / F.col("host_docs") for r in RULES}
    moments = hosts.agg(*(f(x).alias(f"{m}_{r}") for r, x in share.items() for m, f in (("mean", F.avg), ("var", F.var_pop))))
    joined = hosts.crossJoin(F.broadcast(moments))  # one row
    rates: list[Column] = []
    for r in RULES:
        mean, var = F.col(f"mean_{r}"), F.col(f"var_{r}")
        strength = F.greatest(F.try_divide(mean * (1 - mean), var) - 1, F.lit(0.0))
        rates.append(F.coalesce((F.col(r) + mean * strength) / (F.col("host_docs") + strength), mean))
    rate = F.greatest(*rates)
    return joined.select("verdict_host", "host_docs", rate.alias("host_rate"), (rate > max_rate).alias("host_rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", carried: list[str] | None = None,
          max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The carried columns (default: all but the text) with the counts, ``base_failed`` and ``kept``.

    A document fails the base rules with fewer than 50 words or more than half of its words in repeated three-word
    windows. ``kept`` is false for these and for all documents of a host whose shrunk failure rate of some rule exceeds
    ``max_rate``. Null and empty texts have no words and fail. A null host is a host of its own. An empty table gives an
    empty one, repeated rows are judged each, a column that has the name of an added one gives way to it, and one
    whose name begins with an underscore is not carried.
    """
    added = {*COUNTS, "base_failed", "kept", "host_rate"}
    carried = [c for c in (docs.columns if carried is None else carried) if c != text and c not in added and c[:1] != "_"]
    inner = {c: f"_c{i}" for i, c in enumerate(carried)}
    own = docs.select(*(F.col(c).alias(n) for c, n in inner.items()), F.col(host).alias("_host"), F.col(text).alias("_raw"))
    measured = settle(measure(own, "_raw", [*inner.values(), "_host"]))
    hosts = host_verdicts(measured, "_host", max_rate)
    failed = F.col("fails_short") | F.col("fails_repetitive")
    return measured.join(hosts, F.col("_host").eqNullSafe(F.col("verdict_host")), "left").select(
        *(F.col(n).alias(c) for c, n in inner.items()), *COUNTS, "host_rate", failed.alias("base_failed"),
        (~failed & ~F.col("host_rejected")).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns.

    Texts stay where they were read: the second pass over them needs the verdicts of hosts alone, whose table is
    written first so that the planner knows its size. Null and empty texts fail, null hosts are one host, repeated rows
    are kept or go together, an empty table gives an empty one, and columns of any name stay as they are.
    """
    measured = settle(measure(docs.select(F.col(host).alias("_host"), F.col(text).alias("_raw")), "_raw", ["_host"]))
    rejected = settle(host_verdicts(measured, "_host", max_rate).where("host_rejected").select("verdict_host"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names).withColumns({"_raw": F.col(names[docs.columns.index(text)])})
    judged = measure(own, "_raw", names).where("NOT fails_short AND NOT fails_repetitive")
    kept = judged.join(rejected, F.col(names[docs.columns.index(host)]).eqNullSafe(F.col("verdict_host")), "left_anti")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
