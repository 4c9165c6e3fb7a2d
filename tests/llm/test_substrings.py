"""Removed words against every window looked up in a dictionary."""

from __future__ import annotations

import re

import pytest

from vitalspan.llm import substrings


def _brute(rows, size):
    """(id, words, removed, kept) of each row."""
    split = [(i if i is not None else -(2**63), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict = {}
    for i, words in split:
        for s in range(len(words) - size + 1):
            key = tuple(words[s : s + size])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (own, _), (i, words) in zip(rows, split, strict=True):
        gone = {k for s in range(len(words) - size + 1) if first[tuple(words[s : s + size])] < (i, s) for k in range(s, s + size)}
        out.append((own, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(map(repr, out))


def _run(docs, size, anchor):
    left = substrings.remove_repeats(docs, carried=["doc_id"], size=size, anchor_words=anchor)
    return sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in left.collect())


@pytest.mark.parametrize(("size", "anchor"), [(20, 8), (5, 2), (3, 3)])
def test_equals_brute_force(docs, odd_docs, spark, size, anchor):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(r.doc_id if r.doc_id is None else r.doc_id + 10000, r.text) for r in odd_docs.collect()]
    passage = " ".join(f"p{i}" for i in range(70))
    rows += [(20000 + i, f"w{i} {passage[i % 40:]} v{i}") for i in range(50)] + [(20001, "other text " + passage), (5, rows[3][1])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert _run(table, size, anchor) == _brute(rows, size)


def test_empty_and_clashing_columns(spark, no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id int, text string, n_words int, kept string")
    row = substrings.remove_repeats(docs).collect()[0]
    assert row.asDict() == {"doc_id": 1, "n_words": 2, "n_removed": 0, "kept": "a b"}
