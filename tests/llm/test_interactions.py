"""Filter interactions against documents sent through every order one by one."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

from vitalspan.llm import interactions


def _plain(docs, labels):
    first = {}
    for d in docs:
        if d.doc_id is not None:
            first[d.text or ""] = min(first.get(d.text or "", d.doc_id), d.doc_id)
    out = defaultdict(lambda: [0] * 6)
    for d in docs:
        text, words = d.text or "", re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": d.doc_id is not None and d.doc_id > first[text]}
        good = any(r.quality == 1 for r in labels if r.doc_id == d.doc_id and d.doc_id is not None)
        bad = any(r.toxic == 1 for r in labels if r.doc_id == d.doc_id and d.doc_id is not None)
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                gone = any(fails[g] for g in order[:i])
                lost = fails[f] and not gone
                row = out[d.source or "", "".join(order), i + 1]
                for j, holds in enumerate((not gone and not fails[f], lost, fails[f] and gone, fails[f] and sum(fails.values()) == 1,
                                           lost and good, lost and bad)):
                    row[j] += holds
    shapley = defaultdict(int)
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return sorted((*k, *row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items())


def _check(docs, labels):
    got = sorted(tuple(r) for r in interactions.audit(docs, labels).collect())
    assert got == _plain(docs.collect(), labels.collect())


def test_given_documents(spark, docs):
    _check(docs.limit(80), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, None), (4, None, 1), (None, 1, 1), (2, 0, 0), (6, 1, 1)], "doc_id bigint, quality int, toxic int")
    _check(odd_docs, labels)
    assert interactions.audit(no_docs, labels).count() == 0
    _check(odd_docs, labels.where("false"))


def test_copies_and_clashing_columns(spark):
    text = " ".join(f"word{i}" for i in range(250))
    rows = [(i, text if i % 3 else f"{text} $", f"s{i % 2}", "x", 5, True, "y") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mask string, n int, good boolean, part string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "z") for i in range(60)], "doc_id bigint, quality int, toxic int, n string")
    _check(docs, labels)


def test_fields_hold_longs():
    whole = (1 << 62) * interactions.packed(31, True, True) + 5 * interactions.packed(0, False, False)
    fields = interactions.unpacked(whole)
    assert fields[0].tolist() == [5, 1 << 62, 0, 1 << 62, 1 << 62] and fields[4].tolist() == [5, 0, 1 << 62, 0, 0]
