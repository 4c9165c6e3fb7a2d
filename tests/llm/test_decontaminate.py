"""Leaks against exhaustive BM25 scores and plain containment."""

from __future__ import annotations

import math
from collections import Counter

from vitalspan.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


def _brute(texts, items):
    """(row, item) pairs by scoring every passage against every item."""
    bags = {i: Counter(d.plain_words(t)) for i, t in items if d.plain_words(t)}
    spread = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    idf = {w: math.log1p((len(bags) - n + 0.5) / (n + 0.5)) for w, n in spread.items()}
    impact = {i: {w: idf[w] * n * (d.K1 + 1) / (n + d.K1 * (1 - d.B + d.B * sum(b.values()) / mean)) for w, n in b.items()}
              for i, b in bags.items()}
    step = max(sum(b.values()) for b in bags.values())
    out = set()
    for row, text in enumerate(texts):
        words = d.plain_words(text)
        for i, own in impact.items():
            scores = [sum(own.get(w, 0) for w in set(words[a : a + 2 * step])) for a in range(0, max(1, len(words) - step), step)]
            item = d.Item(i, *map(d.grams, d.parts(dict(items)[i])))
            if max(scores, default=0) >= d.MIN_SCORE_SHARE * sum(own.values()) and d.contaminated(*d.overlap(item, words), item):
                out.add((row, i))
    return out


def test_search_equals_exhaustive_scores(docs, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = docs.orderBy("doc_id").collect()
    planted = [f"{rows[k].text[:200]} {t} {rows[k + 1].text}" for k, (_, t) in enumerate(items[:20])]
    edited = [" ".join(w for j, w in enumerate(t.split()) if j != 3) for _, t in items[:10]]
    texts = [r.text for r in rows] + planted + edited + [None, "", "\n"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in d.matches(table, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert found == _brute(texts, items)
    assert {(len(rows) + k, items[k][0]) for k in range(20)} <= found
    left = {r.doc_id for r in d.clean(table, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert left == set(range(len(texts))) - {p for p, _ in found}


def test_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "five six seven eight nine ten"), (4, "?"), (5, "long")], "item_id int, text string")
    got = sorted((r.doc_id, r.item_id, r.n) for r in d.matches(odd_docs, items).groupBy("doc_id", "item_id").count().withColumnRenamed("count", "n").collect())
    assert got == [(0, 3, 1), (4, 3, 2), (6, 5, 1)]
    empty = spark.createDataFrame([], "item_id int, text string")
    assert d.matches(odd_docs, empty).count() == 0 and d.matches(no_docs, items).count() == 0
    assert d.clean(odd_docs, empty).count() == odd_docs.count() and d.clean(no_docs, items).count() == 0
    clash = odd_docs.selectExpr("doc_id", "text", "1 AS item_id", "2 AS bm25")
    assert d.matches(clash, items).count() == 4 and d.clean(clash, items).columns == clash.columns
