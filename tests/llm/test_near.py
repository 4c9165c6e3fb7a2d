"""Near duplicates against all pairs of shingle sets."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from vitalspan.llm import near


def _sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _brute(rows):
    """Links of each row and the component of each, by all pairs."""
    sets = _sets([t for _, t in rows])
    links, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    return links, [find(i) for i in range(len(rows))]


def _check(rows, found):
    links, root = _brute(rows)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, least[r], links[k]) for k, ((i, _), r) in enumerate(zip(rows, root, strict=True)))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == want
    return least


def _variants(rng, n):
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_equals_all_pairs(docs, spark):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rng = random.Random(1)
    rows += [(10000 + i, t) for i, t in enumerate(_variants(rng, 60) + _variants(rng, 2) + ["a b c", "a b c", "a b d", "a", None, "", " "])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    least = _check(rows, near.join_classes(table).collect())
    assert sorted(r.doc_id for r in near.keep_first(table).collect()) == sorted(least.values())


def test_target_recall():
    depth = near.prefix_depth()
    assert near.recall(0.8, near.TREES, depth) >= near.TARGET_RECALL > near.recall(0.8, near.TREES, depth + 1)


def test_blocks_of_large_groups():
    rng = random.Random(2)
    texts = _variants(rng, 90)
    sets = _sets(texts)
    codes = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    members = [(k % 3, f"{k:03d}".encode(), 1, [5], np.array(sorted(codes[g] for g in s), np.uint64).tobytes()) for k, s in enumerate(sets)]
    links = Counter()
    for a in range(3):
        for b in range(a, 3):
            for node, n, _ in near._links((5, a, b), [m for m in members if m[0] in (a, b)], 0.8):
                links[node] += n
    want, _ = _brute(list(enumerate(texts)))
    # equal texts are one node in the operator; here each is a node of its own, linked with similarity 1
    assert {members[k][1]: n for k, n in want.items() if n} == dict(links)


@pytest.mark.parametrize("edges", [[], [(i, i - 1) for i in range(1, 40)], [(5, 1), (5, 2), (9, 2), (8, 7), (3, 3)]])
def test_components(spark, edges):
    table = spark.createDataFrame([(f"{u:03d}".encode(), f"{v:03d}".encode()) for u, v in edges], "u binary, v binary")
    got = {int(r.node): int(r.root) for r in near.components(table).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert got == {n: r for n, r in label.items() if n != r}


def test_odd_tables(spark, odd_docs, no_docs):
    assert near.join_classes(no_docs).count() == 0 and near.keep_first(no_docs).count() == 0
    rows = {(r.doc_id, r.class_id, r.n_links) for r in near.join_classes(odd_docs).collect()}
    assert rows == {(0, 0, 2), (4, 0, 2), (1, 1, 1), (2, 1, 1), (3, 3, 0), (None, None, 0), (6, 6, 0), (7, 7, 0)}
    kept = near.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 6
    clash = odd_docs.selectExpr("doc_id", "text", "1 AS node", "2 AS class_id", "3 AS links")
    assert near.keep_first(clash).columns == clash.columns and near.keep_first(clash).count() == 6
