"""Exact neighbours, held-out accuracy, and odd tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from vitalspan.llm import toxicity as t


def _examples(rng, n):
    return [(i, int(rng.random() < 0.4), *map(list, zip(*sorted({rng.randrange(60): rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))}.items()), strict=True)))
            for i in range(n)]


def test_neighbours_are_exact():
    rng = random.Random(4)
    idf = np.array([1 + rng.random() for _ in range(60)])
    examples = _examples(rng, 700)
    index = t.ExampleIndex({str(i): i for i in range(60)}, idf, examples, 0.4)
    dense = np.zeros((len(index.ids), 60))
    by_id = {e[0]: e for e in examples}
    for row, i in enumerate(index.ids.tolist()):
        _, _, terms, often = by_id[i]
        dense[row, terms] = (1 + np.log(often)) * idf[terms]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for _, _, terms, often in _examples(rng, 80):
        near, cosine = index.nearest(np.array(terms), np.array(often))
        query = np.zeros(60)
        query[terms] = (1 + np.log(often)) * idf[terms]
        true = dense @ (query / np.linalg.norm(query))
        want = np.sort(true[true > 1e-12])[::-1][: t.NEIGHBOURS]
        np.testing.assert_allclose(cosine, want)
        np.testing.assert_allclose(true[near], cosine)


def test_all_parts_of_the_index(monkeypatch):
    monkeypatch.setattr(t, "BLOCK_EXAMPLES", 8)
    monkeypatch.setattr(t, "HEAD_TERMS", 20)
    for few in (0, 10**9):  # remaining blocks by themselves, or all of them together
        monkeypatch.setattr(t, "FEW_BLOCKS", few)
        test_neighbours_are_exact()


def _corpus(spark, n):
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words, toxic = rng.choices(plain, k=60), int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words[rng.randrange(60)] = rng.choice(["nastya", "nastyb", "vilest."])
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_held_out_documents(spark):
    docs = _corpus(spark, 1500)
    held = t.is_held_out(docs.doc_id)
    model = t.fit(docs.select("doc_id", "text"), docs.where(~held).select("doc_id", "toxic"))
    assert {"vilest", "nasty~"} <= set(model.index.terms)
    rows = t.score(docs.where(held), model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([(r.score >= 0.5) == r.toxic for r in rows]) > 0.98
    assert all(e.label == 1 for r in rows if r.toxic for e in r.evidence[:1])


def test_every_example_and_term_counts(spark):
    docs = _corpus(spark, 300)
    twin = docs.where("doc_id < 20").selectExpr("doc_id + 1000 AS doc_id", "text")  # most have no telling term at all
    model = t.fit(docs.select("doc_id", "text").union(twin), docs.select("doc_id", "toxic"))
    assert sorted(model.index.ids.tolist()) == list(range(300))
    assert {f"word{i}" for i in range(400)} <= set(model.index.terms)
    for r in t.score(twin, model).collect():
        assert r.evidence[0].id == r.doc_id - 1000 and abs(r.evidence[0].cosine - 1) < 1e-9 and len(r.evidence) == t.NEIGHBOURS


def test_rows_with_a_shared_passage_stay_examples(spark):
    shared, rng = " ".join(f"same{i}" for i in range(30)), random.Random(2)
    own = [" ".join(rng.choices([f"word{i}" for i in range(400)], k=20)) for _ in range(60)]
    rows = [(i, f"{shared} {x}", i % 2) for i, x in enumerate(own)] + [(100 + i, "equal texts are votes each", 1) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = t.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert sorted(model.index.ids.tolist()) == sorted(r[0] for r in rows) and abs(model.index.base - 39.1 / 70) < 1e-9
    near = t.score(docs.where("doc_id = 104"), model).collect()[0]
    assert [e.id for e in near.evidence if e.cosine > 0.999] == list(range(100, 109)) and near.score > 0.9


def test_terms():
    row, term, often, names = t.document_terms(pa.array(["Idiots, idiots! a", None, "", "... idiotic"]))
    found = {(r, names[k].as_py()): n for r, k, n in zip(row.tolist(), term.tolist(), often.tolist(), strict=True)}
    assert found == {(0, "idiots"): 2, (0, "idiot~"): 2, (0, "a"): 1, (3, "idiotic"): 1, (3, "idiot~"): 1}
    known = t.Terms(pa.array(["idiot~", "a"]))
    row, term, often, _ = t.document_terms(pa.array(["Idiots, idiotic! a", "a A", "b"]), known)
    assert list(zip(row.tolist(), term.tolist(), often.tolist(), strict=True)) == [(0, 0, 2), (0, 1, 1), (1, 1, 2)]


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (4, 0), (4, 1), (7, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    empty = labels.limit(0)
    for docs, own in ((odd_docs, labels), (odd_docs, empty), (no_docs, labels)):
        model = t.fit(docs, own)
        scored = t.score(odd_docs, model).collect()
        assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
        assert t.score(no_docs, model).count() == 0
    assert t.score(spark.createDataFrame([("x", 5)], "text string, score int"), model).collect()[0].score < 0.5
