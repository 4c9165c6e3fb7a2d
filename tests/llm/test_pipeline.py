"""The pipeline against its stages written out row by row."""

from __future__ import annotations

import re

import corpus_pipeline
from test_decontaminate import _brute as leaks
from test_near import _brute as links
from test_packing import _ids
from test_quality import _counts
from vitalspan.llm import secrets
from vitalspan.session import settle

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, docs, SF))
        got = {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns and len(got) == out.count()
        if name == "quality rules":
            counts = {i: _counts(r.text) for i, r in rows.items()}
            want = {i: rows[i] for i, c in counts.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
        elif name == "near duplicates":
            own = [(i, rows[i].text) for i in sorted(rows)]
            roots = links(own)[1]
            least = {r: min(i for (i, _), s in zip(own, roots, strict=True) if s == r) for r in set(roots)}
            want = {i: rows[i] for i in least.values()}
        elif name == "benchmark decontamination":
            own = sorted(rows)
            bad = {own[p] for p, _ in leaks([rows[i].text for i in own], items)}
            want = {i: r for i, r in rows.items() if i not in bad}
        else:
            formats = secrets.fit(docs)
            want = {}
            for i, r in rows.items():
                text = re.sub(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}"?""",
                              lambda m: "[SECRET]" + ('"' if m[0].endswith('"') else ""), r.text)
                assert not secrets.base_spans(got[i].text) and secrets.redact_text(r.text, formats, "[SECRET]") == got[i].text
                assert got[i].text == text or secrets.HEX.search(text) or secrets.ACCESS.search(text)
                assert got[i].n_chars == (len(got[i].text) if got[i].text != r.text else r.n_chars)
                want[i] = got[i]
        assert got == want
        docs, rows = out, got
    pieces = corpus_pipeline.packed(spark, docs, SF).collect()
    tokens = {i: len(_ids(r.text)) for i, r in rows.items()}
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in rows} == tokens
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset", "start", "length", "ids_crc32", "continues", "continued").distinct().collect())) \
        == sorted(tokens.items())


def test_empty_and_odd_documents(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name
        assert stage(spark, odd_docs, SF).count() >= 0, name
