"""Packing against the tokenizer run on whole texts, and the round trip of the stream."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitalspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def _ids(text: str | None) -> list[int]:
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("window", [4096, 64])
def test_pieces_join_to_whole_documents(docs, odd_docs, window):
    both = docs.unionByName(odd_docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    rows = packing.pack(both, PATH, carried=["doc_id"], window=window).collect()
    texts: dict = {}
    for r in both.collect():
        texts.setdefault(r.doc_id, []).append(_ids(r.text))
    stream: dict = {}
    joined: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length and r.offset == stream.get(r.sequence_id, 0)
        assert r.continues == (r.start > 0) and r.continued == (r.start + r.length < r.doc_tokens)
        stream[r.sequence_id] = r.offset + r.length
        joined.setdefault(r.doc_id, []).extend(ids)
    assert {k: len(v) for k, v in joined.items()} == {k: sum(map(len, v)) for k, v in texts.items()}
    for k, v in texts.items():
        assert joined[k] == [i for ids in v for i in ids]
    full = max(stream)
    assert sorted(stream) == list(range(full + 1)) and all(stream[s] == window for s in range(full))


def test_sequences_are_padded_unless_a_power_of_two(spark):
    docs = spark.createDataFrame([(1, "the " * 9), (2, "the " * 5)], "doc_id bigint, text string").coalesce(1)
    out = {r.sequence_id: r for r in packing.sequences(packing.pack(docs, PATH, window=6), 6).collect()}
    assert [out[i].n_tokens for i in range(3)] == [6, 6, 4] and len(out[2].ids) == 16
    docs = spark.createDataFrame([(1, "the " * 8)], "doc_id bigint, text string")
    out = {r.sequence_id: r for r in packing.sequences(packing.pack(docs, PATH, window=6), 6).collect()}
    assert out[1].n_tokens == 3 and np.frombuffer(out[1].ids, "<u4").tolist()[3:] == [0, 0, 0]


def test_no_rows_and_clashing_columns(spark, no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
    docs = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id bigint, text string, start int, _tokens string")
    row = packing.pack(docs, PATH).collect()[0]
    assert (row.doc_id, row.start, row.doc_tokens) == (1, 0, 3)


def test_words_are_encoded_as_in_whole_texts(spark):
    import pyarrow as pa

    texts = ["The the. THE,, don't it's' ÉTÉ! été\u0301. e\u0301! Straße; STRASSE ÿ- Ÿ\u00d7\u00f7 a\u0130b. <|endoftext|>. x<|startoftext|>",
             "a\u00a0b\u2003c d\x1ce 12,34 a1! 日本語。 日本語! 🙂!! ### $$$x 'll 's the's \u01c5. ﬁ! ǰ̌.", "", None]
    known = packing.WordEncoder(open(PATH).read())
    for _ in range(2):
        ids, starts = known.encode(pa.array(texts), 2)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [_ids(t) for t in texts]
