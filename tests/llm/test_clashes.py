"""Columns that have the names operators use inside do no harm."""

from __future__ import annotations

import public_tokenizers
import pytest

from vitalspan.llm import decontaminate, near, packing, quality, secrets, substrings, toxicity

NAMES = ["_text", "_id", "_node", "_host", "_raw", "_key", "_c0", "_of", "_toxic", "_factors", "_part", "node", "id", "labels", "host",
         "verdict_host", "n_words", "spans", "score", "start", "ids", "kept", "block", "term", "class_id", "copies", "bucket", "root"]


@pytest.fixture(scope="module")
def clashing(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words if i else None, "en", "src0", 5, *(f"x{i}" for _ in NAMES)) for i in range(3)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


def test_operators(spark, clashing):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7")], "item_id int, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    formats = secrets.fit(clashing)
    assert secrets.scan(clashing, formats).count() == 3
    assert near.join_classes(clashing).count() == 3
    assert toxicity.score(clashing, toxicity.fit(clashing, labels)).count() == 3
    assert packing.pack(clashing, public_tokenizers.path("word_bpe_49k.json")).count() == 3
    assert substrings.remove_repeats(clashing).count() == 3
    assert quality.judge(clashing).count() == 3
    assert decontaminate.matches(clashing, items).count() == 2
    for kept, n in ((secrets.redact(clashing, formats, length="n_chars"), 3), (near.keep_first(clashing), 2), (quality.keep_good(clashing), 2),
                    (decontaminate.clean(clashing, items), 1)):
        assert kept.columns == clashing.columns and kept.count() == n
