"""Helpers of the package's tests: tables with odd rows, given the operators' columns."""

from __future__ import annotations

import pytest

ODD_DOCS = [
    (0, "one two three four five six seven eight nine ten", "en", "src0", 48),
    (1, None, None, None, None),
    (2, "", "en", "src0", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "", 7),
    (4, "one two three four five six seven eight nine ten", "en", "src1", 48),
    (4, "one two three four five six seven eight nine ten", "en", "src1", 48),
    (None, "ein Wort ist kein Wort <|endoftext|> \U0001f600 été\x1cund İstanbulΣ", "de", "src1", 40),
    (6, "long " * 30000 + "end", "en", "src2", 150003),
    (7, "a\na\n\na\nb  b", "en", "src2", 11),
]
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD_DOCS, DOC_SCHEMA).repartition(3, "lang")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
