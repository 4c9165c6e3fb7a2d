"""Quality rules against counts written word by word, and the verdicts of hosts."""

from __future__ import annotations

import re
from collections import Counter

from vitalspan.llm import quality


def _counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] >= 2 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts(docs, odd_docs):
    for table in (docs, odd_docs):
        want = sorted((str(r.doc_id), _counts(r.text)) for r in table.collect())
        got = sorted((str(r.doc_id), tuple(r[c] for c in quality.COUNTS)) for r in quality.judge(table).collect())
        assert got == want


def test_hosts_of_mostly_bad_documents_are_rejected(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 4 else "short", f"h{i % 20}") for i in range(2000)]
    rows += [(5000 + i, "bad", "spam") for i in range(300)] + [(6000, good, "spam"), (6001, "one bad", "new"), (6002, good, "new")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept == {i for i, t, h in rows if t == good and h != "spam"}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept


def test_odd_tables(spark, odd_docs, no_docs):
    assert quality.judge(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0
    assert {(r.doc_id, r.base_failed) for r in quality.judge(odd_docs).where("NOT base_failed").collect()} == set()
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "s", "x", 5)], "doc_id int, text string, source string, kept string, n_words int")
    assert quality.judge(docs).collect()[0].kept is True
    assert quality.keep_good(docs).collect()[0].kept == "x"
