"""Language scores: the base against counts word by word, the model against plain loops and as a distribution."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from vitalspan.llm import attention, language

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _words(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", small)


def _held(id):
    return zlib.crc32(str("" if id is None else id).encode()) % 10 == 0


def _base(rows):
    counts = Counter(w for i, t in rows if not _held(i) for w in _words(t))
    ends = sum(not _held(i) for i, _ in rows)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    chance = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    return sorted(((str(i), _held(i), len(_words(t)) + 1, sum(counts[w] > 0 for w in _words(t)) + (ends > 0), n,
                    round(sum(chance(counts[w]) for w in _words(t)) + chance(ends), 6)) for i, t in rows))


def _check_base(docs):
    got = language.score_documents(docs, PATH, PATTERN, rounds=1).collect()
    want = _base([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return got


def test_base_of_given_documents(docs):
    _check_base(docs)


def test_odd_documents(spark, odd_docs, no_docs):
    got = _check_base(odd_docs)
    assert len({round(r.score, 6) for r in got if r.n_tokens == 1}) == 1  # null, empty and white space alike
    assert language.score_documents(no_docs, PATH, PATTERN).count() == 0
    held = next(i for i in range(100) if _held(i))
    only = spark.createDataFrame([(held, "a b", "x", 1.0)], "doc_id bigint, text string, score string, slice double")
    row = _check_base(only)[0]
    assert row.n_known == 0 and row.train_tokens == 0


def _slow(model, inputs, nexts):
    """One window after the other, one position after the other."""
    out = 0.0
    start = 0
    while True:
        ids = inputs[start : start + attention.WINDOW]
        x = model.embed[ids]
        at = x + model.place[: len(ids)]
        q, k, v = at @ model.query, at @ model.key, x @ model.value
        for i in range(0 if start == 0 else attention.WINDOW - attention.STEP, len(ids)):
            weight = np.exp(k[: i + 1] @ q[i] / math.sqrt(attention.WIDTH))
            mix = np.exp(model.gate[ids[i]] + (weight / weight.sum()) @ v[: i + 1] @ model.out)
            out += math.log10(float((mix / mix.sum()) @ model.spread[nexts[start + i]]))
        if start + attention.WINDOW >= len(inputs):
            return out
        start += attention.STEP


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    spread = rng.random((40, attention.MIXTURE)).astype(np.float32)
    return attention.Model.start(40, rng.integers(0, attention.MIXTURE, 40), spread / spread.sum(axis=0))


def test_windows_against_loops(model):
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, attention.WINDOW, attention.WINDOW + 1, 3 * attention.WINDOW + 7, 2, 500])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    inputs, nexts = rng.integers(0, 40, starts[-1]), rng.integers(0, 40, starts[-1])
    got = attention.log_likelihoods(attention.Pass(model), inputs, nexts, starts)
    want = [_slow(model, inputs[a:b], nexts[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    assert np.allclose(got, want, rtol=1e-4)


def test_probabilities_add_up(model):
    ids = np.arange(attention.WINDOW)[None, :] % 40
    total = sum(attention.Pass(model).forward(ids, np.full_like(ids, i))[0] for i in range(40))
    assert np.allclose(total, 1, atol=1e-4)


def test_gradients(model):
    """A small step along each gradient raises the likelihood by what the gradient says."""
    rng = np.random.default_rng(2)
    ids, nexts = rng.integers(0, 40, (4, attention.WINDOW)), rng.integers(0, 40, (4, attention.WINDOW))
    real = np.arange(attention.WINDOW)[None, :] < np.array([[attention.WINDOW], [7], [1], [20]])
    wide = lambda m: type(m)(**{k: v.astype(np.float64) for k, v in vars(m).items()})

    class Probe(attention.Learner):
        def _step(self, name, gradient, rows=slice(None)):
            full = np.zeros_like(getattr(self.model, name))
            full[rows] = gradient
            found[name] = full

    found = {}
    start = wide(model)
    Probe(start).learn(ids, nexts, real)

    def total(m):
        return float(np.log(attention.Pass(m).forward(ids, nexts)[0])[real.ravel()].sum()) / math.sqrt(real.sum())

    for name, gradient in found.items():
        way = rng.normal(size=gradient.shape)
        up, down = (type(start)(**{**vars(start), name: getattr(start, name) + e * way}) for e in (1e-5, -1e-5))
        assert math.isclose((total(up) - total(down)) / 2e-5, float((gradient * way).sum()), rel_tol=1e-3, abs_tol=1e-5), name


def test_large_weights_stay_finite(model):
    """Logits far above and far below what a plain exponential can hold."""
    rng = np.random.default_rng(7)
    ids, nexts = rng.integers(0, 40, (3, attention.WINDOW)), rng.integers(0, 40, (3, attention.WINDOW))
    for gate, size in ((500, 30), (-500, 30), (0, 300)):
        wild = type(model)(**{k: v.copy() for k, v in vars(model).items()})
        wild.gate += gate
        wild.query *= size
        wild.out *= size
        ready = attention.Pass(wild)
        assert not ready.bounded
        found = ready.likelihoods(ids, nexts)
        assert np.isfinite(found).all() and np.allclose(found, ready.forward(ids, nexts)[0], rtol=1e-3, atol=1e-6)
        learner = attention.Learner(wild)
        for _ in range(3):
            learner.learn(ids, nexts, np.ones(ids.shape, dtype=bool))
        assert all(np.isfinite(v).all() for v in vars(wild).values()) and np.isfinite(learner.counts).all()


def test_training_raises_held_out_likelihood(docs):
    size = 50257
    parts = language.slices(docs, PATH, PATTERN)
    mean = [language.score(parts, language.fit(parts, size, rounds), language.word_counts(parts)).where("held_out").groupBy().sum("score").first()[0]
            for rounds in (0, 2)]
    assert mean[1] > mean[0]


def test_spelling_is_word_by_word():
    with open(PATH) as f:
        speller = language.Speller(f.read(), PATTERN)
    words = ["the", "o'clock,", "été", " ", "a b", "x ", "<|endoftext|>", "'s", "123abc", "\x1c", "!!"]
    ids, lengths = speller.spell(pa.array(words))
    at = np.concatenate([[0], np.cumsum(lengths)])
    assert [speller.encoding.decode(ids[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)] == [f" {w}" for w in words]


def test_every_training_window_is_learned_from(docs):
    """The windows of all rounds together are those of all documents that are not held out, each once."""
    from vitalspan.llm.attention import WINDOW, windows

    size = 50257
    parts = language.slices(docs, PATH, PATTERN)
    wanted = 0
    for row in parts.collect():
        read = language._read(row.asDict(), size, None)
        lengths = np.diff(read.starts)
        text, first, _ = windows(lengths)
        wanted += int(np.minimum(WINDOW, lengths[text] - first)[read.learn[text]].sum())
    send = docs.sparkSession.sparkContext.broadcast
    rows, group = np.arange(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    model = send(attention.Model.start(size, group, np.full((size, attention.MIXTURE), 1 / size, dtype=np.float32)))
    texts = parts.select("slice", "learn", "starts", "codes", "lengths", "pieces")
    met = 0
    for r in range(language.ROUNDS):
        found = texts.mapInArrow(language._train(size, send(rows), model, r, language.ROUNDS, 1), language._PARTS).where("key = -1")
        met += sum(int(np.frombuffer(x["values"], "<f4")[-1]) for x in found.collect())
    assert met == wanted > 0


def test_a_task_holds_one_slice_at_a_time(docs, monkeypatch):
    """Slices of one task are row groups and batches of their own, so that memory does not follow how many a task has."""
    import pyarrow.parquet as pq

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = docs.sparkSession.conf.get(key)
    monkeypatch.setattr(language, "SLICE_BYTES", 20_000)
    parts = language.slices(docs.coalesce(1), PATH, PATTERN)
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")) for f in parts.inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert len(groups) > 3 and set(groups) == {1}

    def one_by_one(make):
        def made(*args):
            run = make(*args)

            def watched(batches):
                for batch in batches:
                    assert batch.num_rows == 1
                    yield batch

            return lambda batches: run(watched(batches))
        return made

    for name in ("_count_ids", "_count_followers", "_train"):
        monkeypatch.setattr(language, name, one_by_one(getattr(language, name)))
    trained = language.fit(parts, 50257, 1)
    assert docs.sparkSession.conf.get(key) == before
    assert language.score(parts, trained, language.word_counts(parts)).count() == docs.count()


def test_slices_are_put_together_from_small_batches():
    """Slices follow the bytes of text, not the batches in which documents come; nothing is lost or reordered."""
    texts = ["a" * n for n in (10, 0, 30, 5, 200, 7, 7, 90, 1)] + [None, "b" * 60]
    whole = pa.record_batch({"_id": list(range(len(texts))), "_text": pa.array(texts, pa.string())})
    for rows in (1, 2, 4, 100):
        batches = [whole.slice(i, rows) for i in range(0, len(texts), rows)]
        got = list(language._gathered(iter([whole.slice(0, 0), *batches]), "_text", 100))
        assert [i for b in got for i in b.column("_id").to_pylist()] == list(range(len(texts)))
        assert [t for b in got for t in b.column("_text").to_pylist()] == texts
        assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column("_text").to_pylist()) <= 100 for b in got)
    assert [b.num_rows for b in language._gathered(iter([whole.slice(i, 1) for i in range(len(texts))]), "_text", 100)] == [4, 1, 2, 3, 1]
    assert list(language._gathered(iter([]), "_text", 100)) == []
