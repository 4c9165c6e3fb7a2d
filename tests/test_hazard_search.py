"""Stacked sparse hazard fits against dense Newton steps and against SQL-like sums."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspan.operators import features as X
from vitalspan.operators import hazard as Z
from vitalspan.operators import hazard_search as S


def _data(spark, n=240, width=6, intervals=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.3, rng.normal(1, 1, (n, width)), 0.0)
    x[:, -1] = 0
    x[3, -1] = 2.0  # a feature of one patient
    last = rng.integers(0, intervals + 1, n)
    died = [[bool(i == t and rng.random() < 0.7) for i in range(intervals)] for t in last]
    survived = [[bool(i < t or (i == t and not d[i] and rng.random() < 0.5)) for i in range(intervals)] for t, d in zip(last, died)]
    long = spark.createDataFrame([(p, f"f{j}", float(v)) for p, row in enumerate(x) for j, v in enumerate(row) if v], "pid long, feature string, value double")
    vocabulary = spark.createDataFrame([(f"f{j}", j) for j in range(width)], "feature string, column_index int")
    labels = spark.createDataFrame([(p, d, s, p % 3) for p, (d, s) in enumerate(zip(died, survived))], "pid long, died array<boolean>, survived array<boolean>, fold int")
    return x, np.array(died, float), np.array(survived, float), long, vocabulary, labels


def _newton(x, died, survived, reg):
    """All intervals of one model by dense Newton steps; the mean is over the rows of all intervals."""
    n = (died + survived).sum()
    a = np.column_stack([np.ones(len(x)), x])
    out = []
    for i in range(died.shape[1]):
        w = np.zeros(a.shape[1])
        rows = died[:, i] + survived[:, i]
        for _ in range(60):
            h = 1 / (1 + np.exp(-a @ w))
            g = a.T @ (rows * h - died[:, i]) / n + reg * w
            w -= np.linalg.solve((a.T * (rows * h * (1 - h) / n)) @ a + reg * np.eye(len(w)), g)
        out.append(w)
    return np.array(out)


def test_all_folds_and_penalties_against_newton(spark):
    x, died, survived, long, vocabulary, labels = _data(spark)
    problems = S.Problems(np.array([-1, 0, 1, 2, 0]), np.array([0.01, 0.01, 0.01, 0.01, 0.1]), 3, 7)
    found = S.fit_all(S.sparse_rows(long, vocabulary, labels).repartition(3), problems, tolerance=1e-6)
    assert found.gradient.max() <= 1e-6 and found.passes < 100
    fold = np.arange(len(x)) % 3
    for m, (held, reg) in enumerate(zip(problems.held, problems.penalty)):
        own = fold != held
        want = _newton(x[own], died[own], survived[own], reg)
        assert np.allclose(found.weights[:, m, :].T, want, atol=2e-4)
        if held >= 0:
            h = 1 / (1 + np.exp(-np.column_stack([np.ones((~own).sum()), x[~own]]) @ want.T))
            loss = -(died[~own] * np.log(h + 1e-7) + survived[~own] * np.log(1 - h + 1e-7)).sum() / (~own).sum()
            assert found.loss[0, m] == pytest.approx(loss, rel=1e-4)
    assert np.isnan(found.loss[0, 0])


def test_model_equations_and_hazards(spark):
    x, died, survived, long, vocabulary, labels = _data(spark, seed=2)
    names = [f"f{j}" for j in range(6)]
    model = S.fit_sparse(long, vocabulary, labels, [0.0, 1.0, 2.0, 3.0], names, reg=0.02)
    rows = S.sparse_rows(long, vocabulary, labels)
    found = S.sparse_equations(model, rows, 0.02).collect()
    assert len(found) == 3 * 7 and all(abs(r.gradient) <= 1.1e-4 * r.exposure + 1e-12 for r in found)
    hazard = {r.pid: r.hazard for r in S.sparse_hazards(model, rows).collect()}
    dense = {r.pid: r.hazard for r in Z.with_hazards(model, spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(x)], "pid long, features array<double>")).collect()}
    assert all(np.allclose(hazard[p], dense[p]) for p in dense)


def test_small_slices_give_the_same_sums(spark, monkeypatch):
    *_, long, vocabulary, labels = _data(spark, n=60)
    problems = S.Problems(np.array([-1]), np.array([0.05]), 3, 7)
    rows = S.sparse_rows(long, vocabulary, labels)
    whole = list(S._batches(iter(rows.drop("pid").toArrow().combine_chunks().to_batches()), 3))
    monkeypatch.setattr(S, "WORK", 20)
    parts = list(S._batches(iter(rows.drop("pid").toArrow().combine_chunks().to_batches()), 3))
    assert len(whole) == 1 and len(parts) > 10
    for i in (0, 1, 3, 4, 5):
        assert np.array_equal(np.concatenate([p[i] for p in parts]), whole[0][i])
    assert S.fit_all(rows, problems).gradient.max() <= S.TOLERANCE


def test_patients_without_features_and_empty_labels(spark):
    *_, long, vocabulary, labels = _data(spark, n=30)
    rows = S.sparse_rows(long.where("pid > 5"), vocabulary, labels)
    assert rows.count() == 30 and rows.where("pid = 0").first()["at"] == [0]
    none = S.fit_all(rows.where("false"), S.Problems(np.array([-1]), np.array([0.1]), 3, 7))
    assert not none.weights.any()


def test_search_of_a_study(spark):
    events = spark.createDataFrame([(i, -10 * (1 + i % 40), "lvl3", "AB"[i % 2]) for i in range(1, 60)] + [(i, -20, "chap", "C") for i in range(1, 60, 3)],
                                   "pid BIGINT, time INT, level STRING, code STRING")
    surv = spark.createDataFrame([(i, True, 1 + i % 20 + 10 * (i % 2), i % 4 != 0) for i in range(1, 61)], "pid BIGINT, train BOOLEAN, time INT, event BOOLEAN")
    out = S.search_study({"diagnoses": events}, surv, "001", {"diag_window": [0.5, 2.0], "diag_level": ["lvl3", "chap"]}, [0.0, 10.0, 20.0, 30.0], [0.001, 0.1], k=3)
    rows = {(r.diag_window, r.diag_level, r.reg): r.loss for r in out.collect()}
    assert len(rows) == 8 and all(v > 0 for v in rows.values())
    labels = X.survival_labels(surv, [0.0, 10.0, 20.0, 30.0])
    features, names = Z.study_matrix({"diagnoses": events}, surv, "001", {"diag_window": 2.0, "diag_level": "lvl3"})
    plain = {r.reg: r.loss for r in Z.cross_validate(features, labels, [0.0, 10.0, 20.0, 30.0], names, {"reg": [0.001, 0.1]}, k=3, max_iter=200).collect()}
    for reg in (0.001, 0.1):
        assert rows["2.0", "lvl3", reg] == pytest.approx(plain[reg], rel=1e-3)


def test_equal_patients_are_one_counted_row(spark, monkeypatch):
    from vitalspan.session import settle
    *_, long, vocabulary, labels = _data(spark, n=40)
    wide = F.explode(F.sequence(F.lit(0), F.lit(2)))
    more = lambda df: df.withColumn("_c", wide).withColumn("pid", F.col("pid") + F.col("_c") * 1000).drop("_c")
    rows = settle(S.sparse_rows(more(long), vocabulary, more(labels)))
    counted = S.merged(rows, 3)
    assert rows.count() == 120 and counted.count() <= 40 and counted.agg(F.sum("n")).first()[0] == 120
    problems = S.Problems(np.array([-1, 0, 1, 2]), np.array([0.01, 0.01, 0.05, 0.05]), 3, 7)
    plain, found = S.fit_all(rows, problems, tolerance=1e-6), S.fit_all(counted, problems, tolerance=1e-6)
    assert np.allclose(plain.weights, found.weights, atol=1e-9) and np.allclose(plain.loss, found.loss, atol=1e-9, equal_nan=True)
    monkeypatch.setattr(S, "DENSE", 0)  # lists of cells instead of small matrices
    weights = np.linspace(-1, 1, 7 * problems.size).reshape(7, -1)
    batches = lambda: iter(counted.sort("setting", "fold", "at").toArrow().combine_chunks().to_batches())
    listed = [b for b in S._blocks(batches(), problems)]
    monkeypatch.setattr(S, "DENSE", 1000)
    for (a, died, *_), (b, *_) in zip(listed, S._blocks(batches(), problems), strict=True):
        assert a.dense is None and b.dense is not None and np.array_equal(a.used, b.used)
        assert np.allclose(a.logits(weights[a.used]), b.logits(weights[b.used]))
        assert all(np.allclose(a.sums(died, power), b.sums(died, power)) for power in (0, 1, 2))


def test_passes_go_over_all_cores_and_equations_join_nothing_by_patient(spark):
    *_, long, vocabulary, labels = _data(spark, n=60)
    rows = S.sparse_rows(long, vocabulary, labels)
    assert S.dealt(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    model = S.fit_sparse(long, vocabulary, labels, [0.0, 1.0, 2.0, 3.0], [f"f{j}" for j in range(6)], reg=0.02)
    text = S.sparse_equations(model, rows, 0.02)._jdf.queryExecution().executedPlan().toString()
    assert "pid" not in text
