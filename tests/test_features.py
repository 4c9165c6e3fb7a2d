import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspan.operators import features as X
from vitalspan.operators import reshape as H
from vitalspan.operators.cohort import split_exact


def labels(spark, rows, breaks):
    df = spark.createDataFrame(rows, "pid INT, time INT, event BOOLEAN")
    return {r["pid"]: (r["died"], r["survived"]) for r in X.survival_labels(df, breaks).collect()}


def test_label_traps(spark):
    out = labels(spark, [(1, 5, True), (2, 20, True), (3, 15, True), (4, 30, True), (5, 24, False), (6, 25, False), (7, 40, True)], [10.0, 20.0, 30.0])
    assert out[1] == ([True, False], [False, False])   # before the first break
    assert out[2] == ([True, False], [True, False])    # exactly on a break: both
    assert out[3] == ([True, False], [False, False])
    assert out[4] == ([False, False], [True, True])    # at the last break: treated as censored
    assert out[5] == ([False, False], [True, False])   # censored before a midpoint
    assert out[6] == ([False, False], [True, True])    # censored at a midpoint
    assert out[7] == ([False, False], [True, True])


def test_labels_against_array_arithmetic(spark):
    breaks = np.array([3.0, 9.0, 14.0, 30.0])
    rows = [(i, i % 35, i % 2 == 0) for i in range(70)]
    out = labels(spark, rows, list(breaks))
    for pid, time, event in rows:
        died, survived = [False] * 3, []
        if event and time < breaks[-1]:
            died[[time <= b for b in breaks[1:]].index(True)] = True
            survived = [bool(time >= b) for b in breaks[1:]]
        else:
            survived = [bool(time >= a + (b - a) / 2) for a, b in zip(breaks, breaks[1:])]
        assert out[pid] == (died, survived)


def test_grid_starts_at_the_first_event_and_uses_training_events_only(spark):
    surv = spark.createDataFrame([(i, i <= 10, i, i > 1) for i in range(1, 15)], "pid INT, train BOOLEAN, time INT, event BOOLEAN")
    got = X.time_breaks(surv, 4, 100).first()["breaks"]
    assert got == pytest.approx(list(np.percentile(range(2, 11), [0, 25, 50, 75, 100])))
    assert X.time_breaks(surv, 4, 100, start_at_zero=True).first()["breaks"] == pytest.approx([0.0] + got[1:])


def test_person_periods_skip_uninformative_intervals(spark):
    df = spark.createDataFrame([(1, 5, True)], "pid INT, time INT, event BOOLEAN")
    rows = X.person_periods(X.survival_labels(df, [0.0, 4.0, 8.0, 12.0])).orderBy("interval").collect()
    assert [(r["interval"], r["died"], r["survived"]) for r in rows] == [(0, False, True), (1, True, False)]


def baseline(spark):
    rows = [(1, 60.0, 80, 120, 90.0, True, True, False, 1), (2, 15.0, None, 140, None, False, None, True, None), (3, 105.0, 60, 100, 150.0, False, False, False, 4)]
    return spark.createDataFrame(rows, "pid INT, age DOUBLE, pulse INT, sys_bp INT, crea DOUBLE, arrest BOOLEAN, enzymes BOOLEAN, stemi BOOLEAN, killip INT")


def test_clinical_scaling_and_missing_patients(spark):
    patients = spark.createDataFrame([(1,), (2,), (9,)], "pid INT")
    out = {(r["pid"], r["feature"]): r["value"] for r in X.clinical_features_1(baseline(spark), patients).collect()}
    assert out[1, "clnc-1_age"] == 0.5 and out[2, "clnc-1_age"] == 0.0
    assert out[2, "clnc-1_pulse"] == 0.0 and out[2, "clnc-1_crea"] == 0.0           # unknown becomes the mean
    assert out[1, "clnc-1_pulse"] == pytest.approx((80 - 70) / np.std([80, 60], ddof=1))   # sample deviation
    logs = np.log1p([90.0, 150.0])
    assert out[1, "clnc-1_crea"] == pytest.approx((logs[0] - logs.mean()) / logs.std())    # population deviation
    assert all(out[9, f"clnc-1_{c}"] is None for c in X.clinical_1_columns())         # no baseline row
    for pid in (1, 2):
        assert sum(out[pid, f"clnc-1_killip_{k}"] for k in (1, 2, 3, 4, "nan")) == 1
        assert sum(out[pid, f"clnc-1_enzymes_{k}"] for k in ("True", "False", "nan")) == 1
    assert len({f for _, f in out}) == len(X.clinical_1_columns())


def test_constant_column_and_dropped_prefixes(spark):
    one = baseline(spark).where("pid = 1")
    out = {r["feature"]: r["value"] for r in X.clinical_features_1(one, one, remove=("killip", "enzymes")).collect()}
    assert out["clnc-1_pulse"] == 0.0 and not any("killip" in f or "enzymes" in f for f in out)


def test_winsorize_matches_sorted_clamping(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 101), ("b", 20), ("c", 1)) for v in rng.integers(0, 40, n)]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "pid INT, name STRING, score DOUBLE")
    for limit in (0.0, 0.05, 0.3):
        for block_rows in (6, 1 << 20):
            out = X.winsorize(df, ["name"], "score", limit, block_rows).toPandas()
            for g in "abc":
                values = sorted(v for name, v in rows if name == g)
                k = int(limit * len(values))
                ref = np.clip(values, values[k], values[len(values) - k - 1])
                assert np.allclose(sorted(out[out.name == g]["score"]), ref)


def test_polygenic_absent_patient_is_zero_but_absent_score_is_null(spark):
    scores = spark.createDataFrame([(1, "x", 1.0), (2, "x", 3.0), (1, "y", 5.0), (3, "y", 7.0)], "pid INT, name STRING, score DOUBLE")
    out = {(r["pid"], r["feature"]): r["value"] for r in X.polygenic_features(scores, spark.createDataFrame([(1,), (2,), (9,)], "pid INT")).collect()}
    assert out[1, "pgss-1_x"] == pytest.approx(-1 / np.sqrt(2)) and out[2, "pgss-1_y"] is None and out[9, "pgss-1_x"] == 0.0


def test_tri_state_and_vocabularies(spark):
    tests = spark.createDataFrame([(1, "NPU1", 10, -1), (1, "NPU2", 900, 1), (2, "XX", 1, 0)], "pid INT, qid STRING, time INT, value INT")
    patients = spark.createDataFrame([(1,), (2,)], "pid INT")
    out = [(r["pid"], r["feature"]) for r in X.tri_state_labs(tests, patients, 365, "^NPU").collect()]
    assert out == [(1, "bioc-1_NPU1_low")]
    vocab = {r["feature"]: r["column_index"] for r in X.tri_state_vocabulary(tests, "^NPU").collect()}  # ignores the horizon
    assert vocab["bioc-1_NPU2_high"] == 5 and len(vocab) == 6


def test_multi_hot_arrays(spark):
    events = spark.createDataFrame([(1, -10, "lvl3", "B"), (1, -10, "lvl3", "B"), (1, -4000, "lvl3", "C"), (2, -1, "lvl4", "A"), (2, -5, "lvl3", "A")], "pid INT, time INT, level STRING, code STRING")
    patients = spark.createDataFrame([(1,), (2,)], "pid INT")
    long = X.multi_hot_diagnoses(events, patients, "lvl3", 3650)
    vocab = X.multi_hot_vocabulary(events, X.DIAGNOSES, X.diagnosis_window("lvl3", 3650))
    assert {r["feature"]: r["column_index"] for r in vocab.collect()} == {"diag-simple_A": 0, "diag-simple_B": 1}
    assert {r["pid"]: r["features"] for r in X.feature_arrays(long, vocab, 2).collect()} == {1: [0.0, 1.0], 2: [1.0, 0.0]}


def test_folds_and_splits_are_exact(spark):
    df = spark.range(103).withColumnRenamed("id", "pid")
    folds = {r["fold"]: r["count"] for r in X.kfold_assign(df, 5).groupBy("fold").count().collect()}
    assert folds == {0: 20, 1: 20, 2: 20, 3: 20, 4: 23}
    assert split_exact(df, 30).where("NOT train").count() == 30
    assert X.ratio_split(df, 0.8).where("part = 1").count() == 82


def test_study_presets_name_known_sets():
    assert len(X.STUDIES) == 12
    assert all(alias in X.FEATURE_SETS for sets in X.STUDIES.values() for alias in sets)


@pytest.mark.parametrize("n,masked", [(0, 5), (1, 5), (4, 5), (5, 5), (6, 6)])
def test_small_cells(spark, n, masked):
    assert H.suppress_small_cells(spark.createDataFrame([(n,)], "n BIGINT")).first()["n"] == masked


def test_shares_at_the_thresholds(spark):
    cohort = spark.range(200).withColumnRenamed("id", "pid")
    events = spark.createDataFrame([(i, c) for c, k in (("rare", 9), ("edge", 10), ("more", 11)) for i in range(k)], "pid INT, code STRING")
    codes = lambda df: sorted(r[0] for r in df.select("code").distinct().collect())
    assert codes(H.drop_rare_codes(events, cohort, 0.05)) == ["edge", "more"]        # shares below are dropped
    assert codes(H.keep_common_codes(events, cohort, 0.05)) == ["more"]              # counts strictly above are kept


def test_prevalence_counts_the_unseen(spark):
    cohort = spark.createDataFrame([(i, i < 60) for i in range(100)], "pid INT, train BOOLEAN")
    events = spark.createDataFrame([(i, "A") for i in range(20)] * 2 + [(70, "B")], "pid INT, code STRING")
    out = {(r["train"], r["code"], r["seen"]): (r["n"], r["p"]) for r in H.event_prevalence(events, cohort, "train").collect()}
    assert out[True, "A", True] == (20, pytest.approx(100 * 20 / 60)) and out[True, "A", False] == (40, pytest.approx(100 * 40 / 60))
    assert out[False, "B", True] == (5, pytest.approx(100 * 5 / 44)) and out[False, "B", False][0] == 39
    assert (False, "A", True) not in out and out[False, "A", False] == (40, 100.0)


def test_histogram_is_right_closed(spark):
    out = {r["bin"]: r["n"] for r in H.histogram(spark.createDataFrame([(0.1,), (0.25,), (0.26,), (0.5,)], "x DOUBLE"), "x", 0.25).collect()}
    assert out == {0: 2, 1: 2}


def test_value_kinds(spark):
    rows = spark.createDataFrame([("a", "g_a_1", 0.0), ("a", "g_a_2", 1.0), ("b", "g_b", 0.5), ("b", "g_b", 0.6), ("b", "g_b", 0.7), ("c", "g_c", 0.0), ("c", "g_c", 1.0)], "fname STRING, feature STRING, value DOUBLE")
    assert {r["fname"]: r["type"] for r in H.value_kind(rows, ["fname"], "value", F.col("feature")).collect()} == {"a": "categorical", "b": "continuous", "c": "logical"}
