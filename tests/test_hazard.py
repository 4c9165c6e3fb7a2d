import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspan.operators import features as X
from vitalspan.operators import hazard as Z
from vitalspan.operators.attribution import attribution_delta, collapse_one_hot, cumulative_contribution, level_values, with_parts

MODEL = Z.HazardModel([0.0, 1.0, 2.0, 4.0], ["x_a", "x_b"], np.array([[-1.0, 0.5, 0.2], [-0.5, -0.3, 0.8], [-1.2, 0.7, 0.1]]))


def survival(x):
    logits = MODEL.weights[:, 0] + MODEL.weights[:, 1:] @ np.asarray(x)
    return np.cumprod(1 - 1 / (1 + np.exp(-logits)))


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    return rows, spark.createDataFrame(rows, "pid BIGINT, features ARRAY<DOUBLE>")


def test_scores_are_products_of_conditional_survival(people):
    rows, df = people
    got = {(r["pid"], r["time"]): r["surv"] for r in Z.score(MODEL, df).collect()}
    for pid, x in rows:
        assert [got[pid, t] for t in (1.0, 2.0, 4.0)] == pytest.approx(list(survival(x)))
    at = {r["pid"]: r["surv"] for r in Z.score_at(MODEL, df, [3.0]).collect()}
    assert at[0] == pytest.approx(survival(rows[0][1])[1:].mean())


def test_fit_satisfies_the_score_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    time = np.ceil(rng.exponential(3 * np.exp(-0.8 * x))).astype(int)
    rows = [(i, int(min(t, 9)), bool(t < 9), [float(v)]) for i, (t, v) in enumerate(zip(time, x))]
    surv = spark.createDataFrame(rows, "pid BIGINT, time INT, event BOOLEAN, features ARRAY<DOUBLE>")
    breaks = [0.0, 2.5, 5.5, 8.5]
    known = X.survival_labels(surv.drop("features"), breaks)
    model = Z.fit_hazard(surv.select("pid", "features"), known, breaks, ["x"])
    assert model.weights.shape == (3, 2) and (model.weights[:, 1] > 0).all()
    periods = X.person_periods(known).join(surv.select("pid", "features"), "pid").toPandas()
    for i, part in periods.groupby("interval"):
        v = np.vstack(part["features"].to_numpy())[:, 0]
        h = 1 / (1 + np.exp(-(model.weights[i, 0] + model.weights[i, 1] * v)))
        residual = part["died"].to_numpy(float) - h
        assert abs(residual.sum()) < 0.05 and abs((residual * v).sum()) < 0.05
    worse = Z.HazardModel(model.breaks, model.features, model.weights + 0.7)
    loss = lambda m: Z.model_loss(m, surv.select("pid", "features"), known).first()["nll"]
    assert loss(model) < loss(worse)
    grid = Z.cross_validate(surv.select("pid", "features"), known, breaks, ["x"], {"reg": [0.0, 10.0]}, k=2, max_iter=20).collect()
    assert min(grid, key=lambda r: r["loss"])["reg"] == 0.0


def test_ablation_equals_rescoring_with_medians(people):
    rows, df = people
    medians = Z.training_medians(df, MODEL.features)
    assert medians == pytest.approx(list(np.median([x for _, x in rows], axis=0)))
    got = {(r["pid"], r["feature"], r["tau"]): r["surv"] for r in Z.ablate_features(MODEL, df, medians, {"x_a": [0], "both": [0, 1]}, (2.0, 9.0)).collect()}
    for pid, (a, b) in rows:
        assert got[pid, "full", 2.0] == pytest.approx(survival([a, b])[1])
        assert got[pid, "x_a", 2.0] == pytest.approx(survival([medians[0], b])[1])
        assert got[pid, "both", 2.0] == pytest.approx(survival(medians)[1])
        assert got[pid, "full", 9.0] is None


def test_attributions_add_up_to_the_change_in_prediction(people):
    rows, df = people
    background = Z.sample_background(df, 10)
    out = Z.attribute(MODEL, df, background, 3.0, steps=40)
    sums = {r["pid"]: r["s"] for r in out.groupBy("pid").agg(F.sum("shap").alias("s")).collect()}
    base = np.mean([survival(b)[1:].mean() for b in background])
    for pid, x in rows:
        assert sums[pid] == pytest.approx(survival(x)[1:].mean() - base, abs=2e-4)


def attributions(spark):
    rows = [(1, "g_s_no", 0.1, 0.0), (1, "g_s_yes", 0.2, 1.0), (1, "g_age", -0.4, 0.5), (2, "g_s_no", 0.1, 0.0), (2, "g_s_yes", -0.3, 0.0), (2, "g_age", 0.3, 0.7)]
    return spark.createDataFrame([(*r, 1825.0) for r in rows], "pid INT, feature STRING, shap DOUBLE, vals DOUBLE, timepoint DOUBLE")


def test_one_hot_columns_collapse(spark):
    out = {(r["pid"], r["fname"]): (r["text"], r["value"], round(r["shap"], 6)) for r in collapse_one_hot(attributions(spark)).collect()}
    assert out == {(1, "s"): ("yes", 2.0, 0.3), (1, "age"): (None, 0.5, -0.4), (2, "s"): ("missing", 0.0, -0.2), (2, "age"): (None, 0.7, 0.3)}


@pytest.mark.parametrize("order", ["magnitude", "ascending", "descending", "smallest", "sign"])
def test_contributions_meet_the_prediction(spark, order):
    rows = spark.createDataFrame([(1, f"f{i}", v) for i, v in enumerate([0.3, -0.2, 0.05, -0.1, 0.01])], "pid INT, label STRING, shap DOUBLE")
    out = cumulative_contribution(rows, 3, base=0.5, order=order).collect()
    assert len(out) == 4 and sum(r["label"] == "rest" for r in out) == 1
    yhat = 0.5 + 0.06
    assert all(r["yhat"] == pytest.approx(yhat) for r in out)
    if order == "sign":
        assert max(r["end"] for r in out if r["dir"] == "pos") == pytest.approx(yhat)
        assert min(r["end"] for r in out if r["dir"] == "neg") == pytest.approx(yhat)
    else:
        assert min(abs(r["end"] - yhat) for r in out) < 1e-9 and min(abs(r["start"] - 0.5) for r in out) < 1e-9


def test_levels_are_ordered_with_special_ones_at_the_ends(spark):
    rows = [(i, "lvef", t, float(i), 0.1) for i, t in enumerate(["missing", "(10,20]", "[0,10]", "(20,30]"])]
    df = spark.createDataFrame(rows, "pid INT, fname STRING, text STRING, value DOUBLE, shap DOUBLE")
    out = {r["text"]: (r["level"], r["normalized"]) for r in level_values(df).collect()}
    assert out == {"[0,10]": (1, 0.0), "(10,20]": (2, 0.5), "(20,30]": (3, 1.0), "missing": (4, None)}


def test_delta_of_equal_tables_is_zero(spark):
    a = attributions(spark)
    assert all(r["q50"] == 0.0 and r["rank"] == 1 for r in attribution_delta(a, a).collect())
    assert {r["fgroup"] for r in with_parts(a.withColumn("feature", F.lit("diag-simple_DI21"))).collect()} == {"diag-1"}


def test_study_matrix_keeps_patients_without_features(spark):
    events = spark.createDataFrame([(1, -10, "lvl3", "B"), (2, -900, "lvl3", "A"), (2, -900, "chap", "C")], "pid BIGINT, time INT, level STRING, code STRING")
    surv = spark.createDataFrame([(i, True, 5 + i, i % 2 == 0) for i in range(1, 9)], "pid BIGINT, train BOOLEAN, time INT, event BOOLEAN")
    features, names = Z.study_matrix({"diagnoses": events}, surv, "001", {"diag_window": 1.0, "diag_level": "lvl3"})
    got = {r["pid"]: r["features"] for r in features.collect()}
    assert names == ["diag-simple_B"] and got[1] == [1.0] and got[2] == [0.0] and len(got) == 8
    out = Z.cross_validate_study({"diagnoses": events}, surv, "001", {"diag_window": [1.0, 5.0]}, [0.0, 7.0, 14.0], [0.1], k=2, max_iter=5).collect()
    assert sorted(r["diag_window"] for r in out) == ["1.0", "5.0"] and all(r["loss"] > 0 for r in out)


def test_study_matrix_has_the_same_columns_for_any_cohort(spark):
    diagnoses = spark.createDataFrame([(1, -10, "lvl3", "B"), (2, -20, "lvl3", "A")], "pid BIGINT, time INT, level STRING, code STRING")
    tests = spark.createDataFrame([(1, "NPU1", 10, -1), (3, "NPU2", 9, 1)], "pid BIGINT, qid STRING, time INT, value INT")
    codes = spark.createDataFrame([(2, "KA", 5), (3, "KB", 9000)], "pid BIGINT, code STRING, time INT")
    tables = {"diagnoses": diagnoses, "biochem": tests, "nomesco": codes}
    study = {X.DIAGNOSES: {"level": "lvl3", "horizon": 365.0}, X.LABS: {"horizon": 365.0}, X.PROCEDURES: {"horizon": 365.0}}
    X.STUDIES["test"] = study
    try:
        widths = []
        for pids in ([1], [2, 3]):
            cohort = spark.createDataFrame([(p,) for p in pids], "pid BIGINT")
            features, names = Z.study_matrix(tables, cohort, "test")
            widths.append(names)
            assert all(len(r["features"]) == len(names) for r in features.collect())
    finally:
        del X.STUDIES["test"]
    assert widths[0] == widths[1] and len(widths[0]) == 2 + 6 + 2


def test_fitted_model_solves_its_equations(people):
    rows, df = people
    labels = df.selectExpr("pid", "array(pid % 3 = 0, pid % 2 = 0) AS died", "array(pid % 3 <> 0, pid % 2 <> 0) AS survived")
    model = Z.fit_hazard(df, labels, [0.0, 1.0, 2.0], MODEL.features, reg=0.01)
    off = Z.score_equations(model, df, labels, 0.01).collect()
    assert len(off) == 2 * (1 + len(MODEL.features)) and all(abs(r["gradient"]) < 1e-3 for r in off)
