"""Hazard model: fit, cross-validate, score, ablate and attribute over the patient views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vitalspan.operators import attribution as A
from vitalspan.operators import features as X
from vitalspan.operators import hazard as Z
from vitalspan.operators import hazard_search as HS
from vitalspan.plans.attribution_queries import COLLAPSE_SQL
from vitalspan.plans.feature_queries import LABEL_SQL, sources
from vitalspan.plans.registry import q6, query, rounded
from vitalspan.plans.views import v_attributions, v_patients, v_surv
from vitalspan.session import settle

NAMES = ["age", "sex", "season"]
N_INTERVALS, MAX_TIME = 8, 1500

# A model with given weights, so that scoring can be checked against SQL.
GIVEN = Z.HazardModel(
    [0.0, 300.0, 700.0, 1200.0, 1900.0], NAMES,
    np.array([[-2.5, 0.8, 0.3, 0.2], [-2.0, 1.1, 0.1, -0.3], [-1.8, 0.9, -0.2, 0.4], [-1.5, 1.3, 0.2, 0.1]]))


def feature_arrays(spark, sf):
    """Dense features of every patient: scaled age, sex, share of the year at the index date."""
    return v_patients(spark, sf).select(
        "pid", F.array((F.col("age") - 15) / 90, F.col("sex").cast("double"), F.dayofyear("index_date") / F.lit(366.0)).alias("features"))


def _fitted(spark, sf, **params):
    surv = v_surv(spark, sf)
    breaks = X.time_breaks(surv, N_INTERVALS, MAX_TIME).first()["breaks"]  # n_intervals + 1 numbers
    train = surv.where("train")
    known = X.survival_labels(train, breaks)
    features = feature_arrays(spark, sf)
    return Z.fit_hazard(features, known, breaks, NAMES, **params), features, surv, breaks


_INPUT_SQL = "fx AS (SELECT pid, (age - 15) / 90 AS x1, CAST(CAST(sex AS INTEGER) AS DOUBLE) AS x2, dayofyear(index_date) / 366.0 AS x3 FROM v_patients)"


def _curve_sql(name: str, source: str, x=("x1", "x2", "x3"), keys: str = "pid") -> str:
    """SQL of the survival values s1..s4 of the given model."""
    keep = lambda row: f"(1 - 1 / (1 + exp(-({row[0]} + {row[1]} * {x[0]} + {row[2]} * {x[1]} + {row[3]} * {x[2]}))))"
    rows = [keep(r) for r in GIVEN.weights]
    products = ", ".join(" * ".join(rows[: i + 1]) + f" AS s{i + 1}" for i in range(len(rows)))
    return f"{name} AS (SELECT {keys}, {products} FROM {source})"


@query("score_hazard", "J3 I5", f"""
WITH {_INPUT_SQL}, {_curve_sql("cv", "fx")}
""" + " UNION ALL ".join(f"SELECT pid, CAST({t} AS DOUBLE) AS time, {q6(f's{i + 1}', 'surv')} FROM cv" for i, t in enumerate(GIVEN.breaks[1:])))
def score_hazard(spark, sf):
    return rounded(Z.score(GIVEN, feature_arrays(spark, sf)), "surv")


_SCORE_TAUS = (300.0, 365.0, 1095.0, 1825.0, 2000.0)


def _tau_sql(tau: float) -> str:
    times = GIVEN.breaks[1:]
    for i, (a, b) in enumerate(zip(times, times[1:])):
        if a <= tau <= b:
            return f"s{i + 1} + (s{i + 2} - s{i + 1}) * ({tau} - {a}) / ({b} - {a})"
    return "CAST(NULL AS DOUBLE)"


@query("score_at_horizons", "J3 I6", f"WITH {_INPUT_SQL}, {_curve_sql('cv', 'fx')} " + " UNION ALL ".join(
    f"SELECT pid, CAST({t} AS DOUBLE) AS tau, {q6(_tau_sql(t), 'surv')} FROM cv" for t in _SCORE_TAUS))
def score_at_horizons(spark, sf):
    return rounded(Z.score_at(GIVEN, feature_arrays(spark, sf), _SCORE_TAUS), "surv")


_ABLATION_TAUS = (364.0, 1095.0)
_GROUPS = {"age": [0], "sex_season": [1, 2]}


def _ablation_sql() -> str:
    med = "md AS (SELECT quantile_cont(x1, 0.5) AS m1, quantile_cont(x2, 0.5) AS m2, quantile_cont(x3, 0.5) AS m3 FROM fx JOIN v_surv USING (pid) WHERE train)"
    variants = {"full": ("x1", "x2", "x3"), "age": ("m1", "x2", "x3"), "sex_season": ("x1", "m2", "m3")}
    ctes = ", ".join(_curve_sql(f"c_{n}", "fx, md", x) for n, x in variants.items())
    rows = " UNION ALL ".join(
        f"SELECT pid, '{n}' AS feature, CAST({t} AS DOUBLE) AS tau, {q6(_tau_sql(t), 'surv')} FROM c_{n}" for n in variants for t in _ABLATION_TAUS)
    return f"WITH {_INPUT_SQL}, {med}, {ctes} {rows}"


@query("ablate_features", "J4 I6 D16", _ablation_sql())
def ablate_features(spark, sf):
    features = feature_arrays(spark, sf)
    train = features.join(v_surv(spark, sf).where("train").select("pid"), "pid", "left_semi")
    medians = Z.training_medians(train, NAMES)
    return rounded(Z.ablate_features(GIVEN, features, medians, _GROUPS, _ABLATION_TAUS), "surv")


@query("fit_hazard", "J1 H22 H23")
def fit_hazard(spark, sf):
    model, *_ = _fitted(spark, sf, reg=0.001)
    return model.coefficients(spark)


@query("hazard_score_equations", "J1", """
WITH f AS (SELECT unnest(['(intercept)', 'age', 'sex', 'season']) AS feature)
SELECT CAST(i AS INTEGER) AS interval, feature, CAST(0 AS DOUBLE) AS gradient FROM range(0, 8) t(i), f""")
def hazard_score_equations(spark, sf):
    """The fitted model solves the equations of its penalised likelihood (to three decimals of the mean gradient)."""
    model, features, surv, breaks = _fitted(spark, sf, reg=0.001)
    out = Z.score_equations(model, features, X.survival_labels(surv.where("train"), breaks), 0.001)
    return out.withColumn("gradient", F.round("gradient", 3) + F.lit(0.0))


@query("cross_validate_hazard", "J2 H24 I18")
def cross_validate_hazard(spark, sf):
    surv = v_surv(spark, sf).where("train")
    breaks = X.time_breaks(surv, 4, MAX_TIME).first()["breaks"]
    known = X.survival_labels(surv, breaks)
    return Z.cross_validate(feature_arrays(spark, sf), known, breaks, NAMES, {"reg": [0.0, 0.01]}, k=5)


@query("cross_validate_study", "J2 H20 H21")
def cross_validate_study(spark, sf):
    """Two code levels of the diagnosis features, chosen by held-out loss."""
    from vitalspan.plans.cohort_queries import diagnosis_events
    surv = v_surv(spark, sf).where("train")
    breaks = X.time_breaks(surv, 4, MAX_TIME).first()["breaks"]
    tables = {"diagnoses": settle(diagnosis_events(spark, sf))}
    return Z.cross_validate_study(tables, surv, "001", {"diag_window": [2.0], "diag_level": ["block", "chap"]}, breaks, [0.01], k=5)


@query("fit_study_equations", "J1 H20 H21", f"""
WITH {LABEL_SQL} SELECT interval, SUM(CAST(died AS INTEGER) + CAST(survived AS INTEGER))::BIGINT AS n_rows, CAST(0 AS BIGINT) AS n_off
FROM lab JOIN v_surv USING (pid) WHERE train GROUP BY interval""")
def fit_study_equations(spark, sf):
    """Study 005 fitted on its own matrix: how many coefficients miss their equation by more than a thousandth of the
    feature's exposure, by interval. The equations are worked out by sums, apart from the optimiser."""
    made = sources(spark, sf, X.STUDIES["005"])
    surv = made["surv_master"].where("train")
    breaks = X.time_breaks(surv, 10, MAX_TIME).first()["breaks"]  # n_intervals + 1 numbers
    known = settle(X.survival_labels(surv, breaks).select("pid", "died", "survived"))
    long = settle(X.study_features(made, surv, "005"))
    vocabulary = settle(X.study_vocabulary(made, long, "005"))
    names = [r["feature"] for r in vocabulary.orderBy("column_index").collect()]  # as many as coefficients of an interval
    cells = settle(HS.dealt(HS.sparse_rows(long, vocabulary, known)))  # fitted, and read again by the equations
    model = HS.fit_rows(cells, breaks, names, reg=0.001, tolerance=5e-4)
    found = HS.sparse_equations(model, cells, 0.001)
    off = found.groupBy("interval").agg(F.count_if(F.abs("gradient") > 1e-3 * F.col("exposure") + 1e-12).alias("n_off"))
    rows = X.person_periods(known).groupBy("interval").agg(F.sum(F.col("died").cast("long") + F.col("survived").cast("long")).alias("n_rows"))
    return off.join(rows, "interval").select("interval", "n_rows", "n_off")


@query("search_study", "J2 H20 H21 H24")
def search_study(spark, sf):
    """Held-out losses of study 001 over windows, all four code levels and penalties, five folds each."""
    made = sources(spark, sf, X.STUDIES["001"])
    surv = made["surv_master"].where("train")
    breaks = X.time_breaks(surv, 10, MAX_TIME).first()["breaks"]
    grid = {"diag_window": [0.5, 2.0, 10.0], "diag_level": list(X.SEARCH_SPACE["diag_level"])}
    return HS.search_study({"diagnoses": settle(made["diagnoses"])}, surv, "001", grid, breaks, [0.001, 0.01, 0.1], tolerance=1e-3)


def _attribution_sql(tau: float, rows: int, steps: int) -> str:
    """Mean gradient of the interpolated survival over background rows and points between them and the patient."""
    times = GIVEN.breaks[1:]
    i = max(k for k, t in enumerate(times[:-1]) if t <= tau)
    share = (tau - times[i]) / (times[i + 1] - times[i])
    xs = range(1, len(NAMES) + 1)
    point = {j: f"(b{j} + a * (x{j} - b{j}))" for j in xs}
    hazard = [f"1 / (1 + exp(-({w[0]} + " + " + ".join(f"{w[j]} * {point[j]}" for j in xs) + ")))" for w in GIVEN.weights]
    survival = lambda n: " * ".join(f"(1 - h{k})" for k in range(n + 1))
    slope = lambda j, n: "(" + " + ".join(f"h{k} * {GIVEN.weights[k][j]}" for k in range(n + 1)) + f") * {survival(n)}"
    cells = " UNION ALL ".join(
        f"SELECT pid, '{NAMES[j - 1]}' AS feature, AVG(-(x{j} - b{j}) * ((1 - {share}) * {slope(j, i)} + {share} * {slope(j, i + 1)})) AS shap, MAX(x{j}) AS vals FROM g GROUP BY pid" for j in xs)
    return f"""
WITH {_INPUT_SQL}, tr AS (SELECT fx.* FROM fx JOIN v_surv USING (pid) WHERE train), te AS (SELECT fx.* FROM fx JOIN v_surv USING (pid) WHERE NOT train),
bg AS (SELECT {", ".join(f"x{j} AS b{j}" for j in xs)} FROM tr ORDER BY md5(CAST(pid AS VARCHAR)), pid LIMIT {rows}),
al AS (SELECT (range + 0.5) / {steps}.0 AS a FROM range(0, {steps})),
g AS (SELECT te.*, bg.*, {", ".join(f"{h} AS h{k}" for k, h in enumerate(hazard))} FROM te, bg, al),
r AS ({cells}) SELECT pid, feature, {q6("shap", "shap")}, {q6("vals", "vals")}, CAST({tau} AS DOUBLE) AS timepoint FROM r"""


@query("attribute_survival", "J5", _attribution_sql(1095.0, 100, 8))
def attribute_survival(spark, sf):
    features = feature_arrays(spark, sf)
    surv = v_surv(spark, sf)
    background = Z.sample_background(features.join(surv.where("train").select("pid"), "pid", "left_semi"), 100)
    test = features.join(surv.where("NOT train").select("pid"), "pid", "left_semi")
    return rounded(Z.attribute(GIVEN, test, background, 1095.0), "shap", "vals")


_LEVELS = ["A", "N", "R", "missing", "A;N", "A;R", "N;R", "A;N;R"]


def _cluster_input(spark, sf):
    medians = A.median_by_level(A.collapse_one_hot(v_attributions(spark, sf)))
    return medians.where(F.col("text").isin(*_LEVELS))


@query("cluster_matrix", "J6 D20", f"""
WITH {COLLAPSE_SQL}, m AS (SELECT fname, text, quantile_cont(shap, 0.5) AS median FROM col WHERE text IN ({", ".join(f"'{v}'" for v in _LEVELS)}) GROUP BY fname, text)
SELECT fname, {", ".join(q6(f"COALESCE(MAX(CASE WHEN text = '{v}' THEN median END), 0)", f'"{v}"') for v in _LEVELS)} FROM m GROUP BY fname""")
def cluster_matrix(spark, sf):
    return rounded(Z.cluster_matrix(_cluster_input(spark, sf), _LEVELS), *_LEVELS)


@query("cluster_features", "J6 D16 D20")
def cluster_features(spark, sf):
    return rounded(Z.cluster_features(_cluster_input(spark, sf), _LEVELS, k=6), *_LEVELS)
