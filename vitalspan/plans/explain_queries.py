"""Attribution and ablation of hazard models over sparse rows."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from vitalspan.operators import features as X
from vitalspan.operators import hazard as Z
from vitalspan.operators import hazard_explain as E
from vitalspan.operators import hazard_search as HS
from vitalspan.plans.cohort_queries import DIAG_SQL, diagnosis_events
from vitalspan.plans.model_queries import _INPUT_SQL, GIVEN, NAMES, feature_arrays
from vitalspan.plans.registry import q6, query, rounded
from vitalspan.plans.views import v_surv
from vitalspan.session import settle

_DRAWS, _STEPS, _TAU = 20, 8, 1095.0


def _drawn_sql() -> str:
    """Mean gradient of the interpolated survival between each patient and the training rows it draws."""
    times = GIVEN.breaks[1:]
    i = max(k for k, t in enumerate(times[:-1]) if t <= _TAU)
    share = (_TAU - times[i]) / (times[i + 1] - times[i])
    xs = range(1, len(NAMES) + 1)
    point = {j: f"(b{j} + a * (x{j} - b{j}))" for j in xs}
    hazard = [f"1 / (1 + exp(-({w[0]} + " + " + ".join(f"{w[j]} * {point[j]}" for j in xs) + ")))" for w in GIVEN.weights]
    survival = lambda n: " * ".join(f"(1 - h{k})" for k in range(n + 1))
    slope = lambda j, n: "(" + " + ".join(f"h{k} * {GIVEN.weights[k][j]}" for k in range(n + 1)) + f") * {survival(n)}"
    cells = " UNION ALL ".join(
        f"SELECT pid, '{NAMES[j - 1]}' AS feature, AVG(-(x{j} - b{j}) * ((1 - {share}) * {slope(j, i)} + {share} * {slope(j, i + 1)})) AS shap, MAX(x{j}) AS vals, MAX(abs(x{j}) + abs(b{j})) AS met FROM g GROUP BY pid" for j in xs)
    uniform = "CAST(CAST('0x' || substr(md5(CAST(pid AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"
    return f"""
WITH {_INPUT_SQL}, te AS (SELECT fx.* FROM fx JOIN v_surv USING (pid) WHERE NOT train),
tr AS (SELECT {", ".join(f"x{j} AS b{j}" for j in xs)}, ROW_NUMBER() OVER (ORDER BY md5(CAST(pid AS VARCHAR)), pid) - 1 AS rk, COUNT(*) OVER () AS n FROM fx JOIN v_surv USING (pid) WHERE train),
dr AS (SELECT te.*, CAST(floor({uniform} * (SELECT MAX(n) FROM tr)) AS BIGINT) AS rk FROM te, range(0, {_DRAWS}) r(j)),
al AS (SELECT (range + 0.5) / {_STEPS}.0 AS a FROM range(0, {_STEPS})),
g AS (SELECT dr.pid, {", ".join(f"x{j}, b{j}" for j in xs)}, {", ".join(f"{h} AS h{k}" for k, h in enumerate(hazard))} FROM dr JOIN tr USING (rk), al),
r AS ({cells}) SELECT pid, feature, {q6("shap", "shap")}, {q6("vals", "vals")}, CAST({_TAU} AS DOUBLE) AS timepoint FROM r WHERE met > 0"""


@query("attribute_survival_drawn", "J5", _drawn_sql())
def attribute_survival_drawn(spark, sf):
    """Backgrounds drawn by each test patient from all training patients."""
    arrays = feature_arrays(spark, sf)
    names = F.array(*[F.lit(n) for n in NAMES])
    long = arrays.select("pid", F.inline(F.arrays_zip(names.alias("feature"), F.col("features").alias("value"))))
    vocabulary = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "feature string, column_index int")
    rows = settle(HS.sparse_cells(long, vocabulary, v_surv(spark, sf).select("pid", "train").join(arrays.select("pid"), "pid")))
    out = E.attribute_drawn(GIVEN, rows.where("NOT train"), rows.where("train"), _TAU, _DRAWS, _STEPS)
    return rounded(out, "shap", "vals")


#: Times of a model over the codes of study 001, whose weights are numbers made from the codes' names.
_CODE_BREAKS = [0.0, 100.0, 365.0, 800.0, 1300.0, 1900.0]


def _named_weight(interval: int, feature: str) -> float:
    return (int(hashlib.md5(f"{interval}:{feature}".encode()).hexdigest()[:6], 16) % 200 - 100) / 100


def _ablation_summary_sql() -> str:
    times = _CODE_BREAKS[1:]
    taus = []
    for tau in Z.ABLATION_TAUS:
        i = max(k for k, t in enumerate(times[:-1]) if t <= tau)
        taus.append(f"({tau}, {i}, {(tau - times[i]) / (times[i + 1] - times[i])})")
    return f"""
WITH {DIAG_SQL}, f AS (SELECT DISTINCT 'diag-simple_' || code AS feature FROM diag WHERE level = 'lvl3' AND time > -3650.0),
h AS (SELECT DISTINCT pid, 'diag-simple_' || code AS feature, 1 AS has FROM diag WHERE level = 'lvl3' AND time > -3650.0),
x AS (SELECT s.pid, s.train, f.feature, CAST(COALESCE(h.has, 0) AS DOUBLE) AS value FROM v_surv s CROSS JOIN f LEFT JOIN h ON h.pid = s.pid AND h.feature = f.feature),
md AS (SELECT feature, quantile_cont(value, 0.5) AS m FROM x WHERE train GROUP BY feature),
w AS (SELECT CAST(k AS INTEGER) AS k, feature, (CAST('0x' || substr(md5(CAST(k AS VARCHAR) || ':' || feature), 1, 6) AS BIGINT) % 200 - 100) / 100.0 AS w FROM range(0, {len(times)}) r(k), f),
z AS (SELECT pid, k, -2.5 + 0.2 * k + SUM(w * value) AS z FROM x JOIN w USING (feature) GROUP BY pid, k),
v AS (SELECT x.pid, x.train, x.feature, w.k, z.z AS z0, z.z + w.w * (md.m - x.value) AS z1 FROM x JOIN w USING (feature) JOIN z ON z.pid = x.pid AND z.k = w.k JOIN md ON md.feature = x.feature),
s AS (SELECT pid, train, feature, k, exp(SUM(-ln(1 + exp(z0))) OVER o) AS s0, exp(SUM(-ln(1 + exp(z1))) OVER o) AS s1 FROM v WINDOW o AS (PARTITION BY pid, feature ORDER BY k)),
taus AS (SELECT CAST(col0 AS DOUBLE) AS tau, col1 AS i, CAST(col2 AS DOUBLE) AS share FROM (VALUES {", ".join(taus)})),
d AS (SELECT pid, train, feature, tau, SUM(CASE WHEN k = i THEN (1 - share) * (s1 - s0) WHEN k = i + 1 THEN share * (s1 - s0) ELSE 0 END) AS delta FROM s, taus GROUP BY pid, train, feature, tau)
SELECT train, feature, tau, COUNT(*) AS n, {q6("AVG(delta)", "mean_delta")}, {q6("AVG(abs(delta))", "mean_abs_delta")} FROM d GROUP BY train, feature, tau"""


@query("ablation_summary", "J4 I6 D16 H20", _ablation_summary_sql())
def ablation_summary(spark, sf):
    """All codes of study 001 at all horizons, by split: mean and absolute change of survival without the code."""
    surv = v_surv(spark, sf)
    sources = {"diagnoses": settle(diagnosis_events(spark, sf))}
    long = settle(X.study_features(sources, surv, "001"))
    vocabulary = settle(X.study_vocabulary(sources, long, "001"))
    names = [r["feature"] for r in vocabulary.orderBy("column_index").collect()]  # as many as coefficients of an interval
    weights = np.array([[-2.5 + 0.2 * k, *(_named_weight(k, n) for n in names)] for k in range(len(_CODE_BREAKS) - 1)])
    model = Z.HazardModel(_CODE_BREAKS, names, weights)
    rows = settle(HS.sparse_cells(long, vocabulary, surv.select("pid", "train")))
    medians = E.sparse_medians(rows.where("train"), len(names) + 1)
    out = E.ablation_summary(model, rows, medians, {n: [i + 1] for i, n in enumerate(names)}, by=["train"])
    return rounded(out, "mean_delta", "mean_abs_delta")
