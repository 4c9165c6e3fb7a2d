"""Standard errors from influence values, and contrasts of every ablated model against the full one."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.operators import hazard as Z
from vitalspan.operators import influence as I
from vitalspan.operators import metrics as M
from vitalspan.plans.model_queries import _INPUT_SQL, GIVEN, NAMES, _curve_sql, _tau_sql, feature_arrays
from vitalspan.plans.registry import q6, query, rounded
from vitalspan.plans.survival_queries import _ERFC, CENS_SQL, TAUS, WEIGHT_SQL, interp_sql, km_sql, weighted
from vitalspan.plans.views import v_continuous, v_predictions, v_surv
from vitalspan.session import settle

_HORIZONS = (364.0, 730.0, 1095.0)
#: Columns that are set to their training medians, one model each, besides the full one.
_ABLATED = {"age": [0], "sex": [1], "season": [2], "age_sex": [0, 1], "age_season": [0, 2], "sex_season": [1, 2]}


def _ablated_sql() -> str:
    """SQL of the ablated models' survival values, as ``interp(model, pid, tau, pred)``."""
    medians = "md AS (SELECT quantile_cont(x1, 0.5) AS m1, quantile_cont(x2, 0.5) AS m2, quantile_cont(x3, 0.5) AS m3 FROM fx JOIN v_surv USING (pid) WHERE train)"
    chosen = {n: tuple(f"m{j + 1}" if j in own else f"x{j + 1}" for j in range(3)) for n, own in {"full": [], **_ABLATED}.items()}
    curves = ", ".join(_curve_sql(f"c_{n}", "fx, md", x) for n, x in chosen.items())
    rows = " UNION ALL ".join(
        f"SELECT pid, '{n}' AS model, CAST({t} AS DOUBLE) AS tau, round({_tau_sql(t)}, 9) AS pred FROM c_{n}" for n in chosen for t in _HORIZONS)
    values = ", ".join(f"({t})" for t in _HORIZONS)
    return f"taus AS (SELECT CAST(col0 AS DOUBLE) AS tau FROM (VALUES {values})), {_INPUT_SQL}, {medians}, {curves}, interp AS ({rows})"


def _ablated(spark, sf):
    """All patients under every ablated model, weighted at all horizons; values are rounded, so that equal ones are equal everywhere."""
    features = feature_arrays(spark, sf)
    train = features.join(v_surv(spark, sf).where("train").select("pid"), "pid", "left_semi")
    scored = Z.ablate_features(GIVEN, features, Z.training_medians(train, NAMES), _ABLATED, _HORIZONS)
    rows = scored.select("pid", F.col("feature").alias("model"), "tau", (1 - F.round("surv", 9)).alias("risk"))
    return M.ipcw(settle(rows), v_surv(spark, sf), list(_HORIZONS))


_KNOWN = """kn AS (SELECT *, CASE WHEN is_case THEN w ELSE 0 END AS a, CASE WHEN is_control THEN w ELSE 0 END AS b,
  COUNT(*) OVER (PARTITION BY model, tau) AS n FROM wt WHERE risk IS NOT NULL)"""
_ERROR = "CASE WHEN is_case THEN (1 - {0}) * (1 - {0}) * w WHEN is_control THEN {0} * {0} * w ELSE 0 END"
_PARTS = {
    "auc": """hh AS (SELECT *, SUM(b) OVER (PARTITION BY model, tau ORDER BY risk) - SUM(b) OVER (PARTITION BY model, tau, risk) / 2 AS h1,
  SUM(a) OVER (PARTITION BY model, tau ORDER BY risk DESC) - SUM(a) OVER (PARTITION BY model, tau, risk) / 2 AS h0,
  SUM(a) OVER (PARTITION BY model, tau) AS ta, SUM(b) OVER (PARTITION BY model, tau) AS tb FROM kn),
vv AS (SELECT *, SUM(a * h1) OVER (PARTITION BY model, tau) / (ta * tb) AS value FROM hh),
pp AS (SELECT *, n * ((a * h1 + b * h0) / (ta * tb) - value * (a / ta + b / tb)) AS p, 0.0 AS e FROM vv)""",
    "brier": f"""hh AS (SELECT *, {_ERROR.format('risk')} AS p FROM kn),
pp AS (SELECT *, AVG(p) OVER (PARTITION BY model, tau) AS e, AVG(p) OVER (PARTITION BY model, tau) AS value FROM hh)""",
    "ipa": f"""{km_sql("v_surv")}, nr AS (SELECT tau, 1 - COALESCE(arg_max(surv, time), 1) AS null_risk FROM taus LEFT JOIN km ON time <= tau GROUP BY tau),
hh AS (SELECT kn.*, {_ERROR.format('risk')} AS e1, {_ERROR.format('null_risk')} AS e0 FROM kn JOIN nr USING (tau)),
mm AS (SELECT *, AVG(e1) OVER (PARTITION BY model, tau) AS b1, AVG(e0) OVER (PARTITION BY model, tau) AS b0 FROM hh),
pp AS (SELECT *, b1 * e0 / (b0 * b0) - e1 / b0 AS p, 0.0 AS e, 1 - b1 / b0 AS value FROM mm)""",
}
_INFLUENCE = """tt AS (SELECT model, tau, time, COUNT(*) AS nt, SUM(CASE WHEN event THEN 1 ELSE 0 END) AS d, SUM(CASE WHEN is_case THEN p ELSE 0 END) AS s,
  MAX(n) AS n, MAX(e) AS e FROM pp GROUP BY model, tau, time),
qq AS (SELECT *, nt - d AS c, SUM(nt) OVER (PARTITION BY model, tau ORDER BY time DESC) - d AS q, SUM(s) OVER (PARTITION BY model, tau ORDER BY time) AS past FROM tt),
jj AS (SELECT *, CASE WHEN time <= tau AND c > 0 AND q > c THEN (e * n - past) / (q - c) ELSE 0 END AS jump,
  CASE WHEN time <= tau AND c > 0 AND q > c THEN (e * n - past) / (q - c) * c / q ELSE 0 END AS step FROM qq),
ll AS (SELECT *, SUM(step) OVER (PARTITION BY model, tau ORDER BY time) AS l FROM jj),
inf AS (SELECT pp.model, pp.tau, pid, value, pp.p - pp.e + CASE WHEN event THEN step - l ELSE jump - l END AS u
  FROM pp JOIN ll ON ll.model = pp.model AND ll.tau = pp.tau AND ll.time = pp.time)"""


def _influence_sql(source: str, metric: str) -> str:
    return f"WITH {source}, {CENS_SQL}, {WEIGHT_SQL}, {_KNOWN}, {_PARTS[metric]}, {_INFLUENCE}"


def _estimates_sql(source: str, metric: str) -> str:
    return f"""{_influence_sql(source, metric)}, st AS (SELECT model, tau, MAX(value) AS value, sqrt(SUM(u * u)) / COUNT(u) AS se FROM inf GROUP BY model, tau)
SELECT model, tau, {q6("value", "value")}, {q6("se", "se")}, {q6("value - 1.959963984540054 * se", "lower")}, {q6("value + 1.959963984540054 * se", "upper")} FROM st"""


def _contrasts_sql(metric: str) -> str:
    return f"""{_influence_sql(_ablated_sql(), metric)},
st AS (SELECT a.model, a.tau, MAX(a.value) AS value, MAX(a.value) - MAX(b.value) AS delta, sqrt(SUM((a.u - b.u) * (a.u - b.u))) / COUNT(a.u - b.u) AS se
  FROM inf a JOIN inf b ON a.tau = b.tau AND a.pid = b.pid AND b.model = 'full' WHERE a.model <> 'full' GROUP BY a.model, a.tau),
z AS (SELECT *, abs(delta / se) / sqrt(2) AS x, 1.0 / (1.0 + 0.5 * abs(delta / se) / sqrt(2)) AS t FROM st),
pv AS (SELECT *, {_ERFC} AS p FROM z),
bh AS (SELECT *, p * COUNT(*) OVER (PARTITION BY tau) / ROW_NUMBER() OVER (PARTITION BY tau ORDER BY p, model) AS raw, ROW_NUMBER() OVER (PARTITION BY tau ORDER BY p, model) AS rn FROM pv)
SELECT model, tau, {q6("value", "value")}, {q6("delta", "delta")}, {q6("se", "se")}, {q6("delta - 1.959963984540054 * se", "lower")},
  {q6("delta + 1.959963984540054 * se", "upper")}, {q6("p", "p")}, {q6("LEAST(1.0, MIN(raw) OVER (PARTITION BY tau ORDER BY rn DESC))", "p_adjusted")} FROM bh"""


def _contrasts(spark, sf, metric):
    values = I.influence(_ablated(spark, sf), ["model", "tau"], metric, surv=v_surv(spark, sf))
    return rounded(I.contrasts(values, "full"), "value", "delta", "se", "lower", "upper", "p", "p_adjusted")


@query("contrast_ablated_auc", "I16 I9 I17 J4", _contrasts_sql("auc"))
def contrast_ablated_auc(spark, sf):
    return _contrasts(spark, sf, "auc")


@query("contrast_ablated_brier", "I16 I10 I17 J4", _contrasts_sql("brier"))
def contrast_ablated_brier(spark, sf):
    return _contrasts(spark, sf, "brier")


@query("contrast_ablated_ipa", "I16 I10 I17 J4", _contrasts_sql("ipa"))
def contrast_ablated_ipa(spark, sf):
    return _contrasts(spark, sf, "ipa")


def _estimated(spark, sf, metric, preds=v_predictions, **options):
    values = I.influence(weighted(spark, sf, TAUS, preds=preds), ["model", "tau"], metric, surv=v_surv(spark, sf), **options)
    return rounded(I.estimates(values, ["model", "tau"]), "value", "se", "lower", "upper")


@query("auc_with_errors", "I9 I15", _estimates_sql(interp_sql(TAUS), "auc"))
def auc_with_errors(spark, sf):
    return _estimated(spark, sf, "auc")


@query("auc_with_errors_continuous", "I9 I15", _estimates_sql(interp_sql(TAUS).replace("v_predictions", "v_continuous"), "auc"))
def auc_with_errors_continuous(spark, sf):
    return _estimated(spark, sf, "auc", v_continuous, block_rows=200)


@query("brier_with_errors", "I10 I15", _estimates_sql(interp_sql(TAUS), "brier"))
def brier_with_errors(spark, sf):
    return _estimated(spark, sf, "brier")


@query("ipa_with_errors", "I10 I15", _estimates_sql(interp_sql(TAUS), "ipa"))
def ipa_with_errors(spark, sf):
    return _estimated(spark, sf, "ipa")
