"""Survival statistics and prediction metrics over the patient views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalspan.functions import scalars as S
from vitalspan.operators import metrics as M
from vitalspan.operators import resample as B
from vitalspan.operators import survival as V
from vitalspan.plans.registry import ENTRIES, longs, q6, query, r6, rounded
from vitalspan.plans.views import v_baseline, v_continuous, v_predictions, v_surv

TAUS = [182.5, 365.0, 730.0, 1095.0]
GRID = [365 * (0.5 + 0.125 * i) for i in range(37)]


def km_sql(source: str, by: str = "", name: str = "km") -> str:
    """SQL of the product-limit estimate as common table expressions named ``{name}_t/_r`` and ``{name}``."""
    part, keys = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""
{name}_t AS (SELECT {keys}time, COUNT(*) AS n, SUM(CASE WHEN event THEN 1 ELSE 0 END) AS d FROM {source} GROUP BY {keys}time),
{name}_r AS (SELECT *, SUM(n) OVER ({part}ORDER BY time DESC) AS n_risk FROM {name}_t),
{name}_v AS (SELECT *, SUM(CASE WHEN d < n_risk THEN ln(1 - d / CAST(n_risk AS DOUBLE)) ELSE 0 END) OVER ({part}ORDER BY time) AS ls,
  SUM(CASE WHEN d < n_risk THEN d / (CAST(n_risk AS DOUBLE) * (n_risk - d)) ELSE 0 END) OVER ({part}ORDER BY time) AS va FROM {name}_r),
{name} AS (SELECT {keys}time, n_risk, d, CASE WHEN d = n_risk THEN 0 ELSE exp(ls) END AS surv,
  CASE WHEN d < n_risk THEN exp(ls) * exp(-1.959963984540054 * sqrt(va)) END AS lower,
  CASE WHEN d < n_risk THEN least(1.0, exp(ls) * exp(1.959963984540054 * sqrt(va))) END AS upper FROM {name}_v)"""


def interp_sql(taus, by: str = "model, pid") -> str:
    """SQL of the piecewise-linear value at each horizon, as ``interp(model, pid, tau, pred)``; NULL outside the grid."""
    values = ", ".join(f"({t})" for t in taus)
    return f"""
taus AS (SELECT CAST(col0 AS DOUBLE) AS tau FROM (VALUES {values})),
nb AS (SELECT {by}, tau, MAX(CASE WHEN time <= tau THEN time END) AS t1, MIN(CASE WHEN time >= tau THEN time END) AS t2,
  arg_max(CASE WHEN time <= tau THEN surv END, CASE WHEN time <= tau THEN time END) AS s1,
  arg_min(CASE WHEN time >= tau THEN surv END, CASE WHEN time >= tau THEN time END) AS s2 FROM v_predictions, taus GROUP BY {by}, tau),
interp AS (SELECT {by}, tau, CASE WHEN t1 IS NULL OR t2 IS NULL THEN NULL WHEN t1 = t2 THEN s1 ELSE s1 + (s2 - s1) * (tau - t1) / (t2 - t1) END AS pred FROM nb)"""


def cuts_sql(source: str, value: str, n: int) -> str:
    """SQL of the exact interior quantile cut-points per model and horizon, as ``qs(model, tau, q)``."""
    return f"""
rn AS (SELECT model, tau, {value} AS x, ROW_NUMBER() OVER (PARTITION BY model, tau ORDER BY {value}) - 1 AS i, COUNT(*) OVER (PARTITION BY model, tau) AS n FROM {source} WHERE {value} IS NOT NULL),
hs AS (SELECT model, tau, k, MAX(CAST(n - 1 AS DOUBLE) * (k / {n}.0)) AS h FROM rn, (SELECT range AS k FROM range(1, {n})) GROUP BY model, tau, k),
cp AS (SELECT hs.model, hs.tau, k, lo.x + (h - floor(h)) * (hi.x - lo.x) AS c FROM hs JOIN rn lo ON lo.model = hs.model AND lo.tau = hs.tau AND lo.i = floor(h)
  JOIN rn hi ON hi.model = hs.model AND hi.tau = hs.tau AND hi.i = ceil(h)),
qs AS (SELECT model, tau, list(c) AS q FROM cp GROUP BY model, tau)"""


CENS_SQL = """
cens_t AS (SELECT time, COUNT(*) AS n, SUM(CASE WHEN event THEN 1 ELSE 0 END) AS d FROM v_surv GROUP BY time),
cens_r AS (SELECT *, n - d AS c, SUM(n) OVER (ORDER BY time DESC) - d AS r FROM cens_t),
cens AS (SELECT time, CASE WHEN c > 0 AND c = r THEN 0 ELSE exp(SUM(CASE WHEN c > 0 AND c < r THEN ln(1 - c / CAST(r AS DOUBLE)) ELSE 0 END) OVER (ORDER BY time)) END AS g,
  exp(COALESCE(SUM(CASE WHEN c > 0 AND c < r THEN ln(1 - c / CAST(r AS DOUBLE)) ELSE 0 END) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g_before FROM cens_r)"""

WEIGHT_SQL = """
g_tau AS (SELECT tau, COALESCE(arg_max(CASE WHEN time <= tau THEN g END, CASE WHEN time <= tau THEN time END), 1) AS g_tau FROM cens, taus GROUP BY tau),
wt AS (SELECT i.*, 1 - i.pred AS risk, s.time, s.event, (s.event AND s.time <= i.tau) AS is_case, s.time > i.tau AS is_control,
  CASE WHEN s.event AND s.time <= i.tau THEN 1 / c.g_before WHEN s.time > i.tau THEN 1 / g.g_tau ELSE 0 END AS w
  FROM interp i JOIN v_surv s ON s.pid = i.pid JOIN cens c ON c.time = s.time JOIN g_tau g ON g.tau = i.tau)"""


def auc_sql(by: str, source: str = "wt", weight: str = "w") -> str:
    return f"""
sc AS (SELECT {by}, risk, SUM(CASE WHEN is_case THEN {weight} ELSE 0 END) AS cw, SUM(CASE WHEN is_control THEN {weight} ELSE 0 END) AS kw
  FROM {source} WHERE risk IS NOT NULL GROUP BY {by}, risk),
rk AS (SELECT *, SUM(kw) OVER (PARTITION BY {by} ORDER BY risk) AS below FROM sc),
auc AS (SELECT {by}, CASE WHEN SUM(cw) * SUM(kw) > 0 THEN SUM(cw * (below - kw / 2)) / (SUM(cw) * SUM(kw)) END AS auc FROM rk GROUP BY {by})"""


def predicted(spark, sf, taus, preds=v_predictions):
    return V.interpolate_at(preds(spark, sf), ["model", "pid"], taus)


def weighted(spark, sf, taus, strata=(), preds=v_predictions):
    scored = predicted(spark, sf, taus, preds).withColumn("risk", 1 - F.col("pred"))
    return M.ipcw(scored, v_surv(spark, sf), taus, strata)


RISK_CASE = """CASE WHEN pred > 0 AND pred <= 0.5 THEN '(0,0.5]' WHEN pred > 0.5 AND pred <= 0.75 THEN '(0.5,0.75]' WHEN pred > 0.75 AND pred <= 0.875 THEN '(0.75,0.875]'
  WHEN pred > 0.875 AND pred <= 0.95 THEN '(0.875,0.95]' WHEN pred > 0.95 AND pred <= 1 THEN '(0.95,1]' END"""


@query("km_by_risk_group", "H3 B24 I7 I1 I6 C1", f"""
WITH {interp_sql([1825.0])},
src AS (SELECT {RISK_CASE} AS risk_group, LEAST(s.time, 1095) AS time, CASE WHEN s.time > 1095 THEN FALSE ELSE s.event END AS event
  FROM interp i JOIN v_surv s ON s.pid = i.pid WHERE i.model = '006'),
{km_sql("src", "risk_group")}
SELECT risk_group, time, CAST(n_risk AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event, {q6("surv", "surv")}, {q6("lower", "lower")}, {q6("upper", "upper")} FROM km""")
def km_by_risk_group(spark, sf):
    groups = V.risk_strata(
        V.interpolate_at(v_predictions(spark, sf).where(F.col("model") == "006"), ["model", "pid"], [1825.0]), "pred")
    rows = v_surv(spark, sf).join(groups, "pid")
    time, event = S.censor_at("time", "event", F.lit(1095).cast("bigint"))
    curve = V.kaplan_meier(rows.withColumns({"time": time, "event": event}), ["risk_group"])
    return rounded(longs(curve.drop("surv_before"), "n_risk", "n_event"), "surv", "lower", "upper")


@query("kaplan_meier_by_split", "I1", f"""
WITH {km_sql("v_surv", "train")}, pad AS (SELECT train, time, n_risk, d, surv, lower, upper FROM km
  UNION ALL SELECT train, 0, MAX(n_risk), 0, 1, 1, 1 FROM km GROUP BY train)
SELECT train, CAST(time AS BIGINT) AS time, CAST(n_risk AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event, {q6("surv", "surv")}, {q6("lower", "lower")}, {q6("upper", "upper")} FROM pad""")
def kaplan_meier_by_split(spark, sf):
    curve = V.kaplan_meier(v_surv(spark, sf), ["train"], leading_row=True).drop("surv_before")
    return rounded(longs(curve, "time", "n_risk", "n_event"), "surv", "lower", "upper")


_KM_TAUS = [0.0, 100.0, 365.0, 730.0, 1095.0, 1825.0]


@query("km_at_horizons", "I2 C14", f"""
WITH {km_sql("v_surv", "train")}, h AS (SELECT CAST(col0 AS DOUBLE) AS tau FROM (VALUES {", ".join(f"({t})" for t in _KM_TAUS)})),
g AS (SELECT train, tau, MAX(CASE WHEN time <= tau THEN time END) AS t1 FROM km, h GROUP BY train, tau)
SELECT g.train, g.tau, {q6("CASE WHEN g.t1 IS NULL THEN 1 ELSE km.surv END", "surv")}, {q6("CASE WHEN g.t1 IS NULL THEN 1 ELSE km.lower END", "lower")},
  {q6("CASE WHEN g.t1 IS NULL THEN 1 ELSE km.upper END", "upper")}
FROM g LEFT JOIN km ON km.train = g.train AND km.time = g.t1""")
def km_at_horizons(spark, sf):
    curve = V.kaplan_meier(v_surv(spark, sf), ["train"])
    return rounded(V.km_at(curve, ["train"], _KM_TAUS), "surv", "lower", "upper")


@query("rmst_by_split", "I3", f"""
WITH {km_sql("v_surv", "train")}, s AS (SELECT train, time, surv, LEAD(time, 1, 999999) OVER (PARTITION BY train ORDER BY time) AS nxt,
  MIN(time) OVER (PARTITION BY train) AS t0 FROM km)
SELECT train, {q6("LEAST(MIN(t0), 1095) + SUM(CASE WHEN time < 1095 THEN surv * (LEAST(nxt, 1095) - time) ELSE 0 END)", "rmst")} FROM s GROUP BY train""")
def rmst_by_split(spark, sf):
    curve = V.kaplan_meier(v_surv(spark, sf), ["train"])
    return rounded(V.rmst(curve, ["train"], 1095.0), "rmst")


_ERFC = """(1.0 / (1.0 + 0.5 * x)) * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))"""


@query("logrank_split", "I4 B24", f"""
WITH s AS (SELECT train, CASE WHEN time > 1095 THEN 1095 ELSE time END AS time, CASE WHEN time > 1095 THEN FALSE ELSE event END AS event FROM v_surv),
t AS (SELECT time, COUNT(*) AS n, COUNT(*) FILTER (WHERE train) AS n1, COUNT(*) FILTER (WHERE event) AS d, COUNT(*) FILTER (WHERE event AND train) AS d1 FROM s GROUP BY time),
r AS (SELECT *, CAST(SUM(n) OVER (ORDER BY time DESC) AS DOUBLE) AS r, CAST(SUM(n1) OVER (ORDER BY time DESC) AS DOUBLE) AS r1 FROM t),
u AS (SELECT SUM(n1) AS n_1, SUM(n) - SUM(n1) AS n_2, SUM(d1) AS o1, SUM(d) - SUM(d1) AS o2, SUM(d * r1 / r) AS e1, SUM(d) - SUM(d * r1 / r) AS e2,
  SUM(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM r),
c AS (SELECT *, (o1 - e1) * (o1 - e1) / v AS chisq, sqrt((o1 - e1) * (o1 - e1) / v) / sqrt(2) AS x FROM u), z AS (SELECT *, 1.0 / (1.0 + 0.5 * x) AS t FROM c)
SELECT CAST(n_1 AS BIGINT) AS n_1, CAST(n_2 AS BIGINT) AS n_2, CAST(o1 AS BIGINT) AS observed_1, CAST(o2 AS BIGINT) AS observed_2,
  {q6("e1", "expected_1")}, {q6("e2", "expected_2")}, {q6("chisq", "chisq")}, {q6(_ERFC, "p")} FROM z""")
def logrank_split(spark, sf):
    time, event = S.censor_at("time", "event", F.lit(1095).cast("bigint"))
    out = V.logrank(v_surv(spark, sf).withColumns({"time": time, "event": event}), "train", [True, False])
    return rounded(longs(out, "n_1", "n_2", "observed_1", "observed_2"), "expected_1", "expected_2", "chisq", "p")


@query("hazard_to_survival", "I5 D22 E6", f"SELECT model, pid, time, {q6('surv', 'surv')} FROM v_predictions")
def hazard_to_survival(spark, sf):
    w = Window.partitionBy("model", "pid").orderBy("time")  # 25 breaks per curve
    rows = v_predictions(spark, sf).withColumn("hazard", 1 - F.col("surv") / F.lag("surv", 1, 1.0).over(w))
    curves = rows.groupBy("model", "pid").agg(F.array_sort(F.collect_list(F.struct("time", "hazard"))).alias("c"))
    surv = V.hazard_to_survival(F.transform("c", lambda p: p["hazard"]))
    pairs = F.arrays_zip(F.transform("c", lambda p: p["time"]).alias("time"), surv.alias("surv"))
    return rounded(curves.select("model", "pid", F.inline(pairs)), "surv")


_INTERP_TAUS = [10.0, 20.0, 182.5, 365.0, 1095.0, 1825.0, 2000.0]


@query("interp_survival", "I6 C14", f"WITH {interp_sql(_INTERP_TAUS)} SELECT model, pid, tau, {q6('pred', 'pred')} FROM interp")
def interp_survival(spark, sf):
    return rounded(predicted(spark, sf, _INTERP_TAUS), "pred")


@query("interp_survival_clamped", "I6", f"""
WITH {interp_sql([10.0, 2000.0])}, ends AS (SELECT model, pid, arg_min(surv, time) AS s_first, arg_max(surv, time) AS s_last FROM v_predictions GROUP BY model, pid)
SELECT i.model, i.pid, tau, {q6("COALESCE(pred, CASE WHEN tau < 20 THEN s_first ELSE s_last END)", "pred")} FROM interp i JOIN ends e ON e.model = i.model AND e.pid = i.pid""")
def interp_survival_clamped(spark, sf):
    return rounded(V.interpolate_at(v_predictions(spark, sf), ["model", "pid"], [10.0, 2000.0], clamp=True), "pred")


@query("risk_strata_sizes", "I7 B23 D5", f"WITH {interp_sql([365.0, 1825.0])} SELECT model, tau, {RISK_CASE} AS risk_group, COUNT(*) AS n FROM interp GROUP BY 1, 2, 3")
def risk_strata_sizes(spark, sf):
    return V.strata_sizes(V.risk_strata(predicted(spark, sf, [365.0, 1825.0])), ["model", "tau"])


_C_TAUS = [365.0, 1095.0]


@query("concordance", "I8 B24", f"""
WITH {interp_sql(_C_TAUS)},
s AS (SELECT i.model, i.tau, i.pid, 1 - i.pred AS risk, CASE WHEN s.time > i.tau THEN CAST(i.tau AS BIGINT) ELSE s.time END AS time,
  CASE WHEN s.time > i.tau THEN FALSE ELSE s.event END AS event FROM interp i JOIN v_surv s ON s.pid = i.pid),
p AS (SELECT a.model, a.tau, COUNT(*) AS pairs, SUM(CASE WHEN a.risk > b.risk THEN 1 ELSE 0 END) AS conc, SUM(CASE WHEN a.risk = b.risk THEN 1 ELSE 0 END) AS tied
  FROM s a JOIN s b ON a.model = b.model AND a.tau = b.tau AND a.event AND (a.time < b.time OR (a.time = b.time AND NOT b.event)) GROUP BY a.model, a.tau)
SELECT model, tau, CAST(pairs AS BIGINT) AS pairs, CAST(conc AS BIGINT) AS concordant, CAST(tied AS BIGINT) AS tied,
  {q6("(conc + tied / 2.0) / pairs", "c_index")}, {q6("((conc + tied / 2.0) / pairs - 0.5) * 2", "dxy")} FROM p""")
def concordance(spark, sf, preds=v_predictions, **options):
    rows = predicted(spark, sf, _C_TAUS, preds).join(v_surv(spark, sf), "pid").withColumn("risk", 1 - F.col("pred"))
    time, event = S.censor_at("time", "event", F.col("tau").cast("bigint"))
    out = M.concordance(rows.withColumns({"time": time, "event": event}), ["model", "tau"], **options)
    return rounded(longs(out, "pairs", "concordant", "tied"), "c_index", "dxy")


@query("td_auc", "I9 M4", f"WITH {interp_sql(TAUS)}, {CENS_SQL}, {WEIGHT_SQL}, {auc_sql('model, tau')} SELECT model, tau, {q6('auc', 'auc')} FROM auc")
def td_auc(spark, sf, preds=v_predictions, **options):
    return rounded(M.td_auc(weighted(spark, sf, TAUS, preds=preds), ["model", "tau"], **options), "auc")


@query("td_roc", "I9", f"""
WITH {interp_sql([1095.0])}, {CENS_SQL}, {WEIGHT_SQL}, {auc_sql('model, tau')},
tot AS (SELECT model, tau, SUM(cw) AS c, SUM(kw) AS k FROM sc GROUP BY model, tau),
cum AS (SELECT model, tau, risk, SUM(cw) OVER (PARTITION BY model, tau ORDER BY risk DESC) AS tp, SUM(kw) OVER (PARTITION BY model, tau ORDER BY risk DESC) AS fp FROM sc)
SELECT cum.model, cum.tau, {q6('risk', 'risk')}, {q6('tp / c', 'tpr')}, {q6('fp / k', 'fpr')} FROM cum JOIN tot ON tot.model = cum.model AND tot.tau = cum.tau""")
def td_roc(spark, sf, preds=v_predictions, **options):
    return rounded(M.td_roc(weighted(spark, sf, [1095.0], preds=preds), ["model", "tau"], **options), "risk", "tpr", "fpr")


@query("brier_ipa", "I10", f"""
WITH {interp_sql(TAUS)}, {CENS_SQL}, {WEIGHT_SQL}, {km_sql("v_surv")},
nul AS (SELECT tau, 1 - COALESCE(arg_max(CASE WHEN time <= tau THEN surv END, CASE WHEN time <= tau THEN time END), 1) AS p0 FROM km, taus GROUP BY tau),
b AS (SELECT model, wt.tau, AVG(CASE WHEN is_case THEN (1 - risk) * (1 - risk) WHEN is_control THEN risk * risk ELSE 0 END * w) AS brier,
  AVG(CASE WHEN is_case THEN (1 - p0) * (1 - p0) WHEN is_control THEN p0 * p0 ELSE 0 END * w) AS null_brier FROM wt JOIN nul ON nul.tau = wt.tau WHERE risk IS NOT NULL GROUP BY model, wt.tau)
SELECT model, tau, {q6('brier', 'brier')}, {q6('null_brier', 'null_brier')}, {q6('1 - brier / null_brier', 'ipa')} FROM b""")
def brier_ipa(spark, sf):
    out = M.brier_ipa(weighted(spark, sf, TAUS), v_surv(spark, sf), ["model", "tau"], TAUS)
    return rounded(out, "brier", "null_brier", "ipa")


@query("auc_over_time", "I11 C14", f"WITH {interp_sql(GRID)}, {CENS_SQL}, {WEIGHT_SQL}, {auc_sql('model, tau')} SELECT model, tau, {q6('auc', 'auc')} FROM auc")
def auc_over_time(spark, sf):
    return rounded(M.td_auc(weighted(spark, sf, GRID), ["model", "tau"]), "auc")


@query("calibration_20", "I12 E9 I1 I2", f"""
WITH {interp_sql([365.0, 1095.0])},
ij AS (SELECT i.*, s.time, s.event FROM interp i JOIN v_surv s ON s.pid = i.pid),
{cuts_sql("ij", "pred", 20)},
st AS (SELECT i.model, i.tau, i.pid, i.pred, 1 + len(list_filter(q, lambda c: c < i.pred)) AS stratum, i.time, i.event
  FROM ij i JOIN qs ON qs.model = i.model AND qs.tau = i.tau),
{km_sql("st", "model, tau, stratum")},
g AS (SELECT model, tau, stratum, MAX(CASE WHEN time <= tau THEN time END) AS t1, MAX(time) AS last FROM km GROUP BY model, tau, stratum),
m AS (SELECT model, tau, stratum, AVG(pred) AS pred, COUNT(*) AS n FROM st GROUP BY model, tau, stratum)
SELECT m.model, m.tau, CAST(m.stratum AS INTEGER) AS stratum, n, {q6("pred", "pred")},
  {q6("CASE WHEN last < m.tau THEN NULL WHEN t1 IS NULL THEN 1 ELSE surv END", "surv")}, {q6("CASE WHEN last < m.tau THEN NULL WHEN t1 IS NULL THEN 1 ELSE lower END", "lower")},
  {q6("CASE WHEN last < m.tau THEN NULL WHEN t1 IS NULL THEN 1 ELSE upper END", "upper")}
FROM m JOIN g ON g.model = m.model AND g.tau = m.tau AND g.stratum = m.stratum LEFT JOIN km ON km.model = m.model AND km.tau = m.tau AND km.stratum = m.stratum AND km.time = g.t1""")
def calibration_20(spark, sf, preds=v_predictions):
    scored = predicted(spark, sf, [365.0, 1095.0], preds).join(v_surv(spark, sf), "pid")
    return rounded(M.calibration_quantile(scored, ["model", "tau"]), "pred", "surv", "lower", "upper")


@query("calibration_curve_overall", "I13", f"""
WITH {km_sql("v_surv")}, m AS (SELECT model, time AS tau, AVG(p.surv) AS predicted FROM v_predictions p JOIN v_surv s USING (pid) GROUP BY model, p.time),
x AS (SELECT m.tau, MAX(CASE WHEN km.time <= m.tau THEN km.time END) AS t1 FROM (SELECT DISTINCT tau FROM m) m, km GROUP BY m.tau)
SELECT m.model, m.tau, {q6("predicted", "predicted")}, {q6("COALESCE(km.surv, 1)", "observed")}, {q6("CASE WHEN t1 IS NULL THEN 1 ELSE km.lower END", "lower")},
  {q6("CASE WHEN t1 IS NULL THEN 1 ELSE km.upper END", "upper")} FROM m JOIN x ON x.tau = m.tau LEFT JOIN km ON km.time = x.t1""".replace("SELECT model, time AS tau", "SELECT model, p.time AS tau"))
def calibration_curve_overall(spark, sf):
    surv = v_surv(spark, sf)
    predictions = v_predictions(spark, sf).join(surv.select("pid"), "pid", "left_semi")
    mean = predictions.groupBy("model", F.col("time").alias("tau")).agg(F.avg("surv").alias("predicted"))
    times = [float(n * 80 + 20) for n in range(25)]
    observed = V.km_at(V.kaplan_meier(surv), [], times).withColumnRenamed("surv", "observed")
    return rounded(mean.join(observed, "tau"), "predicted", "observed", "lower", "upper")


@query("calibration_curve_by_stratum", "I13 I7", f"""
WITH {interp_sql([1825.0])}, grp AS (SELECT pid, {RISK_CASE} AS risk_group FROM interp WHERE model = '006'),
src AS (SELECT s.*, g.risk_group FROM v_surv s JOIN grp g ON g.pid = s.pid), {km_sql("src", "risk_group")},
m AS (SELECT g.risk_group, p.time AS tau, AVG(p.surv) AS predicted FROM v_predictions p JOIN src g ON g.pid = p.pid WHERE p.model = '006' GROUP BY g.risk_group, p.time),
x AS (SELECT m.risk_group, m.tau, MAX(CASE WHEN km.time <= m.tau THEN km.time END) AS t1 FROM m JOIN km ON km.risk_group = m.risk_group GROUP BY m.risk_group, m.tau)
SELECT m.risk_group, m.tau, {q6("predicted", "predicted")}, {q6("COALESCE(km.surv, 1)", "observed")}, {q6("CASE WHEN t1 IS NULL THEN 1 ELSE km.lower END", "lower")},
  {q6("CASE WHEN t1 IS NULL THEN 1 ELSE km.upper END", "upper")}
FROM m JOIN x ON x.tau = m.tau AND x.risk_group = m.risk_group LEFT JOIN km ON km.time = x.t1 AND km.risk_group = m.risk_group""")
def calibration_curve_by_stratum(spark, sf):
    preds = v_predictions(spark, sf).where(F.col("model") == "006")
    groups = V.risk_strata(V.interpolate_at(preds, ["pid"], [1825.0])).select("pid", "risk_group")
    surv = v_surv(spark, sf).join(groups, "pid")
    rows = preds.join(surv.select("pid", "risk_group"), "pid")
    out = M.calibration_curve(rows, surv, ["risk_group"], [float(n * 80 + 20) for n in range(25)])
    return rounded(out, "predicted", "observed", "lower", "upper")


@query("calibration_area", "I14", f"""
WITH {interp_sql([1095.0])}, s AS (SELECT i.model, i.tau, 1 - i.pred AS risk, s.event AND s.time <= i.tau AS event FROM interp i JOIN v_surv s ON s.pid = i.pid),
{cuts_sql("s", "risk", 20)},
st AS (SELECT s.*, 1 + len(list_filter(q, lambda c: c < s.risk)) AS stratum FROM s JOIN qs ON qs.model = s.model AND qs.tau = s.tau),
b AS (SELECT model, tau, stratum, AVG(risk) AS x, AVG(CASE WHEN event THEN 1.0 ELSE 0.0 END) AS y FROM st GROUP BY model, tau, stratum),
l AS (SELECT *, LEAD(x) OVER (PARTITION BY model, tau ORDER BY stratum) AS x1, LEAD(x - y) OVER (PARTITION BY model, tau ORDER BY stratum) AS g1 FROM b)
SELECT model, tau, {q6("1 - SUM((x1 - x) * (x - y + g1) / 2)", "calibration")} FROM l GROUP BY model, tau""")
def calibration_area(spark, sf):
    rows = predicted(spark, sf, [1095.0]).join(v_surv(spark, sf), "pid")
    rows = rows.withColumns({"risk": 1 - F.col("pred"), "event": F.col("event") & (F.col("time") <= F.col("tau"))})
    return rounded(M.calibration_area(rows, ["model", "tau"]), "calibration")


_POISSON = " + ".join(f"(CASE WHEN u >= {p} THEN 1 ELSE 0 END)" for p in B.POISSON_CDF)


def boot_sql(source: str, n: int, key: str = "pid") -> str:
    """SQL of the replicate weights."""
    return f"""
reps AS (SELECT CAST(range AS INTEGER) AS replicate FROM range(0, {n + 1})),
un AS (SELECT k.{key}, r.replicate, CAST(CAST('0x' || substr(md5(CAST(k.{key} AS VARCHAR) || ':' || CAST(r.replicate AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u
  FROM (SELECT DISTINCT {key} FROM {source}) k, reps r),
bw AS (SELECT {key}, replicate, CASE WHEN replicate = 0 THEN 1 ELSE {_POISSON} END AS w_boot FROM un),
bs AS (SELECT s.*, b.replicate, b.w_boot FROM {source} s JOIN bw b ON b.{key} = s.{key} WHERE b.w_boot > 0)"""


@query("bootstrap_mean_prediction", "I15 M3", f"""
WITH {interp_sql([365.0, 1825.0])}, {boot_sql("interp", 200)},
m AS (SELECT model, tau, replicate, SUM(pred * w_boot) / SUM(w_boot) AS m FROM bs GROUP BY model, tau, replicate)
SELECT model, tau, {q6("MAX(CASE WHEN replicate = 0 THEN m END)", "estimate")}, {q6("quantile_cont(m, 0.025) FILTER (WHERE replicate > 0)", "lower")},
  {q6("quantile_cont(m, 0.975) FILTER (WHERE replicate > 0)", "upper")}, {q6("stddev_samp(m) FILTER (WHERE replicate > 0)", "se")} FROM m GROUP BY model, tau""")
def bootstrap_mean_prediction(spark, sf):
    out = B.bootstrap_mean(predicted(spark, sf, [365.0, 1825.0]), ["model", "tau"], "pred", "pid", 200)
    return rounded(out, "estimate", "lower", "upper", "se")


@query("bootstrap_auc", "I15 I9", f"""
WITH {interp_sql([365.0, 1095.0])}, {CENS_SQL}, {WEIGHT_SQL}, {boot_sql("wt", 100)}, bx AS (SELECT *, w * w_boot AS ww FROM bs), {auc_sql("model, tau, replicate", "bx", "ww")}
SELECT model, tau, {q6("MAX(CASE WHEN replicate = 0 THEN auc END)", "estimate")}, {q6("quantile_cont(auc, 0.025) FILTER (WHERE replicate > 0)", "lower")},
  {q6("quantile_cont(auc, 0.975) FILTER (WHERE replicate > 0)", "upper")}, {q6("stddev_samp(auc) FILTER (WHERE replicate > 0)", "se")} FROM auc GROUP BY model, tau""")
def bootstrap_auc(spark, sf, preds=v_predictions):
    out = B.bootstrap_ci(weighted(spark, sf, [365.0, 1095.0], preds=preds), ["model", "tau"], "auc", 100)
    return rounded(out, "estimate", "lower", "upper", "se")


@query("bootstrap_calibration", "I15 I14", f"""
WITH {interp_sql([1095.0])}, s AS (SELECT i.model, i.tau, i.pid, 1 - i.pred AS risk, s.event AND s.time <= i.tau AS event FROM interp i JOIN v_surv s ON s.pid = i.pid),
{cuts_sql("s", "risk", 20)},
st AS (SELECT s.*, 1 + len(list_filter(q, lambda c: c < s.risk)) AS stratum FROM s JOIN qs ON qs.model = s.model AND qs.tau = s.tau), {boot_sql("st", 100)},
b AS (SELECT model, tau, replicate, stratum, SUM(risk * w_boot) / SUM(w_boot) AS x, SUM(CASE WHEN event THEN w_boot ELSE 0 END) / CAST(SUM(w_boot) AS DOUBLE) AS y FROM bs GROUP BY model, tau, replicate, stratum),
l AS (SELECT *, LEAD(x) OVER (PARTITION BY model, tau, replicate ORDER BY stratum) AS x1, LEAD(x - y) OVER (PARTITION BY model, tau, replicate ORDER BY stratum) AS g1 FROM b),
m AS (SELECT model, tau, replicate, 1 - SUM((x1 - x) * (x - y + g1) / 2) AS m FROM l GROUP BY model, tau, replicate)
SELECT model, tau, {q6("MAX(CASE WHEN replicate = 0 THEN m END)", "estimate")}, {q6("quantile_cont(m, 0.025) FILTER (WHERE replicate > 0)", "lower")},
  {q6("quantile_cont(m, 0.975) FILTER (WHERE replicate > 0)", "upper")}, {q6("stddev_samp(m) FILTER (WHERE replicate > 0)", "se")} FROM m GROUP BY model, tau""")
def bootstrap_calibration(spark, sf):
    rows = predicted(spark, sf, [1095.0]).join(v_surv(spark, sf), "pid")
    rows = rows.withColumns({"risk": 1 - F.col("pred"), "event": F.col("event") & (F.col("time") <= F.col("tau"))})
    return rounded(B.bootstrap_ci(rows, ["model", "tau"], "calibration", 100), "estimate", "lower", "upper", "se")


def _continuous(name: str, covers: str, run, **options) -> None:
    """The query of that name over predictions that seldom repeat, with blocks of few rows where it has blocks."""
    sql = ENTRIES[name].raw.replace("v_predictions", "v_continuous")
    query(f"{name}_continuous", covers, sql)(lambda spark, sf: run(spark, sf, preds=v_continuous, **options))


_continuous("concordance", "I8", concordance, block_rows=200)
_continuous("td_auc", "I9", td_auc, block_rows=100)
_continuous("td_roc", "I9", td_roc, block_rows=100)
_continuous("calibration_20", "I12 E9", calibration_20)
_continuous("bootstrap_auc", "I15 I9", bootstrap_auc)


def _contrast_sql(metric_sql: str, metric: str) -> str:
    return f"""
WITH {interp_sql([1095.0])}, {CENS_SQL}, {WEIGHT_SQL}, {boot_sql("wt", 100)}, bx AS (SELECT *, w * w_boot AS ww FROM bs), {metric_sql},
dl AS (SELECT a.model, a.tau, a.replicate, a.{metric} - b.{metric} AS delta FROM {metric} a JOIN {metric} b ON a.tau = b.tau AND a.replicate = b.replicate AND b.model = '001' WHERE a.model <> '001'),
st AS (SELECT model, tau, MAX(CASE WHEN replicate = 0 THEN delta END) AS delta, quantile_cont(delta, 0.025) FILTER (WHERE replicate > 0) AS lower,
  quantile_cont(delta, 0.975) FILTER (WHERE replicate > 0) AS upper, stddev_samp(delta) FILTER (WHERE replicate > 0) AS se FROM dl GROUP BY model, tau),
z AS (SELECT *, abs(delta / se) / sqrt(2) AS x, 1.0 / (1.0 + 0.5 * abs(delta / se) / sqrt(2)) AS t FROM st)
SELECT model, tau, {q6("delta", "delta")}, {q6("lower", "lower")}, {q6("upper", "upper")}, {q6("se", "se")}, {q6(_ERFC, "p")},
  format('{{:+.1f}} [{{:+.1f}}; {{:+.1f}}]', delta * 100, lower * 100, upper * 100) AS label FROM z"""


_BRIER_BOOT = """brier AS (SELECT model, tau, replicate, SUM(CASE WHEN is_case THEN (1 - risk) * (1 - risk) WHEN is_control THEN risk * risk ELSE 0 END * ww) / SUM(w_boot) AS brier
  FROM bx WHERE risk IS NOT NULL GROUP BY model, tau, replicate)"""


def _contrast(spark, sf, metric):
    out = B.contrast(weighted(spark, sf, [1095.0]), "001", metric, n=100)
    label = S.estimate_label(F.col("delta") * 100, F.col("lower") * 100, F.col("upper") * 100)
    return rounded(out.withColumn("label", label), "delta", "lower", "upper", "se", "p")


@query("contrast_auc", "I16 B26", _contrast_sql(auc_sql("model, tau, replicate", "bx", "ww"), "auc"))
def contrast_auc(spark, sf):
    return _contrast(spark, sf, "auc")


@query("contrast_brier", "I16 B26", _contrast_sql(_BRIER_BOOT, "brier"))
def contrast_brier(spark, sf):
    return _contrast(spark, sf, "brier")


@query("adjust_bh", "I17", f"""
WITH t AS (SELECT o_orderkey AS id, o_orderstatus AS family, (o_orderkey * 7919 % 10007) / 10007.0 AS p FROM orders),
r AS (SELECT *, p * COUNT(*) OVER (PARTITION BY family) / ROW_NUMBER() OVER (PARTITION BY family ORDER BY p, id) AS raw, ROW_NUMBER() OVER (PARTITION BY family ORDER BY p, id) AS rn FROM t)
SELECT id, family, {q6("p", "p")}, {q6("LEAST(1.0, MIN(raw) OVER (PARTITION BY family ORDER BY rn DESC))", "p_adjusted")} FROM r""")
def adjust_bh(spark, sf):
    from vitalspan.plans.views import table
    tests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("family"), (F.col("o_orderkey") * 7919 % 10007 / F.lit(10007.0)).alias("p"))
    return rounded(B.adjust_bh(tests, "p", ["id"], ["family"]), "p", "p_adjusted")


@query("compare_predictions", "I19 D20 D23", f"""
WITH {interp_sql([1095.0])}, w AS (SELECT pid, MAX(CASE WHEN model = '001' THEN 1 - pred END) AS a, MAX(CASE WHEN model = '006' THEN 1 - pred END) AS b FROM interp GROUP BY pid)
SELECT CAST(floor(a / 0.02) AS BIGINT) AS bin_x, CAST(floor(b / 0.02) AS BIGINT) AS bin_y, COUNT(*) AS n FROM w GROUP BY 1, 2""")
def compare_predictions(spark, sf):
    scored = predicted(spark, sf, [1095.0]).withColumn("risk", 1 - F.col("pred"))
    return M.comparison_density(scored, "001", "006", 1095.0)


_EXTERNAL = """ext AS (SELECT c_custkey AS pid, h.time, (c_custkey * h.k % 1000) / 10.0 AS value, (c_custkey % 4 = 0) AS imputed
  FROM customer, (SELECT 183 AS time, 11 AS k UNION ALL SELECT 365, 17 UNION ALL SELECT 1095, 23) h)"""


def external_scores(spark, sf):
    from vitalspan.plans.views import spread, table, unbroadcast
    horizons = F.array(*[F.struct(F.lit(t).alias("time"), F.lit(k).alias("k")) for t, k in ((183, 11), (365, 17), (1095, 23))])
    rows = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("pid")), "pid").select("pid", F.inline(horizons))
    return unbroadcast(rows).select("pid", "time", ((F.col("pid") * F.col("k") % 1000) / F.lit(10.0)).alias("value"), (F.col("pid") % 4 == 0).alias("imputed"))


@query("align_external_scores", "I20 C13", f"""
WITH {interp_sql([182.5, 365.0, 1095.0])}, {_EXTERNAL}
SELECT i.pid, i.model, i.tau, {q6("value / 100", "risk")}, {q6("1 - value / 100", "surv")}, {q6("pred", "pred")} FROM ext e JOIN interp i ON i.pid = e.pid AND i.tau = CASE WHEN e.time = 183 THEN 182.5 ELSE e.time END""")
def align_external_scores(spark, sf):
    from vitalspan.operators.joins import join_rounded
    aligned = M.align_external(external_scores(spark, sf)).select("pid", "tau", "risk", "surv")
    out = join_rounded(aligned, predicted(spark, sf, [182.5, 365.0, 1095.0]), ["pid", "tau"])
    return rounded(out, "risk", "surv", "pred")


@query("auc_by_imputation", "I21 I9 I20", f"""
WITH {interp_sql([182.5, 365.0, 1095.0])}, {CENS_SQL}, {_EXTERNAL},
g_tau AS (SELECT tau, COALESCE(arg_max(CASE WHEN time <= tau THEN g END, CASE WHEN time <= tau THEN time END), 1) AS g_tau FROM cens, taus GROUP BY tau),
sr AS (SELECT pid, 'external' AS name, CASE WHEN time = 183 THEN 182.5 ELSE time END AS tau, value / 100 AS risk, imputed FROM ext
  UNION ALL SELECT i.pid, 'model', i.tau, 1 - i.pred, c.c_custkey % 4 = 0 FROM interp i JOIN customer c ON c.c_custkey = i.pid WHERE i.model = '006'),
wt AS (SELECT i.name, i.tau, i.imputed, i.risk, (s.event AND s.time <= i.tau) AS is_case, s.time > i.tau AS is_control,
  CASE WHEN s.event AND s.time <= i.tau THEN 1 / c.g_before WHEN s.time > i.tau THEN 1 / g.g_tau ELSE 0 END AS w
  FROM sr i JOIN v_surv s ON s.pid = i.pid JOIN cens c ON c.time = s.time JOIN g_tau g ON g.tau = i.tau),
{auc_sql("name, tau, imputed")} SELECT name, CAST(tau AS DOUBLE) AS tau, imputed, {q6("auc", "auc")} FROM auc""")
def auc_by_imputation(spark, sf):
    taus = [182.5, 365.0, 1095.0]
    external = M.align_external(external_scores(spark, sf)).select("pid", "tau", "risk", "imputed", F.lit("external").alias("name"))
    flags = external.select("pid", "imputed").distinct()
    model = V.interpolate_at(v_predictions(spark, sf).where(F.col("model") == "006"), ["pid"], taus)
    ours = model.join(flags, "pid").select("pid", "tau", (1 - F.col("pred")).alias("risk"), "imputed", F.lit("model").alias("name"))
    rows = M.ipcw(external.unionByName(ours), v_surv(spark, sf), taus)
    return rounded(M.td_auc(rows, ["name", "tau", "imputed"]), "auc")
