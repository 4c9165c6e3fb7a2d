"""Attribution analytics over the patient views."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.operators import attribution as A
from vitalspan.operators.joins import fingerprint_matches as match_fingerprints, rows_of_matched
from vitalspan.operators.ordered import running
from vitalspan.operators.reshape import signed_summary, top_k, with_group_stats
from vitalspan.plans.registry import q6, query, rounded
from vitalspan.plans.views import v_attributions, v_trials
from vitalspan.session import settle

STEM = "split_part(feature, '_', 1) || '_' || split_part(feature, '_', 2)"
IMPORTANCE_SQL = f"""
pp AS (SELECT timepoint, {STEM} AS stem, pid, SUM(shap) AS shap FROM v_attributions GROUP BY 1, 2, 3),
mg AS (SELECT timepoint, stem, SUM(abs(shap)) AS m, AVG(abs(shap)) AS ave FROM pp GROUP BY 1, 2),
imp AS (SELECT timepoint, split_part(stem, '_', 1) AS fgroup, split_part(stem, '_', 2) AS fname, m / SUM(m) OVER (PARTITION BY timepoint) AS shap,
  CAST(dense_rank() OVER (PARTITION BY timepoint ORDER BY round(m, 9) DESC) AS INTEGER) AS rank FROM mg)"""


@query("global_importance", "K1 D14 D15 E4 M6", f"WITH {IMPORTANCE_SQL} SELECT timepoint, fgroup, fname, {q6('shap', 'shap')}, rank, CASE timepoint WHEN 365 THEN '1y' WHEN 1825 THEN '5y' END AS label FROM imp")
def global_importance(spark, sf):
    out = A.global_importance(v_attributions(spark, sf))
    return rounded(out.withColumn("label", A.timepoint_label(F.col("timepoint"))), "shap")


@query("group_importance", "K2 D15 C1", f"WITH {IMPORTANCE_SQL} SELECT timepoint, fgroup, {q6('SUM(shap)', 'shap')} FROM imp GROUP BY timepoint, fgroup")
def group_importance(spark, sf):
    return rounded(A.group_importance(A.global_importance(v_attributions(spark, sf))), "shap")


@query("cumulative_importance", "K3 E6", f"""
WITH {IMPORTANCE_SQL}, c AS (SELECT *, SUM(shap) OVER (PARTITION BY timepoint ORDER BY round(shap, 12) DESC, fgroup, fname ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM imp)
SELECT timepoint, fgroup, fname, {q6("shap", "shap")}, rank, {q6("e - shap", "start")}, {q6("e", '"end"')}, rank <= 25 AS marked FROM c""")
def cumulative_importance(spark, sf):
    return rounded(A.cumulative_importance(A.global_importance(v_attributions(spark, sf))), "shap", "start", "end")


@query("mean_abs_top_features", "K4 F2", f"""
WITH {IMPORTANCE_SQL} SELECT timepoint, stem, {q6("ave", "ave")} FROM (SELECT *, rank() OVER (PARTITION BY timepoint ORDER BY ave DESC) AS r FROM mg) WHERE r <= 10""")
def mean_abs_top_features(spark, sf):
    return rounded(A.mean_abs_importance(v_attributions(spark, sf), k=10), "ave")


PARTS_SQL = "split_part(feature, '_', 1) AS fgroup, split_part(feature, '_', 2) AS fname, NULLIF(split_part(feature, '_', 3), '') AS fvalue"
COLLAPSE_SQL = f"""
pt AS (SELECT pid, timepoint, {PARTS_SQL}, shap, vals FROM v_attributions),
ix AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid, timepoint, fgroup, fname ORDER BY fvalue NULLS FIRST, vals) AS i FROM pt),
col AS (SELECT pid, timepoint, fgroup, fname, CASE WHEN COUNT(*) > 1 THEN COALESCE(string_agg(fvalue, ';' ORDER BY fvalue) FILTER (WHERE vals = 1), CASE WHEN SUM(CASE WHEN vals = 1 THEN 1 ELSE 0 END) > 0 THEN '' ELSE 'missing' END) END AS text,
  CASE WHEN COUNT(*) > 1 THEN CAST(COALESCE(SUM(i) FILTER (WHERE vals = 1), 0) AS DOUBLE) ELSE MAX(vals) END AS value, SUM(shap) AS shap FROM ix GROUP BY pid, timepoint, fgroup, fname)"""


@query("collapse_one_hot", "K5 E8 E13 D17 G1 C6", f"WITH {COLLAPSE_SQL} SELECT pid, timepoint, fgroup, fname, text, value, {q6('shap', 'shap')} FROM col")
def collapse_one_hot(spark, sf):
    return rounded(A.collapse_one_hot(v_attributions(spark, sf)), "shap")


ACTIVE_SQL = f"""
ap AS (SELECT pid, {PARTS_SQL}, shap, round(vals, 1) AS value FROM v_attributions WHERE timepoint = 1825),
ag AS (SELECT pid, fgroup, fname, SUM(shap) AS shap, COUNT(*) AS n, MAX(CASE WHEN value <> 0 THEN 1 ELSE 0 END) AS any_on FROM ap GROUP BY 1, 2, 3),
act AS (SELECT ag.pid, ag.fgroup, ag.fname, ag.shap, ap.fvalue, ap.value FROM ag JOIN ap ON ap.pid = ag.pid AND ap.fgroup = ag.fgroup AND ap.fname = ag.fname WHERE n = 1 OR value <> 0
  UNION ALL SELECT pid, fgroup, fname, shap, 'normal', 0 FROM ag WHERE n > 1 AND any_on = 0)"""


def _active(spark, sf, by_patient=False):
    return A.active_rows(v_attributions(spark, sf, by_patient).where(F.col("timepoint") == 1825.0))


@query("active_features", "K5 E8", f"WITH {ACTIVE_SQL} SELECT pid, fgroup, fname, fvalue, value, {q6('shap', 'shap')} FROM act")
def active_features(spark, sf):
    return rounded(_active(spark, sf), "shap")


@query("top_features_per_patient", "E5", f"""
WITH {ACTIVE_SQL} SELECT pid, fgroup, fname, fvalue, value, {q6("shap", "shap")}, CAST(rn AS INTEGER) AS rn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY round(abs(shap), 9) DESC, fgroup, fname, fvalue NULLS FIRST) AS rn FROM act) WHERE rn <= 8""")
def top_features_per_patient(spark, sf):
    order = [F.round(F.abs("shap"), 9).desc(), F.col("fgroup"), F.col("fname"), F.col("fvalue").asc_nulls_first()]
    return rounded(top_k(_active(spark, sf), ["pid"], order, 8, "rn"), "shap")


_MATCH_SQL = f"""WITH {ACTIVE_SQL}, tp AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY round(abs(shap), 9) DESC, fgroup, fname, fvalue NULLS FIRST) AS rn FROM act) WHERE rn <= 8),
it AS (SELECT DISTINCT pid, fgroup, fname, COALESCE(fvalue, '-') AS fv, value FROM act),
fp AS (SELECT DISTINCT pid, fgroup, fname, COALESCE(fvalue, '-') AS fv, value FROM tp), sz AS (SELECT pid, COUNT(*) AS k FROM fp GROUP BY pid),
hit AS (SELECT fp.pid, it.pid AS other, COUNT(*) AS k FROM fp JOIN it ON it.fgroup = fp.fgroup AND it.fname = fp.fname AND it.fv = fp.fv AND it.value = fp.value GROUP BY 1, 2),
nm AS (SELECT sz.pid, COUNT(hit.other) AS n_matches FROM sz LEFT JOIN hit ON hit.pid = sz.pid AND hit.k = sz.k GROUP BY sz.pid)"""


def _matches(spark, sf):
    """Patients with the number of patients that hold all of their top eight features, and the rows searched.

    Files of the rows have all rows of a patient, so a task that reads them keeps eight a patient before it deals them.
    """
    active = settle(_active(spark, sf, by_patient=True))
    order = [F.round(F.abs("shap"), 9).desc(), F.col("fgroup"), F.col("fname"), F.col("fvalue").asc_nulls_first()]
    return match_fingerprints(active, "pid", top_k(active, ["pid"], order, 8), ["fgroup", "fname", "fvalue", "value"]), active


@query("fingerprint_matches", "C16 E5", f"{_MATCH_SQL} SELECT pid, n_matches FROM nm")
def fingerprint_matches(spark, sf):
    return _matches(spark, sf)[0]


@query("fingerprint_rows", "C16 E5", f"{_MATCH_SQL} SELECT pid, n_matches, fgroup, fname, fvalue, value, {q6('shap', 'shap')} FROM act JOIN nm USING (pid) WHERE n_matches >= 5")
def fingerprint_rows(spark, sf):
    matches, active = _matches(spark, sf)
    rows = rows_of_matched(active, "pid", matches, 5)
    return rounded(rows.select("pid", "n_matches", "fgroup", "fname", "fvalue", "value", "shap"), "shap")


_LABEL_SQL = """lab AS (SELECT pid, fname || ':' || COALESCE(fvalue, '') AS label, round(SUM(shap), 9) AS shap FROM act GROUP BY 1, 2),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY abs(shap) DESC, label) AS rn FROM lab),
sh AS (SELECT pid, CASE WHEN rn > 8 THEN 'rest' ELSE label END AS label, round(SUM(shap), 9) AS shap FROM rk GROUP BY 1, 2),
yh AS (SELECT *, CASE WHEN shap < 0 THEN 'neg' ELSE 'pos' END AS dir, 0.821 + SUM(shap) OVER (PARTITION BY pid) AS yhat FROM sh)"""


def _contributions(spark, sf, order):
    rows = _active(spark, sf).withColumn("label", F.concat(F.col("fname"), F.lit(":"), F.coalesce("fvalue", F.lit(""))))
    merged = rows.groupBy("pid", "label").agg(F.round(F.sum("shap"), 9).alias("shap"))
    return rounded(A.cumulative_contribution(merged, 8, order=order), "shap", "yhat", "start", "end")


@query("cumulative_contribution", "K6 E5 E6", f"""
WITH {ACTIVE_SQL}, {_LABEL_SQL},
c AS (SELECT *, 0.821 + SUM(shap) OVER (PARTITION BY pid ORDER BY -abs(shap), label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM yh)
SELECT pid, label, {q6("shap", "shap")}, dir, {q6("yhat", "yhat")}, {q6("e - shap", "start")}, {q6("e", '"end"')} FROM c""")
def cumulative_contribution(spark, sf):
    return _contributions(spark, sf, "magnitude")


@query("force_contribution", "K6 E6", f"""
WITH {ACTIVE_SQL}, {_LABEL_SQL},
c AS (SELECT *, SUM(abs(shap)) OVER (PARTITION BY pid ORDER BY dir DESC, shap, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + yhat - SUM(CASE WHEN dir = 'pos' THEN shap ELSE 0 END) OVER (PARTITION BY pid) AS e FROM yh)
SELECT pid, label, {q6("shap", "shap")}, dir, {q6("yhat", "yhat")}, {q6("CASE WHEN dir = 'neg' THEN e ELSE e - abs(shap) END", "start")}, {q6("CASE WHEN dir = 'neg' THEN e - abs(shap) ELSE e END", '"end"')} FROM c""")
def force_contribution(spark, sf):
    return _contributions(spark, sf, "sign")


@query("signed_stack", "K6 E6", f"""
WITH {COLLAPSE_SQL}, s AS (SELECT pid, timepoint, fname, round(SUM(shap), 9) AS shap FROM col GROUP BY 1, 2, 3),
d AS (SELECT *, CASE WHEN shap < 0 THEN 'neg' ELSE 'pos' END AS dir FROM s),
c AS (SELECT *, 0.5 + SUM(shap) OVER (PARTITION BY pid, timepoint, dir ORDER BY abs(shap) DESC, fname ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM d)
SELECT pid, timepoint, fname, dir, {q6("shap", "shap")}, {q6("e - shap", "y0")}, {q6("e", "y1")} FROM c""")
def signed_stack(spark, sf):
    rows = A.collapse_one_hot(v_attributions(spark, sf)).groupBy("pid", "timepoint", "fname").agg(F.round(F.sum("shap"), 9).alias("shap"))
    out = A.signed_stack(rows.withColumn("yhat", F.lit(0.5)))
    return rounded(out.drop("yhat"), "shap", "y0", "y1")


@query("attribution_delta", "K7 C13 D16 E4", f"""
WITH j AS (SELECT pid, {STEM} AS stem, SUM(shap) AS a, SUM(shap * (1 + 0.01 * (pid % 7)) + 0.001) AS b FROM v_attributions GROUP BY 1, 2),
q AS (SELECT split_part(stem, '_', 2) AS fname, quantile_cont(b - a, 0.5) AS q50 FROM j GROUP BY 1)
SELECT fname, {q6("q50", "q50")}, CAST(dense_rank() OVER (ORDER BY round(abs(q50), 12) DESC) AS INTEGER) AS rank FROM q""")
def attribution_delta(spark, sf):
    a = v_attributions(spark, sf)
    b = a.withColumn("shap", F.col("shap") * (1 + 0.01 * (F.col("pid") % 7)) + 0.001)
    return rounded(A.attribution_delta(a, b), "q50")


LEVEL_SQL = f"""
{COLLAPSE_SQL}, tx AS (SELECT DISTINCT fname, text FROM col WHERE text IS NOT NULL),
lv AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fname ORDER BY CASE WHEN text = '[0,10]' THEN 0 WHEN text IN ('missing', 'nan') THEN 2 ELSE 1 END, text) AS lvl, COUNT(*) OVER (PARTITION BY fname) AS n FROM tx),
vl AS (SELECT col.*, CAST(CASE WHEN lv.n BETWEEN 3 AND 9 THEN lv.lvl ELSE 1 END AS INTEGER) AS level,
  CASE WHEN col.text IN ('missing', 'nan') THEN NULL WHEN lv.n BETWEEN 3 AND 9 THEN lv.lvl ELSE col.value END AS v FROM col LEFT JOIN lv ON lv.fname = col.fname AND lv.text = col.text)"""


@query("level_values", "K8 E11 E13", f"""
WITH {LEVEL_SQL} SELECT pid, timepoint, fgroup, fname, text, value, {q6("shap", "shap")}, level,
  {q6("(v - MIN(v) OVER (PARTITION BY fname)) / NULLIF(MAX(v) OVER (PARTITION BY fname) - MIN(v) OVER (PARTITION BY fname), 0)", "normalized")} FROM vl""")
def level_values(spark, sf):
    return rounded(A.level_values(A.collapse_one_hot(v_attributions(spark, sf))), "shap", "normalized")


@query("level_labels", "K8 D1", f"""
WITH {LEVEL_SQL}, t AS (SELECT DISTINCT fname, level, text FROM vl WHERE text IS NOT NULL), g AS (SELECT fname, string_agg(text, '/' ORDER BY level, text) AS levels FROM t GROUP BY fname)
SELECT fname, levels, fname || ' (' || levels || ')' AS label FROM g""")
def level_labels(spark, sf):
    return A.level_labels(A.level_values(A.collapse_one_hot(v_attributions(spark, sf))))


@query("feature_slice", "K9 K5", f"WITH {COLLAPSE_SQL} SELECT pid, timepoint, fgroup, fname, text, value, {q6('shap', 'shap')} FROM col WHERE fname IN ('Brand#1', 'Brand#2') AND timepoint = 1825")
def feature_slice(spark, sf):
    return rounded(A.feature_slice(v_attributions(spark, sf), ["Brand#1", "Brand#2"], 1825.0), "shap")


@query("median_attribution_by_level", "K9 D16 E12", f"WITH {COLLAPSE_SQL} SELECT fname, text, {q6('quantile_cont(shap, 0.5)', 'median')} FROM col GROUP BY fname, text")
def median_attribution_by_level(spark, sf):
    return rounded(A.median_by_level(A.collapse_one_hot(v_attributions(spark, sf))), "median")


BANDS_SQL = """
bd AS (SELECT pid, 0.821 + SUM(shap) AS yhat FROM v_attributions WHERE timepoint = 1825 GROUP BY pid HAVING 0.821 + SUM(shap) <= 1),
ct AS (SELECT *, CASE WHEN yhat > 0 AND yhat <= 0.25 THEN '(0,0.25]' WHEN yhat > 0.25 AND yhat <= 0.5 THEN '(0.25,0.5]' WHEN yhat > 0.5 AND yhat <= 0.75 THEN '(0.5,0.75]' WHEN yhat > 0.75 AND yhat <= 1 THEN '(0.75,1]' END AS category FROM bd)"""


@query("sampled_cases", "K10 F3 I7", f"""
WITH {BANDS_SQL} SELECT pid, {q6("yhat", "yhat")}, category FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY md5(CAST(pid AS VARCHAR)), pid) AS rn FROM ct WHERE category IS NOT NULL) WHERE rn <= 3""")
def sampled_cases(spark, sf):
    bands = A.predicted_bands(v_attributions(spark, sf).where(F.col("timepoint") == 1825.0))
    return rounded(A.sample_cases(bands, 3, shuffle=F.md5(F.col("pid").cast("string").cast("binary"))), "yhat")


@query("feature_distribution", "K11 D24 F2", f"""
WITH g AS (SELECT timepoint, feature, round(SUM(shap), 12) AS s, SUM(abs(shap)) AS a FROM v_attributions GROUP BY 1, 2),
h AS (SELECT timepoint, feature, a / SUM(a) OVER (PARTITION BY timepoint) AS shap, CASE WHEN s < 0 THEN 'non-survival' WHEN s > 0 THEN 'survival' ELSE '0' END AS direction FROM g),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timepoint ORDER BY shap DESC, feature) AS rank FROM h)
SELECT timepoint, feature, {q6("shap", "shap")}, direction, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def feature_distribution(spark, sf):
    return rounded(A.feature_distribution(v_attributions(spark, sf)), "shap")


@query("top_feature_rows", "K11 C1 C5 E12", f"""
WITH {IMPORTANCE_SQL}, b AS (SELECT timepoint, {STEM} AS stem, pid, SUM(shap) AS shap FROM v_attributions GROUP BY 1, 2, 3)
SELECT b.timepoint, b.pid, i.fname, {q6("b.shap", "shap")}, i.rank, {q6("SUM(b.shap) OVER (PARTITION BY b.timepoint, b.stem)", "total")} FROM b JOIN imp i ON i.timepoint = b.timepoint AND i.fgroup || '_' || i.fname = b.stem WHERE i.rank <= 5""")
def top_feature_rows(spark, sf):
    sums = settle(A.per_patient(v_attributions(spark, sf)))  # read for the importances, the rows and their totals
    top = A.importance_of(sums).where("rank <= 5").select("timepoint", F.concat_ws("_", "fgroup", "fname").alias("stem"), "fname", "rank")
    rows = sums.join(settle(top), ["timepoint", "stem"])
    out = with_group_stats(rows, ["timepoint", "stem"], {"total": F.sum("shap")})
    return rounded(out.drop("stem"), "shap", "total")


@query("signed_summary", "D24 B22", f"SELECT timepoint, feature, CAST(sign(round(SUM(shap), 12)) AS DOUBLE) AS direction, {q6('SUM(abs(shap))', 'magnitude')} FROM v_attributions GROUP BY 1, 2")
def signed_summary_query(spark, sf):
    out = signed_summary(v_attributions(spark, sf), ["timepoint", "feature"], "shap")
    return rounded(out, "magnitude")


@query("best_trial_so_far", "E7 C1", f"SELECT study_name, number, {q6('value', 'value')}, {q6('MIN(value) OVER (PARTITION BY study_name ORDER BY number)', 'best')} FROM v_trials")
def best_trial_so_far(spark, sf):
    out = running(v_trials(spark, sf).select("study_name", "number", "value"), ["study_name"], ["number"], {"best": ("min", "value")})
    return rounded(out, "value", "best")
