"""Feature sets, labels, folds and the clinical risk score over the patient views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.operators import features as X
from vitalspan.operators import risk as R
from vitalspan.operators.reshape import missing_rates
from vitalspan.plans.cohort_queries import CLINICAL_TWO_CTE, DIAG_SQL, LAB_SQL, LINES_AFTER, PROC_SQL, clinical_two_table, diagnosis_events, lab_events, proc_events
from vitalspan.plans.registry import q6, query, rounded
from vitalspan.plans.views import baseline_of, patient_lines, settled_patients, surv_of, table, unbroadcast, v_attributions, v_baseline, v_code_parents, v_scores, v_surv
from vitalspan.session import settle
from vitalspan.sources import lookups as L

HORIZON = 730.0


@query("multi_hot_diagnoses", "H12 C5 D25", f"""
WITH {DIAG_SQL} SELECT DISTINCT d.pid, 'diag-simple_' || code AS feature, CAST(1 AS DOUBLE) AS value FROM diag d JOIN v_surv s ON s.pid = d.pid WHERE level = 'lvl3' AND d.time > -730 AND s.train""")
def multi_hot_diagnoses(spark, sf):
    train = v_surv(spark, sf).where("train")
    return X.multi_hot_diagnoses(diagnosis_events(spark, sf), train, "lvl3", HORIZON)


@query("diagnosis_vocabulary", "H12 F1 E13", f"""
WITH {DIAG_SQL} SELECT feature, ROW_NUMBER() OVER (ORDER BY feature) - 1 AS column_index FROM (SELECT DISTINCT 'diag-simple_' || code AS feature FROM diag WHERE level = 'block' AND time > -730)""")
def diagnosis_vocabulary(spark, sf):
    return X.multi_hot_vocabulary(diagnosis_events(spark, sf), X.DIAGNOSES, X.diagnosis_window("block", HORIZON))


@query("multi_hot_procedures", "H13", f"""
WITH {PROC_SQL} SELECT DISTINCT d.pid, 'proc-1_' || code AS feature, CAST(1 AS DOUBLE) AS value FROM procs d JOIN v_surv s ON s.pid = d.pid WHERE d.time < 730 AND s.train""")
def multi_hot_procedures(spark, sf):
    return X.multi_hot_procedures(proc_events(spark, sf), v_surv(spark, sf).where("train"), HORIZON)


@query("tri_state_labs", "H14", f"""
WITH {LAB_SQL} SELECT l.pid, 'bioc-1_' || qid || '_' || CASE value WHEN -1 THEN 'low' WHEN 0 THEN 'normal' ELSE 'high' END AS feature, CAST(1 AS DOUBLE) AS value
FROM labs l JOIN v_surv s ON s.pid = l.pid WHERE s.train AND l.time <= 730 AND regexp_matches(qid, '^NPU')""")
def tri_state_labs(spark, sf):
    patients = settled_patients(spark, sf)
    return X.tri_state_labs(lab_events(spark, sf, patients), surv_of(patients).where("train"), HORIZON, "^NPU")


@query("tri_state_vocabulary", "H14", f"""
WITH {LAB_SQL}, q AS (SELECT qid, ROW_NUMBER() OVER (ORDER BY qid) - 1 AS i FROM (SELECT DISTINCT qid FROM labs))
SELECT 'bioc-1_' || qid || '_' || l AS feature, i * 3 + k AS column_index FROM q, (SELECT 'low' AS l, 0 AS k UNION ALL SELECT 'normal', 1 UNION ALL SELECT 'high', 2)""")
def tri_state_vocabulary(spark, sf):
    return X.tri_state_vocabulary(lab_events(spark, sf))


def _unpivot_sql(source: str, columns: dict[str, str], alias: str, exact: bool = False) -> str:
    cell = "CASE WHEN present THEN CAST({} AS DOUBLE) END"
    value = (lambda e: cell.format(e) + " AS value") if exact else (lambda e: q6(cell.format(e), "value"))
    return " UNION ALL ".join(f"SELECT pid, '{alias}_{name}' AS feature, {value(expr)} FROM {source}" for name, expr in columns.items())


def _hot_sql(column: str, domain, name: str, null_level: bool = True) -> dict[str, str]:
    quoted = [f"'{v}'" if isinstance(v, str) else str(v) for v in domain]
    out = {f"{name}_{v}": f"CASE WHEN {column} = {q} THEN 1 ELSE 0 END" for v, q in zip(domain, quoted)}
    if null_level:
        out[f"{name}_nan"] = f"CASE WHEN {column} IN ({', '.join(quoted)}) THEN 0 ELSE 1 END"
    return out


_CLINICAL_1 = {
    "age": "(age - 15) / 90", "pulse": "COALESCE((pulse - m_pulse) / s_pulse, 0)", "sysbp": "COALESCE((sys_bp - m_sys) / s_sys, 0)",
    "crea": "COALESCE((ln(crea + 1) - m_crea) / s_crea, 0)", "arrest": "CAST(arrest AS INTEGER)", "stemi": "CAST(stemi AS INTEGER)",
    "enzymes_True": "CASE WHEN enzymes THEN 1 ELSE 0 END", "enzymes_False": "CASE WHEN NOT enzymes THEN 1 ELSE 0 END", "enzymes_nan": "CASE WHEN enzymes IS NULL THEN 1 ELSE 0 END",
    **_hot_sql("killip", [1, 2, 3, 4], "killip"),
}
_FIT_SQL = """fit AS (SELECT AVG(pulse) AS m_pulse, stddev_samp(pulse) AS s_pulse, AVG(sys_bp) AS m_sys, stddev_samp(sys_bp) AS s_sys, AVG(ln(crea + 1)) AS m_crea, stddev_pop(ln(crea + 1)) AS s_crea,
  AVG(height) AS m_height, stddev_samp(height) AS s_height, AVG(weight) AS m_weight, stddev_samp(weight) AS s_weight, AVG(dia_bp) AS m_dia, stddev_samp(dia_bp) AS s_dia FROM v_baseline),
al AS (SELECT s.pid, b.* EXCLUDE (pid), fit.*, b.pid IS NOT NULL AS present FROM v_surv s LEFT JOIN v_baseline b ON b.pid = s.pid, fit)"""


@query("clinical_features_1", "H15 H17 E10 B22 B2 C17", f"WITH {_FIT_SQL} {_unpivot_sql('al', _CLINICAL_1, 'clnc-1')}")
def clinical_features_1(spark, sf):
    return rounded(X.clinical_features_1(v_baseline(spark, sf), v_surv(spark, sf)), "value")


_CLINICAL_2 = {
    "sex": "CAST(sex AS INTEGER)", "icd-or-pm": "CAST(icd_or_pm AS INTEGER)", "height": "COALESCE((height - m_height) / s_height, 0)",
    "weight": "COALESCE((weight - m_weight) / s_weight, 0)", "dia-bp": "COALESCE((dia_bp - m_dia) / s_dia, 0)",
    **_hot_sql("smoking", ["no", "ex", "yes"], "smoking"), **_hot_sql("vessels", ["DIF", "1VD", "2VD", "3VD"], "vessels"),
    **_hot_sql("dominance", ["B", "R", "L"], "dominance"), **_hot_sql("nyha", [1, 2, 3, 4], "nyha"), **_hot_sql("ccs", [0, 1, 2, 3, 4], "ccs"),
    **_hot_sql("lvef", ["[0,10]", "(10,20]", "(20,30]", "(30,40]", "(40,50]", "(50,60]", "missing"], "lvef", False),
    **_hot_sql("ischemia_test", ["inconclusive", "missing", "negative", "positive"], "ischemia-test", False),
    **_hot_sql("abnormal_ekg", ["missing", "no", "yes"], "abnormal-ekg", False),
    **_hot_sql("abnormal_qrs_st", ["missing", "no", "yes"], "abnormal-qrs-st", False),
    **_hot_sql("familiary_ihd", ["missing", "no", "yes"], "familiary-ihd", False),
}
_FIT_2_SQL = f"""{CLINICAL_TWO_CTE},
fit2 AS (SELECT AVG(height) AS m_height, stddev_samp(height) AS s_height, AVG(weight) AS m_weight, stddev_samp(weight) AS s_weight, AVG(dia_bp) AS m_dia, stddev_samp(dia_bp) AS s_dia FROM ct),
al2 AS (SELECT s.pid, b.* EXCLUDE (pid), fit2.*, b.pid IS NOT NULL AS present FROM v_surv s LEFT JOIN ct b ON b.pid = s.pid, fit2)"""


@query("clinical_features_2", "H16 H17 H20", f"WITH {_FIT_2_SQL} {_unpivot_sql('al2', _CLINICAL_2, 'clnc-2')}")
def clinical_features_2(spark, sf):
    return rounded(X.clinical_features_2(clinical_two_table(spark, sf), v_surv(spark, sf)), "value")


_WINSOR_SQL = """
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY score) AS rn, COUNT(*) OVER (PARTITION BY name) AS n FROM v_scores),
bd AS (SELECT name, MIN(score) FILTER (WHERE rn > floor(n * 0.05)) AS lo, MIN(score) FILTER (WHERE rn >= n - floor(n * 0.05)) AS hi FROM rk GROUP BY name),
wz AS (SELECT s.pid, s.name, LEAST(GREATEST(s.score, bd.lo), bd.hi) AS score FROM v_scores s JOIN bd ON bd.name = s.name)"""


@query("score_winsor", "H18", f"WITH {_WINSOR_SQL} SELECT pid, name, {q6('score', 'score')} FROM wz")
def score_winsor(spark, sf):
    return rounded(X.winsorize(v_scores(spark, sf), ["name"], "score", 0.05), "score")


@query("polygenic_features", "H19 H18 E10 C17 D20", f"""
WITH {_WINSOR_SQL}, z AS (SELECT pid, name, (score - AVG(score) OVER (PARTITION BY name)) / stddev_samp(score) OVER (PARTITION BY name) AS z FROM wz)
SELECT s.pid, 'pgss-1_' || n.name AS feature, {q6("CASE WHEN s.pid IN (SELECT pid FROM v_scores) THEN z.z ELSE 0 END", "value")}
FROM v_surv s CROSS JOIN (SELECT DISTINCT name FROM v_scores) n LEFT JOIN z ON z.pid = s.pid AND z.name = n.name""")
def polygenic_features(spark, sf):
    return rounded(X.polygenic_features(v_scores(spark, sf), v_surv(spark, sf), 0.05), "value")


@query("score_winsor_zscore", "H18 E10 E11", f"""
WITH {_WINSOR_SQL}, z AS (SELECT pid, name, (score - AVG(score) OVER (PARTITION BY name)) / stddev_samp(score) OVER (PARTITION BY name) AS z FROM wz)
SELECT pid, name, {q6("z", "z")}, {q6("(z - MIN(z) OVER (PARTITION BY name)) / (MAX(z) OVER (PARTITION BY name) - MIN(z) OVER (PARTITION BY name)) * 2 - 1", "scaled")} FROM z""")
def score_winsor_zscore(spark, sf):
    from vitalspan.operators.attribution import rescale_within
    from vitalspan.operators.reshape import with_group_stats
    clamped = settle(X.winsorize(v_scores(spark, sf), ["name"], "score", 0.05))
    stats = with_group_stats(clamped, ["name"], {"_m": F.avg("score"), "_s": F.stddev_samp("score")})
    z = stats.select("pid", "name", X.zscore(F.col("score"), "_m", "_s", None).alias("z"))
    return rounded(rescale_within(z, ["name"], "z", "scaled", -1.0, 1.0), "z", "scaled")


#: All feature sets.
ALL_SETS = tuple(X.FEATURE_SETS)


#: Tables that are made from order lines.
FROM_LINES = {"clinicaltwo", "diagnoses", "biochem", "nomesco"}


def tables(spark, sf) -> dict[str, DataFrame]:
    return sources(spark, sf, ALL_SETS)


def sources(spark, sf, sets) -> dict[str, DataFrame]:
    """The tables that the named feature sets are made from, and that of the patients. Events are settled where they are made.

    Where several of them are made from order lines, these meet their patients once.
    """
    patients = settled_patients(spark, sf)
    names = list(dict.fromkeys(X.FEATURE_SETS[alias][0] for alias in sets))
    shared = len(FROM_LINES.intersection(names)) > 1
    lines = patient_lines(spark, sf, patients, LINES_AFTER) if shared else None
    made = {
        "baseline": lambda: baseline_of(patients), "clinicaltwo": lambda: unbroadcast(settle(clinical_two_table(spark, sf, patients, lines))),
        "diagnoses": lambda: diagnosis_events(spark, sf, patients=patients, lines=lines), "biochem": lambda: lab_events(spark, sf, patients, lines),
        "nomesco": lambda: proc_events(spark, sf, patients, lines), "polygenic_scores": lambda: settle(v_scores(spark, sf))}
    return {"surv_master": surv_of(patients), **{name: made[name]() for name in names}}


def _without(columns: dict[str, str], groups) -> dict[str, str]:
    return {k: v for k, v in columns.items() if k.split("_")[0] not in groups}


def _study_sql(study: str) -> str:
    """SQL of the number of rows, known values and total of each feature of a study."""
    sets = X.STUDIES[study]
    part = {
        X.CLINICAL_1: lambda p: _unpivot_sql("al", _without(_CLINICAL_1, p.get("remove", ())), "clnc-1", True),
        X.CLINICAL_2: lambda p: _unpivot_sql("al2", _without(_CLINICAL_2, p.get("remove", ())), "clnc-2", True),
        X.DIAGNOSES: lambda p: f"SELECT DISTINCT pid, 'diag-simple_' || code, CAST(1 AS DOUBLE) FROM diag WHERE level = '{p['level']}' AND time > -{p['horizon']} AND pid IN (SELECT pid FROM v_surv)",
        X.LABS: lambda p: "SELECT pid, 'bioc-1_' || qid || '_' || CASE value WHEN -1 THEN 'low' WHEN 0 THEN 'normal' ELSE 'high' END, CAST(1 AS DOUBLE) FROM labs "
                          f"WHERE time <= {p['horizon']} AND regexp_matches(qid, '{p.get('pattern', '')}') AND pid IN (SELECT pid FROM v_surv)",
        X.PROCEDURES: lambda p: f"SELECT DISTINCT pid, 'proc-1_' || code, CAST(1 AS DOUBLE) FROM procs WHERE time < {p['horizon']} AND pid IN (SELECT pid FROM v_surv)",
        X.GENETIC: lambda p: "SELECT s.pid, 'pgss-1_' || n.name, CASE WHEN s.pid IN (SELECT pid FROM v_scores) THEN z.z ELSE 0 END "
                             "FROM v_surv s CROSS JOIN (SELECT DISTINCT name FROM v_scores) n LEFT JOIN z ON z.pid = s.pid AND z.name = n.name",
    }
    z = "z AS (SELECT pid, name, (score - AVG(score) OVER (PARTITION BY name)) / stddev_samp(score) OVER (PARTITION BY name) AS z FROM wz)"
    ctes = {X.CLINICAL_1: _FIT_SQL, X.CLINICAL_2: _FIT_2_SQL, X.DIAGNOSES: DIAG_SQL, X.LABS: LAB_SQL, X.PROCEDURES: PROC_SQL, X.GENETIC: f"{_WINSOR_SQL}, {z}"}
    rows = " UNION ALL ".join(part[alias](params) for alias, params in sets.items())
    return f"""WITH {", ".join(ctes[alias] for alias in sets)}, r(pid, feature, value) AS ({rows})
SELECT feature, COUNT(*) AS n, COUNT(value) AS known, {q6("SUM(value)", "total")} FROM r GROUP BY feature"""


def _study(study: str):
    def run(spark, sf):
        made = sources(spark, sf, X.STUDIES[study])
        long = X.study_features(made, made["surv_master"], study)
        out = long.groupBy("feature").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.sum("value").alias("total"))
        return rounded(out, "total")
    return run


for _number in ("001", "002", "003", "004", "005", "006", "007", "008", "009", "010"):
    query(f"study_{_number}", "H16 H20 H21 M5", _study_sql(_number))(_study(_number))


@query("assemble_features", "H20 H21 A8 M5", _study_sql("012"))
def assemble_features(spark, sf):
    """Study 012, whole."""
    return _study("012")(spark, sf)


@query("study_genetic_only", "H21 C18 G3", f"""
WITH {_WINSOR_SQL}, z AS (SELECT pid, name, (score - AVG(score) OVER (PARTITION BY name)) / stddev_samp(score) OVER (PARTITION BY name) AS z FROM wz)
SELECT s.pid, 'pgss-1_' || n.name AS feature, {q6("z.z", "value")} FROM v_surv s CROSS JOIN (SELECT DISTINCT name FROM v_scores) n LEFT JOIN z ON z.pid = s.pid AND z.name = n.name
WHERE s.pid IN (SELECT pid FROM v_scores)""")
def study_genetic_only(spark, sf):
    made = sources(spark, sf, X.STUDIES["011"])
    return rounded(X.study_features(made, made["surv_master"], "011"), "value")


BREAKS_SQL = f"br AS (SELECT quantile_cont(CAST(time AS DOUBLE), [{', '.join(str(i / 10) for i in range(11))}]) AS b FROM v_surv WHERE event AND train AND time <= 1500)"


@query("time_breaks", "H22 D16", f"WITH {BREAKS_SQL} SELECT CAST(i AS INTEGER) AS i, {q6('b[i + 1]', 'value')} FROM br, range(0, 11) t(i)")
def time_breaks(spark, sf):
    out = X.time_breaks(v_surv(spark, sf), 10, 1500)
    return rounded(out.select(F.posexplode("breaks").alias("i", "value")), "value")


LABEL_SQL = f"""{BREAKS_SQL},
lb AS (SELECT s.pid, CAST(i AS INTEGER) AS interval, s.event AND s.time < b[11] AS obs, s.time, b[i + 1] AS lo, b[i + 2] AS hi, len(list_filter(b[2:], lambda e: e < s.time)) AS hit FROM v_surv s, br, range(0, 10) t(i)),
lab AS (SELECT pid, interval, obs AND interval = hit AS died, CASE WHEN obs THEN time >= hi ELSE time >= lo + (hi - lo) / 2 END AS survived FROM lb)"""


@query("survival_labels", "H23", f"WITH {LABEL_SQL} SELECT pid, interval, died, survived FROM lab")
def survival_labels(spark, sf):
    surv = v_surv(spark, sf)
    labels = X.survival_labels(surv, X.time_breaks(surv, 10, 1500))
    pairs = F.transform(F.arrays_zip("died", "survived"), lambda p, i: F.struct(i.alias("interval"), p["died"].alias("died"), p["survived"].alias("survived")))
    return labels.select("pid", F.inline(pairs))


@query("person_period_labels", "H23 H22 J1", f"WITH {LABEL_SQL} SELECT pid, interval, died, survived FROM lab WHERE died OR survived")
def person_period_labels(spark, sf):
    surv = v_surv(spark, sf)
    return X.person_periods(X.survival_labels(surv, X.time_breaks(surv, 10, 1500)))


@query("discrete_nll", "I18 H23", f"""
WITH {LABEL_SQL} SELECT {q6("AVG(nll)", "nll")} FROM (SELECT pid, SUM(CASE WHEN died THEN -ln(0.02 + interval / 100.0 + 1e-7) ELSE 0 END + CASE WHEN survived THEN -ln(1 - (0.02 + interval / 100.0) + 1e-7) ELSE 0 END) AS nll
  FROM lab WHERE died OR survived GROUP BY pid)""")
def discrete_nll(spark, sf):
    from vitalspan.operators.metrics import discrete_nll as nll
    periods = person_period_labels(spark, sf).withColumn("hazard", F.lit(0.02) + F.col("interval") / F.lit(100.0))
    return rounded(nll(periods), "nll")


_TOKEN = "md5(CAST(pid AS VARCHAR))"


def _token():
    return F.md5(F.col("pid").cast("string").cast("binary"))


@query("kfold_assign", "H24 F3", f"""
SELECT pid, CAST(LEAST(floor((rn - 1) / floor(n / 5.0)), 4) AS INTEGER) AS fold FROM (SELECT pid, ROW_NUMBER() OVER (ORDER BY {_TOKEN}, pid) AS rn, COUNT(*) OVER () AS n FROM v_surv)""")
def kfold_assign(spark, sf):
    return X.kfold_assign(v_surv(spark, sf).select("pid"), 5, shuffle=_token())


@query("ratio_split", "H24", f"""
SELECT pid, CAST(CASE WHEN rn <= floor(n * 0.8) THEN 1 ELSE 2 END AS INTEGER) AS part FROM (SELECT pid, ROW_NUMBER() OVER (ORDER BY {_TOKEN}, pid) AS rn, COUNT(*) OVER () AS n FROM v_surv)""")
def ratio_split(spark, sf):
    return X.ratio_split(v_surv(spark, sf).select("pid"), 0.8, shuffle=_token())


_POINT_VALUES = ", ".join(f"({v}, {s}, '{t}', '{m}')" for v, s, t, m in L.points_rows())
_BAND_VALUES = ", ".join(f"({a}, {'NULL' if b is None else b}, {p})" for a, b, p in L.BANDS)
SCORE_SQL = f"""
pts AS (SELECT CAST(col0 AS DOUBLE) AS v, CAST(col1 AS DOUBLE) AS s, col2 AS term, col3 AS model FROM (VALUES {_POINT_VALUES})),
bands AS (SELECT CAST(col0 AS DOUBLE) AS lo, CAST(col1 AS DOUBLE) AS hi, CAST(col2 AS DOUBLE) AS p FROM (VALUES {_BAND_VALUES})),
inp AS (SELECT pid, age, CAST(pulse AS DOUBLE) AS pulse, CAST(sys_bp AS DOUBLE) AS sbp, crea / 88.42 AS crea, CAST(COALESCE(killip, 1) AS DOUBLE) AS killip, CAST(CAST(arrest AS INTEGER) AS DOUBLE) AS arrest,
  CAST(CAST(enzymes AS INTEGER) AS DOUBLE) AS enzymes, CAST(CAST(stemi AS INTEGER) AS DOUBLE) AS stemi FROM v_baseline),
terms AS (SELECT pid, 'age' AS term, age AS x FROM inp UNION ALL SELECT pid, 'pulse', pulse FROM inp UNION ALL SELECT pid, 'sbp', sbp FROM inp UNION ALL SELECT pid, 'creatinine', crea FROM inp
  UNION ALL SELECT pid, 'killip', killip FROM inp UNION ALL SELECT pid, 'arrest', arrest FROM inp UNION ALL SELECT pid, 'enzymes', enzymes FROM inp UNION ALL SELECT pid, 'stemi', stemi FROM inp),
near AS (SELECT pid, model, term, x, s FROM (SELECT t.pid, p.model, t.term, t.x, p.s, ROW_NUMBER() OVER (PARTITION BY t.pid, p.model, t.term ORDER BY abs(p.v - t.x), p.v) AS rn FROM terms t JOIN pts p ON p.term = t.term) WHERE rn = 1),
tot AS (SELECT pid, model, CASE WHEN COUNT(x) = 8 THEN ROUND(SUM(s), 7) END AS score FROM near GROUP BY pid, model),
gr AS (SELECT tot.*, CASE model WHEN '6m' THEN CASE WHEN b.p * 100 * (80.0 / 91) > 90 THEN 92 ELSE b.p * 100 * (80.0 / 91) END
    WHEN '1y' THEN (1 - pow(0.9983577131, exp(score))) * 100 ELSE (1 - pow(0.9998715509, exp(score))) * 100 END AS prob
  FROM tot LEFT JOIN bands b ON tot.model = '6m' AND tot.score > b.lo AND (b.hi IS NULL OR tot.score <= b.hi))"""


@query("risk_score", "H25 C10 C11 A12", f"WITH {SCORE_SQL} SELECT pid, model, score + 0 AS score, {q6('prob', 'prob')} FROM gr")
def risk_score(spark, sf):
    rows = v_baseline(spark, sf).fillna({"killip": 1}).withColumn("crea", F.col("crea") / R.CREATININE_UNIT)
    return rounded(R.risk_score(rows), "prob")


@query("risk_scores_table", "H25 H27 A6", f"""
WITH {SCORE_SQL} SELECT gr.pid, CAST(CASE model WHEN '6m' THEN 183 WHEN '1y' THEN 365 ELSE 1095 END AS DOUBLE) AS time, 'GRACE2.0' AS type,
  (b.pulse IS NULL OR b.sys_bp IS NULL OR b.crea IS NULL OR b.enzymes IS NULL) AS imputed, {q6("prob", "value")} FROM gr JOIN v_baseline b ON b.pid = gr.pid""")
def risk_scores_table(spark, sf):
    return rounded(R.risk_scores_table(v_baseline(spark, sf)), "value")


@query("risk_score_completeness", "H27 D10 B27", " UNION ALL ".join(
    f"SELECT '{c}' AS name, {q6(f'AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'missing')} FROM v_baseline" for c in R.INPUTS.values()))
def risk_score_completeness(spark, sf):
    return rounded(missing_rates(v_baseline(spark, sf), list(R.INPUTS.values())), "missing")


_IMPUTED = ["age", "pulse", "sys_bp", "crea", "smoking", "killip"]


@query("imputed_cells", "H26", " UNION ALL ".join(
    f"SELECT '{c}' AS name, COUNT({c}) AS known, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS missing, COUNT(*) - COUNT({c}) AS filled FROM v_baseline" for c in _IMPUTED))
def imputed_cells(spark, sf):
    """Known cells stay as they are, and none is left missing."""
    base = settle(v_baseline(spark, sf).select("pid", *_IMPUTED))
    done = R.impute_forest(base, "pid", _IMPUTED[:4], _IMPUTED[4:], iterations=1, trees=10, depth=4)
    both = base.join(done.select("pid", *[F.col(c).alias(f"n_{c}") for c in _IMPUTED]), "pid")
    kind = lambda c: F.col(c).cast("double") if c in _IMPUTED[:4] else F.col(c).cast("string")
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).isNotNull().alias("known"), (~kind(c).eqNullSafe(F.col(f"n_{c}"))).alias("other"),
                      F.col(f"n_{c}").isNull().alias("missing")) for c in _IMPUTED]
    return both.select(F.inline(F.array(*cells))).groupBy("name").agg(
        F.count_if("known").alias("known"), F.count_if(F.col("known") & F.col("other")).alias("changed"), F.count_if("missing").alias("missing"),
        F.count_if(~F.col("known") & ~F.col("missing")).alias("filled"))


@query("impute_forest", "H26")
def impute_forest(spark, sf):
    return R.impute_forest(v_baseline(spark, sf), "pid", _IMPUTED[:4], _IMPUTED[4:])


#: Masked cells come back with this much of the error of the median or most frequent level, at most.
_IMPUTED_WITHIN = 1.15


@query("imputation_errors", "H26", " UNION ALL ".join(
    f"SELECT '{c}' AS name, COUNT(*) FILTER (WHERE {c} IS NOT NULL AND CAST('0x' || substr(md5(CAST(pid AS VARCHAR) || ':{c}'), 1, 6) AS BIGINT) % 10 = 0) AS n_masked, TRUE AS recovered FROM v_baseline"
    for c in _IMPUTED))
def imputation_errors(spark, sf):
    """A tenth of the known cells of the six columns is hidden and comes back within the stated error; two rounds of 20 trees."""
    errors = R.imputation_errors(v_baseline(spark, sf).select("pid", *_IMPUTED), "pid", _IMPUTED[:4], _IMPUTED[4:], iterations=2, trees=20)
    return errors.select("name", "n_masked", (F.col("error") <= _IMPUTED_WITHIN * F.col("start_error")).alias("recovered"))


@query("feature_dictionary", "H28 B7 D1 D18 C2", """
WITH p AS (SELECT DISTINCT split_part(feature, '_', 1) AS fgroup, split_part(feature, '_', 2) AS fname, NULLIF(split_part(feature, '_', 3), '') AS fvalue FROM v_attributions),
l AS (SELECT fgroup, fname, string_agg(fvalue, '/' ORDER BY fvalue) AS "values" FROM p GROUP BY fgroup, fname),
k AS (SELECT split_part(feature, '_', 2) AS fname, CASE WHEN COUNT(DISTINCT feature) > 1 THEN 'categorical' WHEN COUNT(DISTINCT vals) > 2 THEN 'continuous' ELSE 'logical' END AS type FROM v_attributions GROUP BY 1),
d AS (SELECT code_lvl3 AS fname, MIN(code_block) AS t FROM v_code_parents WHERE code_lvl3 < 'Brand#3' GROUP BY 1), e AS (SELECT p_brand AS fname, MIN(p_name) AS t FROM part GROUP BY 1)
SELECT l.fgroup, l.fname, l."values", k.type, COALESCE(d.t, e.t) AS definition FROM l JOIN k ON k.fname = l.fname LEFT JOIN d ON d.fname = l.fname LEFT JOIN e ON e.fname = l.fname""")
def feature_dictionary(spark, sf):
    attributions = v_attributions(spark, sf)
    first = v_code_parents(spark, sf).where(F.col("code_lvl3") < "Brand#3").groupBy(F.col("code_lvl3").alias("fname")).agg(F.min("code_block").alias("t"))
    second = table(spark, sf, "part").groupBy(F.col("p_brand").alias("fname")).agg(F.min("p_name").alias("t"))
    return X.feature_dictionary(attributions.select("feature"), attributions.select("feature", F.col("vals").alias("value")), first, second)
