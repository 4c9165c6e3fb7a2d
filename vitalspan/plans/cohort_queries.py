"""Cohort selection, cleaning and event tables over the patient views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions import scalars as S
from vitalspan.operators import cohort as C
from vitalspan.operators import events as E
from vitalspan.operators.joins import join_coalesced
from vitalspan.operators.ordered import fill_downup
from vitalspan.operators.validate import validate_table
from vitalspan.plans.registry import longs, q6, query, rounded
from vitalspan.plans.views import (
    procedure_registries, table, unbroadcast, v_baseline, v_code_parents, v_diagnoses_raw, v_index, v_labs, v_patients, v_pats,
    v_persons, v_procedures_raw, v_refint, v_surv, v_tests, v_vitals,
)
from vitalspan.session import settle
from vitalspan.sources.schemas import RULES

BEFORE, AFTER, END_OF_DATA = "2000-01-01", "1995-03-01", "2002-12-31"

_AGE_SQL = """ROUND(full_years + datediff('day', born + to_years(full_years), index_date) / CAST(datediff('day', born + to_years(full_years), born + to_years(full_years + 1)) AS DOUBLE), 2)"""

_STEPS_SQL = f"""
ill AS (SELECT DISTINCT pid FROM v_diagnoses_raw WHERE regexp_matches(CAST(leaf AS VARCHAR), '^(?:1[0-5])') AND regexp_matches(icd10_type, '[AB]')),
s1 AS (SELECT * FROM v_procedures_raw WHERE regexp_matches(native_kar, '^(?:[1-3] gebet|Ateromatose)')),
s2 AS (SELECT * FROM s1 WHERE pid IN (SELECT pid FROM ill)),
s3 AS (SELECT * FROM s2 WHERE proc_date < DATE '{BEFORE}'),
s4a AS (SELECT * FROM s3 WHERE pid NOT IN (SELECT pid FROM s3 WHERE NOT proc_date > DATE '{AFTER}')),
s4 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY proc_date, entryid) AS rn FROM s4a) WHERE rn = 1),
s5 AS (SELECT * FROM s4 WHERE COALESCE(prev_ami, 'Nej') = 'Nej' AND COALESCE(prev_pci, 'Nej') = 'Nej'),
j AS (SELECT s5.pid, s5.entryid, CASE p.sex WHEN 'K' THEN 'F' ELSE p.sex END AS sex, substr(s5.native_kar, 1, 1) AS index_type, s5.proc_date AS index_date, p.born,
  CASE p.status WHEN '90' THEN 'dead' WHEN '01' THEN 'alive' ELSE p.status END AS status, COALESCE(p.status_date, DATE '{END_OF_DATA}') AS status_date,
  CAST(year(s5.proc_date) - year(p.born) - CASE WHEN p.born + to_years(CAST(year(s5.proc_date) - year(p.born) AS INTEGER)) > s5.proc_date THEN 1 ELSE 0 END AS INTEGER) AS full_years
  FROM s5 LEFT JOIN v_persons p ON p.pid = s5.pid),
s6 AS (SELECT *, {_AGE_SQL} AS age FROM j WHERE status IN ('dead', 'alive')),
s7 AS (SELECT * FROM s6 WHERE age >= 18 AND index_date <= status_date)"""


def steps(spark, sf) -> DataFrame:
    diagnoses = v_diagnoses_raw(spark, sf).select("pid", F.col("leaf").cast("string").alias("code"), F.col("icd10_type").alias("type"))
    return C.patient_steps(
        v_procedures_raw(spark, sf), diagnoses, v_persons(spark, sf), BEFORE, AFTER, END_OF_DATA, ["prev_ami", "prev_pci"],
        disease_patterns=("1[0-5]",), disease_types="[AB]")


@query("cohort_attrition", "H1 A13 D2 D3 B3 B4 B5 B25", f"WITH {_STEPS_SQL}\n" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS step, '{n}' AS name, COUNT(DISTINCT pid) AS patients FROM s{i}"
    for i, n in enumerate(["sites", "diagnosis", "before", "after", "no_prior", "status_ok", "adult"], 1)))
def cohort_attrition(spark, sf):
    return C.attrition_log(steps(spark, sf))


@query("select_cohort", "H1 E2 C2 C5 D4 B6 B12 B19", f"""
WITH {_STEPS_SQL} SELECT pid, entryid, sex, index_type, index_date, {q6("age", "age")}, status, status_date FROM s7""")
def select_cohort(spark, sf):
    return rounded(C.select_cohort(steps(spark, sf)), "age")


@query("attrition_rows", "A13", """
SELECT CAST(1 AS INTEGER) AS step, 'prev' AS name, COUNT(DISTINCT pid) AS patients FROM v_procedures_raw WHERE prev_ami = 'Nej'
UNION ALL SELECT 2, 'weight', COUNT(DISTINCT pid) FROM v_procedures_raw WHERE prev_ami = 'Nej' AND weight > 250
UNION ALL SELECT 3, 'pressure', COUNT(DISTINCT pid) FROM v_procedures_raw WHERE prev_ami = 'Nej' AND weight > 250 AND sys_bp > 200""")
def attrition_rows(spark, sf):
    return C.attrition(v_procedures_raw(spark, sf), "pid", [
        ("prev", F.col("prev_ami") == "Nej"), ("weight", F.col("weight") > 250), ("pressure", F.col("sys_bp") > 200)])


@query("procedure_summary", "H2 D1 B15", """
WITH r AS (SELECT l_orderkey AS entryid, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS grade, l_returnflag || l_linestatus AS site,
  l_partkey, l_suppkey, l_extendedprice FROM lineitem)
SELECT entryid, CASE WHEN COUNT(grade) = COUNT(*) THEN string_agg(grade, ',' ORDER BY l_partkey, l_suppkey, l_extendedprice, grade) END AS amount,
  string_agg(site, ',' ORDER BY l_partkey, l_suppkey, l_extendedprice, site) AS sites FROM r GROUP BY entryid""")
def procedure_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("entryid"), F.when(F.col("l_linenumber") == 7, "x").otherwise(F.col("l_linenumber").cast("string")).alias("grade"),
        F.concat("l_returnflag", "l_linestatus").alias("site"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("order"))
    return C.procedure_summary(rows)


@query("clean_diagnoses", "H4 C5 B12 B17 B5", """
WITH raw AS (SELECT o.o_custkey AS pid, l.l_orderkey * 10 + l.l_linenumber AS recnum, CAST(l.l_shipdate AS DATE) AS in_date,
  CASE WHEN l.l_linenumber <> 3 THEN l.l_linenumber * 3 ELSE 0 END AS in_hour, CASE WHEN l.l_returnflag <> 'A' THEN l.l_linenumber * 5 ELSE 0 END AS in_minute,
  CASE l.l_returnflag WHEN 'R' THEN 'E' ELSE 'D' END || chr(CAST(65 + l.l_partkey % 26 AS INTEGER)) || CAST(l.l_partkey % 100 AS VARCHAR) AS icd10_code
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
SELECT pid, recnum, strftime(CAST(in_date AS TIMESTAMP) + to_hours(in_hour) + to_minutes(in_minute), '%Y-%m-%d %H:%M') AS from_dttm,
  strftime(CAST(in_date AS TIMESTAMP) + to_hours(in_hour), '%Y-%m-%d %H:%M') AS disc_dttm, icd10_code
FROM raw WHERE pid IN (SELECT pid FROM v_patients) AND regexp_matches(icd10_code, '^D[A-Z][0-9]')""")
def clean_diagnoses(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pid"))
    line = F.col("l_linenumber")
    raw = table(spark, sf, "lineitem").join(orders, "l_orderkey").select(
        "pid", (F.col("l_orderkey") * 10 + line).alias("recnum"), F.col("l_shipdate").cast("date").alias("in_date"),
        F.when(line != 3, line * 3).alias("in_hour"), F.when(F.col("l_returnflag") != "A", line * 5).alias("in_minute"),
        F.col("l_shipdate").cast("date").alias("out_date"), F.when(line != 3, line * 3).alias("out_hour"),
        F.concat(F.when(F.col("l_returnflag") == "R", "E").otherwise("D"), F.char(F.col("l_partkey") % 26 + 65), (F.col("l_partkey") % 100).cast("string")).alias("icd10_code"),
        F.lit("A").alias("icd10_type"), F.lit(None).cast("string").alias("icd10_extra"))
    out = C.clean_diagnoses(raw, v_patients(spark, sf))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return out.select("pid", "recnum", text("from_dttm"), text("disc_dttm"), "icd10_code")


@query("survival_table_split", "H3 F4 B18", """
WITH s AS (SELECT pid, CAST(datediff('day', index_date, status_date) AS BIGINT) AS time, event, md5(CAST(pid AS VARCHAR)) AS tok FROM v_patients)
SELECT pid, time, event, ROW_NUMBER() OVER (ORDER BY tok, pid) > 300 AS train FROM s""")
def survival_table_split(spark, sf):
    patients = v_patients(spark, sf).withColumn("status", F.when(F.col("event"), "dead").otherwise("alive"))
    out = C.survival_table(patients, 300, shuffle=F.md5(F.col("pid").cast("string").cast("binary")))
    return longs(out, "time")


_REPAIR_SQL = """
w AS (SELECT *, CASE WHEN weight > 500 THEN weight / 10 ELSE weight END AS w1 FROM src),
hw AS (SELECT *, CASE WHEN height < 150 AND w1 > 150 THEN height WHEN NOT (height < 150 AND w1 > 150) THEN w1 END AS w2,
  CASE WHEN height < 150 AND w1 > 150 THEN w1 WHEN NOT (height < 150 AND w1 > 150) THEN height END AS h2,
  CASE WHEN sys_bp <= 300 THEN sys_bp END AS s1, CASE WHEN dia_bp <= 300 THEN dia_bp END AS d1 FROM w),
rep AS (SELECT * EXCLUDE (weight, height, sys_bp, dia_bp, w1, w2, h2, s1, d1), w2 AS weight, CASE WHEN h2 BETWEEN 130 AND 250 THEN h2 END AS height,
  CASE WHEN d1 > s1 THEN d1 WHEN NOT d1 > s1 THEN s1 END AS sys_bp, CASE WHEN d1 > s1 THEN s1 WHEN NOT d1 > s1 THEN d1 END AS dia_bp FROM hw)"""


def _fill_sql(columns) -> str:
    return ", ".join(
        f"COALESCE(last_value({c} IGNORE NULLS) OVER (PARTITION BY pid ORDER BY proc_date, entryid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY pid ORDER BY proc_date, entryid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in columns)


_VITALS = ["height", "weight", "sys_bp", "dia_bp"]


@query("baseline_repair_fill", "B11 B13 E3", f"""
WITH src AS (SELECT * FROM v_procedures_raw), {_REPAIR_SQL}, f AS (SELECT pid, entryid, {_fill_sql(_VITALS)} FROM rep)
SELECT pid, entryid, {", ".join(q6(c, c) for c in _VITALS)} FROM f""")
def baseline_repair_fill(spark, sf):
    repaired = C.repair_vitals(v_procedures_raw(spark, sf)).select("pid", "entryid", "proc_date", *_VITALS)
    return rounded(fill_downup(repaired, ["pid"], ["proc_date", "entryid"], _VITALS).drop("proc_date"), *_VITALS)


_MEASURED = ["height", "weight", "pulse", "sys_bp", "dia_bp"]


_BASELINE_CTE = f"""
src AS (SELECT * RENAME (height_cm AS height, weight_kg AS weight, creatinine AS crea) FROM v_pats), {_REPAIR_SQL},
lab AS (SELECT pid, crea AS crea2, enz FROM (SELECT pid, crea FROM (SELECT pid, TRY_CAST(shown_clean AS DOUBLE) AS crea, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY (t_since > 1), abs(t_since), test_id) AS rn
    FROM v_labs WHERE component_db = 'CREATININIUM' AND unit_clean = 'umol/L' AND t_since BETWEEN -90 AND 21) WHERE rn = 1) FULL JOIN
  (SELECT pid, CASE WHEN bool_or(flag) THEN TRUE WHEN bool_or(flag IS NULL) THEN NULL ELSE FALSE END AS enz FROM v_labs WHERE component_db <> 'CREATININIUM' AND t_since BETWEEN -90 AND 6 GROUP BY pid) USING (pid)),
x AS (SELECT rep.* EXCLUDE (crea, pulse, enzymes, arrest, stemi, dominance), COALESCE(rep.crea, lab.crea2) AS c0, COALESCE(rep.enzymes = 'Positiv', lab.enz) AS enzymes,
  CASE WHEN rep.pulse BETWEEN 30 AND 300 THEN rep.pulse END AS pulse, COALESCE(rep.arrest = 'Ja', FALSE) AS arrest, COALESCE(rep.stemi, FALSE) AS stemi,
  CASE WHEN smoking_status LIKE 'Akt%' THEN 'yes' WHEN smoking_status LIKE 'Ald%' THEN 'no' WHEN smoking_status LIKE 'Eks%' THEN 'ex' END AS smoking,
  CASE WHEN native_kar LIKE '1 gebet%' THEN '1VD' WHEN native_kar LIKE '2 gebet%' THEN '2VD' WHEN native_kar LIKE '3 gebet%' THEN '3VD' ELSE 'DIF' END AS vessels,
  CASE WHEN dominance LIKE 'Bal%' THEN 'B' WHEN dominance LIKE 'Højre%' THEN 'R' WHEN dominance LIKE 'Venstre%' THEN 'L' END AS dominance,
  CAST(CASE nyha_class WHEN 'NYHA I' THEN 1 WHEN 'NYHA II' THEN 2 WHEN 'NYHA III' THEN 3 WHEN 'NYHA IV' THEN 4 END AS INTEGER) AS nyha,
  CAST(CASE ccs_class WHEN 'Ingen' THEN 0 WHEN 'CCS I' THEN 1 WHEN 'CCS II' THEN 2 WHEN 'CCS IV' THEN 4 END AS INTEGER) AS ccs,
  CAST(CASE killip_class WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'IV' THEN 4 END AS INTEGER) AS killip
  FROM rep LEFT JOIN lab ON lab.pid = rep.pid WHERE rep.pid IN (SELECT pid FROM v_index)),
f AS (SELECT * EXCLUDE ({", ".join(_MEASURED)}), {_fill_sql(_MEASURED)} FROM x),
base AS (SELECT f.pid, i.sex = 'M' AS sex, i.age, {", ".join(_MEASURED)}, CASE WHEN c0 <= 400 THEN c0 END AS crea, arrest, enzymes, stemi, smoking, vessels, dominance, nyha, ccs, killip
  FROM f JOIN v_index i ON i.pid = f.pid AND i.entryid = f.entryid)"""


def lab_supplement(spark, sf, lines: DataFrame | None = None) -> DataFrame:
    labs = v_labs(spark, sf, lines)
    return C.closest_lab(labs, tiebreak=["test_id"]).join(C.any_elevated(labs), "pid", "full")


def baseline(spark, sf, index: DataFrame | None = None, lines: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """The laboratory supplement is settled, so that no task holds the sorts of its steps beside those of the procedures."""
    index = v_index(spark, sf) if index is None else index
    return C.baseline_table(index, v_pats(spark, sf), [unbroadcast(settle(lab_supplement(spark, sf, lines)))], entries)


@query("baseline_table", "H5 B8 B10 B11 B12 B13 B14 C2 C3 E3", f"""
WITH {_BASELINE_CTE} SELECT pid, sex, age, {q6("height", "height")}, {q6("weight", "weight")}, pulse, sys_bp, dia_bp, {q6("crea", "crea")}, arrest, enzymes, stemi, smoking, vessels, dominance, nyha, ccs, killip FROM base""")
def baseline_table(spark, sf):
    return rounded(baseline(spark, sf), "height", "weight", "crea")


CLINICAL_TWO_CTE = f"""{_BASELINE_CTE}, yn AS (SELECT p.pid, CASE familiary_ihd WHEN 'Ja' THEN 'yes' WHEN 'Nej' THEN 'no' ELSE 'missing' END AS familiary_ihd,
  COALESCE(arrhythmia_device IN ('BIV-ICD', 'BIV-PM', 'PM', 'ICD'), FALSE) AS icd_or_pm, LEAST(TRY_CAST(lvef AS DOUBLE), CASE WHEN TRY_CAST(lvef AS DOUBLE) IS NULL THEN NULL ELSE 60 END) AS ef,
  CASE WHEN ischemia_test IS NULL THEN 'missing' WHEN ischemia_test = 'Ikke konklusiv' THEN 'inconclusive' WHEN ischemia_test = 'Ikke udført' THEN 'missing' WHEN ischemia_test = 'Negativ' THEN 'negative' WHEN ischemia_test = 'Positiv' THEN 'positive' END AS ischemia_test,
  CASE abnormal_ekg WHEN 'Ja' THEN 'yes' WHEN 'Nej' THEN 'no' ELSE 'missing' END AS abnormal_ekg, CASE abnormal_qrs WHEN 'Ja' THEN 'yes' WHEN 'Nej' THEN 'no' ELSE 'missing' END AS abnormal_qrs_st
  FROM v_pats p JOIN v_index i ON i.pid = p.pid AND i.entryid = p.entryid),
ct AS (SELECT b.pid, sex, height, weight, dia_bp, smoking, vessels, dominance, nyha, ccs, familiary_ihd, icd_or_pm,
  CASE WHEN ef IS NULL THEN 'missing' WHEN ef <= 10 THEN '[0,10]' WHEN ef <= 20 THEN '(10,20]' WHEN ef <= 30 THEN '(20,30]' WHEN ef <= 40 THEN '(30,40]' WHEN ef <= 50 THEN '(40,50]' ELSE '(50,60]' END AS lvef,
  ischemia_test, abnormal_ekg, abnormal_qrs_st FROM base b JOIN yn ON yn.pid = b.pid)"""


#: Days after the index date up to which a supplementary measure counts; no other event that a study reads is later.
LINES_AFTER = max(C.LAB_WINDOW[1], 1)


def clinical_two_table(spark, sf, patients: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Index entries, their procedures and baseline are settled: each is a chain of sorts by patient that one stage would hold at once."""
    index = unbroadcast(settle(v_index(spark, sf, patients)))
    placed = index.select(F.col("pid").alias("o_custkey"), F.col("entryid").alias("o_orderkey"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    entries = unbroadcast(settle(v_pats(spark, sf, orders.join(placed, ["o_custkey", "o_orderkey"], "left_semi"))))
    return C.clinical_two(index, entries, unbroadcast(settle(baseline(spark, sf, index, lines, entries))))


@query("clinical_two", "H11 B10 B23 B28 C1 A7", f"""
WITH {CLINICAL_TWO_CTE} SELECT pid, sex, {q6("height", "height")}, {q6("weight", "weight")}, dia_bp, smoking, vessels, dominance, nyha, ccs, familiary_ihd, icd_or_pm, lvef, ischemia_test, abnormal_ekg, abnormal_qrs_st FROM ct""")
def clinical_two(spark, sf):
    return rounded(clinical_two_table(spark, sf), "height", "weight")


@query("closest_lab", "H6 C8 B15 B18 B21", f"""
SELECT pid, {q6("crea", "crea")} FROM (SELECT pid, TRY_CAST(shown_clean AS DOUBLE) AS crea, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY (t_since > 1), abs(t_since), test_id) AS rn
  FROM v_labs WHERE component_db = 'CREATININIUM' AND unit_clean = 'umol/L' AND t_since BETWEEN -90 AND 21) WHERE rn = 1""")
def closest_lab(spark, sf):
    return rounded(C.closest_lab(v_labs(spark, sf), tiebreak=["test_id"]), "crea")


@query("any_elevated", "H6 D3", """
SELECT pid, CASE WHEN bool_or(flag) THEN TRUE WHEN bool_or(flag IS NULL) THEN NULL ELSE FALSE END AS enzymes FROM v_labs
WHERE component_db <> 'CREATININIUM' AND t_since BETWEEN -90 AND 6 GROUP BY pid""")
def any_elevated(spark, sf):
    return C.any_elevated(v_labs(spark, sf))


@query("closest_vital", "H6 C8 B18 C4", f"""
WITH t AS (SELECT *, (epoch_us(ts) - epoch_us(index_ts)) / 86400000000.0 AS d FROM v_vitals),
a AS (SELECT pid, pulse FROM (SELECT pid, pulse, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY (d - 1 > 0), abs(d), event_id) AS rn FROM t WHERE d BETWEEN -182 AND 31) WHERE rn = 1),
b AS (SELECT pid, pulse AS sys_bp FROM (SELECT pid, pulse, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY (d - 1 > 0), abs(d), event_id) AS rn FROM t WHERE d BETWEEN -182 AND 31 AND flag) WHERE rn = 1)
SELECT pid, {q6("a.pulse", "pulse")}, {q6("b.sys_bp", "sys_bp")} FROM a FULL JOIN b USING (pid)""")
def closest_vital(spark, sf):
    vitals = v_vitals(spark, sf)
    pulse = C.closest_vital(vitals, "pulse", tiebreak=["event_id"])
    pressure = C.closest_vital(vitals.where("flag"), "pulse", tiebreak=["event_id"], out="sys_bp")
    return rounded(pulse.join(pressure, "pid", "full"), "pulse", "sys_bp")


DIAG_SQL = """
pre AS (SELECT d.pid, CAST(datediff('day', p.index_date, d.disc_date) AS BIGINT) AS time, d.leaf FROM v_diagnoses_raw d JOIN v_patients p ON p.pid = d.pid
  WHERE regexp_matches(d.icd10_type, '^(?:A|B)') AND d.disc_date < p.index_date),
lv AS (SELECT pid, time, l.level, l.code FROM (SELECT pre.pid, pre.time, UNNEST([{'level': 'lvl4', 'code': c.code_lvl4}, {'level': 'lvl3', 'code': c.code_lvl3}, {'level': 'block', 'code': c.code_block}, {'level': 'chap', 'code': c.code_chap}]) AS l
  FROM pre JOIN v_code_parents c ON c.leaf = pre.leaf)),
rare AS (SELECT code FROM lv GROUP BY code HAVING COUNT(DISTINCT pid) / CAST((SELECT COUNT(*) FROM v_patients) AS DOUBLE) < 0.02),
diag AS (SELECT * FROM lv WHERE code NOT IN (SELECT code FROM rare))"""


def diagnosis_events(spark, sf, min_share: float = 0.02, patients: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    patients = v_patients(spark, sf) if patients is None else patients
    out = E.diagnosis_events(
        v_diagnoses_raw(spark, sf, lines), patients, v_code_parents(spark, sf), F.col("leaf"), "leaf", min_share=min_share)
    return longs(out, "time")


@query("diagnosis_rollup_common", "H7 C9 C19 D6 B5 C6", f"WITH {DIAG_SQL} SELECT pid, time, level, code FROM diag")
def diagnosis_rollup_common(spark, sf):
    return diagnosis_events(spark, sf)


LAB_SQL = """
m AS (SELECT t.*, p.index_date, p.age, p.sex, r.npu_code, r.refint_1, r.refint_2,
    CAST(round(p.age * 365.25) AS BIGINT) + datediff('day', p.index_date, t.drawn_date) AS age_days, r.valid_from, r.valid_to, r.age_from_days, r.age_to_days
  FROM v_tests t JOIN v_patients p ON p.pid = t.pid LEFT JOIN v_refint r ON r.npu_code = t.qid AND r.sex = p.sex
  WHERE p.index_date >= t.drawn_date - INTERVAL 1 DAY AND t.result IS NOT NULL),
k AS (SELECT *, COALESCE(ref_lower, refint_1) AS ref_1, COALESCE(ref_upper, refint_2) AS ref_2 FROM m
  WHERE COALESCE(drawn_date BETWEEN valid_from AND valid_to, TRUE) AND COALESCE(age_days BETWEEN age_from_days AND age_to_days, TRUE)),
latest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid, qid ORDER BY drawn_date DESC, test_id DESC, ref_1 DESC NULLS LAST, ref_2 DESC NULLS LAST, result DESC) AS rn FROM k WHERE ref_1 IS NOT NULL OR ref_2 IS NOT NULL) WHERE rn = 1),
common AS (SELECT qid FROM latest GROUP BY qid HAVING COUNT(*) > 0.05 * (SELECT COUNT(*) FROM v_patients)),
labs AS (SELECT pid, qid, CAST(datediff('day', drawn_date, index_date) AS BIGINT) AS time,
  CAST(CASE WHEN COALESCE(result < ref_1, FALSE) AND (ref_1 IS NULL OR ref_2 IS NULL) THEN -1 WHEN COALESCE(result < ref_1, FALSE) OR COALESCE(result > ref_2, FALSE) THEN 1 ELSE 0 END AS INTEGER) AS value
  FROM latest WHERE qid IN (SELECT qid FROM common))"""


def lab_events(spark, sf, patients: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    patients = v_patients(spark, sf) if patients is None else patients
    return longs(E.flag_lab_results(v_tests(spark, sf, lines), patients, v_refint(spark, sf)), "time")


@query("lab_flags", "H8 C7 C15 D7 E1 B20 B21", f"WITH {LAB_SQL} SELECT pid, qid, time, value FROM labs")
def lab_flags(spark, sf):
    return lab_events(spark, sf)


PROC_SQL = """
pc AS (SELECT c.pid, substr(c.code, 1, 6) AS code, CAST(MIN(datediff('day', c.date, p.index_date)) AS BIGINT) AS time FROM v_proc_codes c JOIN v_patients p ON p.pid = c.pid
  WHERE datediff('day', c.date, p.index_date) > 0 GROUP BY 1, 2),
procs AS (SELECT * FROM pc WHERE code IN (SELECT code FROM pc GROUP BY code HAVING COUNT(*) > 0.01 * (SELECT COUNT(*) FROM v_patients)))"""


def proc_events(spark, sf, patients: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    patients = v_patients(spark, sf) if patients is None else patients
    first, second = procedure_registries(spark, sf, lines)
    registries = [first.where(F.col("code").startswith("K")), second.where(F.col("code").startswith("U"))]
    return longs(E.procedure_events(registries, patients), "time")


@query("procedure_codes_common", "H9 G1 D8 E1 C9 B8", f"WITH {PROC_SQL} SELECT pid, code, time FROM procs")
def procedure_codes_common(spark, sf):
    return proc_events(spark, sf)


@query("genetic_scores", "H10 C5 B11", f"SELECT pid, name, {q6('score', 'score')} FROM v_scores WHERE pid IN (SELECT pid FROM v_patients)")
def genetic_scores(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.lit("ENGAGE").alias("name"), F.col("c_acctbal").alias("score"))
    means = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("pid"), F.concat(F.lit("SEG"), F.substring("o_orderpriority", 1, 1)).alias("name")).agg(F.avg("o_totalprice").alias("score"))
    return rounded(E.genetic_scores(raw.unionByName(means), v_patients(spark, sf)), "score")


@query("validate_tables", "A11 A6 G4", """
SELECT 'surv_master' AS tab, 'primary_key:pid' AS rule, (SELECT COUNT(*) FROM (SELECT pid FROM v_surv GROUP BY pid HAVING COUNT(*) > 1)) AS violations
UNION ALL SELECT 'pats', 'primary_key:pid', (SELECT COUNT(*) FROM (SELECT pid FROM v_pats GROUP BY pid HAVING COUNT(*) > 1))
UNION ALL SELECT 'pats', 'foreign_key:pid', COUNT(*) FROM v_pats WHERE pid NOT IN (SELECT pid FROM v_surv)
UNION ALL SELECT 'pats', 'domain:enzymes', COUNT(*) FROM v_pats WHERE enzymes NOT IN ('Positiv')
UNION ALL SELECT 'pats', 'range:pulse', COUNT(*) FROM v_pats WHERE NOT pulse BETWEEN 30 AND 300
UNION ALL SELECT 'pats', 'not_null:dominance', COUNT(*) FROM v_pats WHERE dominance IS NULL
UNION ALL SELECT 'baseline', 'domain:smoking', COUNT(*) FROM v_baseline WHERE smoking NOT IN ('yes', 'ex', 'no')
UNION ALL SELECT 'baseline', 'domain:vessels', COUNT(*) FROM v_baseline WHERE vessels NOT IN ('DIF', '1VD', '2VD', '3VD')
UNION ALL SELECT 'baseline', 'domain:dominance', COUNT(*) FROM v_baseline WHERE dominance NOT IN ('R', 'L', 'B')
UNION ALL SELECT 'baseline', 'range:nyha', COUNT(*) FROM v_baseline WHERE NOT nyha BETWEEN 1 AND 4
UNION ALL SELECT 'baseline', 'range:ccs', COUNT(*) FROM v_baseline WHERE NOT ccs BETWEEN 0 AND 4
UNION ALL SELECT 'baseline', 'range:killip', COUNT(*) FROM v_baseline WHERE NOT killip BETWEEN 1 AND 4
UNION ALL SELECT 'baseline', 'primary_key:pid', (SELECT COUNT(*) FROM (SELECT pid FROM v_baseline GROUP BY pid HAVING COUNT(*) > 1))
UNION ALL SELECT 'baseline', 'foreign_key:pid', COUNT(*) FROM v_baseline WHERE pid NOT IN (SELECT pid FROM v_surv)""")
def validate_tables(spark, sf):
    surv, pats, base = v_surv(spark, sf), v_pats(spark, sf), v_baseline(spark, sf)
    own = [
        {"rule": "primary_key", "columns": ["pid"]}, {"rule": "foreign_key", "columns": ["pid"], "parent": "surv_master"},
        {"rule": "domain", "column": "enzymes", "values": ["Positiv"]}, {"rule": "range", "column": "pulse", "lo": 30, "hi": 300},
        {"rule": "not_null", "column": "dominance"}]
    reports = {"surv_master": validate_table(surv, RULES["surv_master"], {}), "pats": validate_table(pats, own, {"surv_master": surv}),
               "baseline": validate_table(base, RULES["baseline"], {"surv_master": surv})}
    return reduce(DataFrame.unionByName, [df.withColumn("tab", F.lit(n)) for n, df in reports.items()])


@query("code_hierarchy", "C19", """
WITH d AS (SELECT DISTINCT 'I' || CAST(p_partkey % 1000 AS VARCHAR) AS icd10, p_brand AS block, p_size AS chapter FROM part)
SELECT 'D' || icd10 AS code_lvl4, substr('D' || icd10, 1, 4) AS code_lvl3, block AS code_block, 'Ch' || CAST(chapter AS VARCHAR) AS code_chap FROM d WHERE length(icd10) = 4""")
def code_hierarchy(spark, sf):
    """Leaf codes and their parents from a definition table with codes of several lengths."""
    definitions = table(spark, sf, "part").select(
        F.concat(F.lit("I"), (F.col("p_partkey") % 1000).cast("string")).alias("icd10"), F.col("p_brand").alias("block"), F.col("p_size").alias("chapter")).distinct()
    return E.build_code_hierarchy(definitions)
