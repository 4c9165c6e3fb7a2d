"""Patient-style views over the given tables, once as DataFrames and once as SQL text for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.session import settle

COHORT_START = "1997-01-01"
TIMES = [float(n * 80 + 20) for n in range(25)]
SCORED_MODELS = {"001": 7, "006": 13}

VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _view(name: str, sql: str):
    def register(fn):
        VIEWS[name], SQL[name] = fn, sql.strip()
        return fn
    return register


# Declared schemas: no footer is read to plan a scan.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
        "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def unbroadcast(df: DataFrame) -> DataFrame:
    """The same rows, met by a sort-merge join in the next join unless the other side is broadcast by name.

    The planner takes a side to be as large as its files. Keys and repeated values make small files of many rows, and
    rows that an explode multiplies are not counted at all, so it would collect millions of rows in the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows dealt by ``key`` over all shuffle partitions, before each becomes many.

    A small file is read by one or two tasks. Rows that are exploded after this stay dealt by their key, so that windows
    and groups that hold the key need no other shuffle of them. The number is given, as small rows would be merged again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf)


def with_views(sql: str) -> str:
    """Prepend the views a query mentions, and the views those need, as common table expressions."""
    needed: list[str] = []
    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in SQL and name not in needed:
                visit(SQL[name])
                needed.append(name)
    visit(sql)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


@_view("v_patients", """
SELECT c.c_custkey AS pid, (c.c_nationkey % 2 = 0) AS sex, CAST(18 + c.c_custkey % 75 AS DOUBLE) AS age,
       CAST(o.first_dt AS DATE) AS index_date, CAST(o.last_dt AS DATE) AS status_date,
       (c.c_custkey % 3 = 0) AS event, (c.c_custkey % 5 <> 0) AS train
FROM customer c JOIN (SELECT o_custkey, MIN(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' THEN o_orderdate END) AS first_dt,
                             MAX(o_orderdate) AS last_dt FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
WHERE o.first_dt IS NOT NULL""")
def v_patients(spark, sf):
    start = F.lit(COHORT_START).cast("timestamp_ntz")
    spans = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(F.when(F.col("o_orderdate") >= start, F.col("o_orderdate"))).alias("first_dt"),
        F.max("o_orderdate").alias("last_dt")).where(F.col("first_dt").isNotNull())
    return unbroadcast(table(spark, sf, "customer")).join(spans, "c_custkey").select(
        F.col("c_custkey").alias("pid"), (F.col("c_nationkey") % 2 == 0).alias("sex"),
        (F.col("c_custkey") % 75 + 18).cast("double").alias("age"), F.col("first_dt").cast("date").alias("index_date"),
        F.col("last_dt").cast("date").alias("status_date"), (F.col("c_custkey") % 3 == 0).alias("event"),
        (F.col("c_custkey") % 5 != 0).alias("train"))


@_view("v_surv", "SELECT pid, train, datediff('day', index_date, status_date) AS time, event FROM v_patients")
def v_surv(spark, sf):
    return surv_of(v_patients(spark, sf))


def settled_patients(spark, sf) -> DataFrame:
    """``v_patients``, settled for a query that joins several tables with them, so that they are worked out once."""
    return unbroadcast(settle(v_patients(spark, sf)))


def surv_of(patients: DataFrame) -> DataFrame:
    return patients.select(
        "pid", "train", F.datediff("status_date", "index_date").cast("bigint").alias("time"), "event")


@_view("v_procedures_raw", """
SELECT o_custkey AS pid, o_orderkey AS entryid, CAST(o_orderdate AS DATE) AS proc_date,
       CASE WHEN o_orderstatus = 'F' THEN 'Ja' ELSE 'Nej' END AS prev_ami, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Nej' END AS prev_pci,
       CAST(1 + o_orderkey % 4 AS VARCHAR(10)) || ' gebet' AS native_kar, o_totalprice / 1000 AS weight, o_totalprice / 2000 AS height,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 350 AS DOUBLE) END AS sys_bp,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 330 AS DOUBLE) END AS dia_bp
FROM orders""")
def v_procedures_raw(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pid"), k.alias("entryid"), F.col("o_orderdate").cast("date").alias("proc_date"),
        F.when(F.col("o_orderstatus") == "F", "Ja").otherwise("Nej").alias("prev_ami"),
        F.when(k % 11 != 0, "Nej").alias("prev_pci"),
        F.concat((k % 4 + 1).cast("string"), F.lit(" gebet")).alias("native_kar"),
        (F.col("o_totalprice") / 1000).alias("weight"), (F.col("o_totalprice") / 2000).alias("height"),
        F.when(k % 5 != 0, (k % 350).cast("double")).alias("sys_bp"),
        F.when(k % 7 != 0, (k % 330).cast("double")).alias("dia_bp"))


def _order_lines(spark, sf, *columns, lines=None):
    """Order lines with their customer; those of :func:`patient_lines`, with their patient's columns, if they are given."""
    if lines is not None:
        return lines.select("o_orderkey", "o_custkey", *columns, *PATIENT)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *columns)
    return orders.join(lines, "o_orderkey")


#: Columns of a patient that :func:`patient_lines` puts beside each of the patient's order lines.
PATIENT = ("index_date", "age", "sex")
#: The columns of order lines that the views of events are made from.
LINE = ("l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")


def patient_lines(spark, sf, patients: DataFrame, days_after: int) -> DataFrame:
    """The patients' order lines up to so many days after the index date, with their patient's columns, settled.

    A query that makes several kinds of events of them joins the tables once. The lines are dealt by patient as they are
    written, so that an aggregation by patient meets all rows of a patient in one task of the scan.
    """
    met = _order_lines(spark, sf, *LINE).join(patients.select(F.col("pid").alias("o_custkey"), *PATIENT), "o_custkey")
    return settle(met.where(F.col("l_shipdate").cast("date") <= F.date_add("index_date", days_after)))


def _also(rows: DataFrame) -> list[str]:
    return [c for c in PATIENT if c in rows.columns]


@_view("v_diagnoses_raw", """
SELECT o.o_custkey AS pid, o.o_orderkey AS recnum, CAST(l.l_shipdate AS DATE) AS disc_date,
       CASE l.l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'G' END AS icd10_type, l.l_partkey AS leaf
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def v_diagnoses_raw(spark, sf, lines=None):
    rows = _order_lines(spark, sf, "l_shipdate", "l_returnflag", "l_partkey", lines=lines)
    return rows.select(
        F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("recnum"), F.col("l_shipdate").cast("date").alias("disc_date"),
        F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("G").alias("icd10_type"),
        F.col("l_partkey").alias("leaf"), *_also(rows))


@_view("v_code_parents", """
SELECT p_partkey AS leaf, 'L' || CAST(p_partkey % 100 AS VARCHAR(10)) AS code_lvl4, p_brand AS code_lvl3, p_type AS code_block, 'Ch' || CAST(p_size % 10 AS VARCHAR(10)) AS code_chap
FROM part""")
def v_code_parents(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("leaf"), F.concat(F.lit("L"), (F.col("p_partkey") % 100).cast("string")).alias("code_lvl4"),
        F.col("p_brand").alias("code_lvl3"), F.col("p_type").alias("code_block"),
        F.concat(F.lit("Ch"), (F.col("p_size") % 10).cast("string")).alias("code_chap"))


@_view("v_tests", """
SELECT o.o_custkey AS pid, 'NPU' || CAST(l.l_linenumber AS VARCHAR(10)) AS qid, CAST(l.l_shipdate AS DATE) AS drawn_date, l.l_quantity AS result,
       CASE WHEN l.l_linestatus = 'F' THEN CAST(10 AS DOUBLE) END AS ref_lower, CASE WHEN l.l_returnflag <> 'N' THEN CAST(40 AS DOUBLE) END AS ref_upper,
       l.l_orderkey * 10 + l.l_linenumber AS test_id
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def v_tests(spark, sf, lines=None):
    rows = _order_lines(spark, sf, "l_shipdate", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", lines=lines)
    return rows.select(
        F.col("o_custkey").alias("pid"), F.concat(F.lit("NPU"), F.col("l_linenumber").cast("string")).alias("qid"),
        F.col("l_shipdate").cast("date").alias("drawn_date"), F.col("l_quantity").alias("result"),
        F.when(F.col("l_linestatus") == "F", 10.0).alias("ref_lower"), F.when(F.col("l_returnflag") != "N", 40.0).alias("ref_upper"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("test_id"), *_also(rows))


@_view("v_refint", """
SELECT 'NPU' || CAST(r.r_regionkey + 1 AS VARCHAR(10)) AS npu_code, (n.n_nationkey % 2 = 0) AS sex, CAST(MIN(n.n_nationkey) + 5 AS DOUBLE) AS refint_1, CAST(MAX(n.n_nationkey) + 20 AS DOUBLE) AS refint_2,
       DATE '1996-01-01' AS valid_from, CASE WHEN r.r_regionkey % 2 = 0 THEN DATE '1999-12-31' END AS valid_to,
       CAST(6570 AS DOUBLE) AS age_from_days, CASE WHEN r.r_regionkey < 3 THEN CAST(25550 AS DOUBLE) END AS age_to_days
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey, (n.n_nationkey % 2 = 0)""")
def v_refint(spark, sf):
    rows = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    grouped = rows.groupBy("r_regionkey", (F.col("n_nationkey") % 2 == 0).alias("sex")).agg(
        (F.min("n_nationkey") + 5).cast("double").alias("refint_1"), (F.max("n_nationkey") + 20).cast("double").alias("refint_2"))
    return grouped.select(
        F.concat(F.lit("NPU"), (F.col("r_regionkey") + 1).cast("string")).alias("npu_code"), "sex", "refint_1", "refint_2",
        F.lit("1996-01-01").cast("date").alias("valid_from"),
        F.when(F.col("r_regionkey") % 2 == 0, F.lit("1999-12-31").cast("date")).alias("valid_to"),
        F.lit(6570.0).alias("age_from_days"), F.when(F.col("r_regionkey") < 3, 25550.0).alias("age_to_days"))


@_view("v_vitals", """
SELECT user_id AS pid, event_id, ts, value AS pulse, event_type = 'error' AS flag, TIMESTAMP '2024-01-15 00:00:00' AS index_ts
FROM events""")
def v_vitals(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("pid"), "event_id", "ts", F.col("value").alias("pulse"),
        (F.col("event_type") == "error").alias("flag"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("index_ts"))


@_view("v_proc_codes", """
SELECT o_custkey AS pid, 'K' || SUBSTRING(o_orderpriority, 1, 1) || o_orderstatus AS code, CAST(o_orderdate AS DATE) AS date FROM orders
UNION ALL
SELECT o.o_custkey, 'U' || l.l_returnflag || l.l_linestatus || CAST(l.l_linenumber AS VARCHAR(10)), CAST(l.l_shipdate AS DATE)
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def v_proc_codes(spark, sf):
    first, second = procedure_registries(spark, sf)
    return first.unionByName(second)


def procedure_registries(spark, sf, lines=None) -> tuple[DataFrame, DataFrame]:
    """The two code registries behind ``v_proc_codes``."""
    operations = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pid"), F.concat(F.lit("K"), F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")).alias("code"),
        F.col("o_orderdate").cast("date").alias("date"))
    rows = _order_lines(spark, sf, "l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate", lines=lines)
    interventions = rows.select(
        F.col("o_custkey").alias("pid"),
        F.concat(F.lit("U"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber").cast("string")).alias("code"),
        F.col("l_shipdate").cast("date").alias("date"), *_also(rows))
    return operations, interventions


@_view("v_scores", """
SELECT c_custkey AS pid, 'ENGAGE' AS name, c_acctbal AS score FROM customer
UNION ALL
SELECT o_custkey, 'SEG' || SUBSTRING(o_orderpriority, 1, 1), -1 * AVG(o_totalprice) FROM orders GROUP BY o_custkey, SUBSTRING(o_orderpriority, 1, 1)""")
def v_scores(spark, sf):
    first = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.lit("ENGAGE").alias("name"), F.col("c_acctbal").alias("score"))
    second = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("pid"), F.concat(F.lit("SEG"), F.substring("o_orderpriority", 1, 1)).alias("name")
    ).agg((-F.avg("o_totalprice")).alias("score"))
    return first.unionByName(second)


@_view("v_predictions", """
SELECT c.c_custkey AS pid, m.model, t.time, EXP(-1 * t.time / 1825 * (CAST(0.05 AS DOUBLE) + (c.c_custkey * m.k % 97) / CAST(60 AS DOUBLE))) AS surv
FROM customer c CROSS JOIN (SELECT '001' AS model, 7 AS k UNION ALL SELECT '006', 13) m
CROSS JOIN (SELECT CAST(n_nationkey * 80 + 20 AS DOUBLE) AS time FROM nation) t""")
def v_predictions(spark, sf):
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in SCORED_MODELS.items()])
    rows = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("pid")), "pid").select("pid", F.inline(models))
    rows = rows.withColumn("time", F.explode(F.array(*[F.lit(t) for t in TIMES])))
    rate = F.lit(0.05) + (F.col("pid") * F.col("k") % 97) / F.lit(60.0)
    return unbroadcast(rows.select("pid", "model", "time", F.exp(-F.col("time") / 1825 * rate).alias("surv")))


@_view("v_continuous", """
SELECT c.c_custkey AS pid, m.model, t.time, EXP(-1 * t.time / 1825 * (CAST(0.05 AS DOUBLE) + (CAST(c.c_acctbal AS DOUBLE) + 1000 + m.k * sqrt(c.c_custkey)) / CAST(9000 AS DOUBLE))) AS surv
FROM customer c CROSS JOIN (SELECT '001' AS model, 7 AS k UNION ALL SELECT '006', 13) m
CROSS JOIN (SELECT CAST(n_nationkey * 80 + 20 AS DOUBLE) AS time FROM nation) t""")
def v_continuous(spark, sf):
    """Predictions with (nearly) as many values as patients."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in SCORED_MODELS.items()])
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_acctbal").cast("double").alias("b"))
    rows = spread(rows, "pid").select("pid", "b", F.inline(models))
    rows = rows.withColumn("time", F.explode(F.array(*[F.lit(t) for t in TIMES])))
    rate = F.lit(0.05) + (F.col("b") + 1000 + F.col("k") * F.sqrt("pid")) / F.lit(9000.0)
    return unbroadcast(rows.select("pid", "model", "time", F.exp(-F.col("time") / 1825 * rate).alias("surv")))


@_view("v_attributions", """
SELECT o.o_custkey AS pid, 'grp-' || CAST(l.l_linenumber % 3 + 1 AS VARCHAR(10)) || '_' || p.p_brand || CASE WHEN l.l_linenumber > 3 THEN '_' || l.l_returnflag ELSE '' END AS feature,
       SUM(l.l_discount - 0.05) AS shap, CAST(MAX(CASE WHEN l.l_tax > 0.04 THEN 1 ELSE 0 END) AS DOUBLE) AS vals,
       CAST(CASE l.l_linestatus WHEN 'F' THEN 365 ELSE 1825 END AS DOUBLE) AS timepoint
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
GROUP BY 1, 2, 5""")
def v_attributions(spark, sf, by_patient=False):
    """``by_patient`` deals the lines by patient, so that what aggregates by patient next does not deal its rows again."""
    rows = _order_lines(spark, sf, F.col("l_partkey").alias("p_partkey"), "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    named = rows.join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    named = named.drop("p_partkey", "o_orderkey").repartition("o_custkey") if by_patient else named
    feature = F.concat(
        F.lit("grp-"), (F.col("l_linenumber") % 3 + 1).cast("string"), F.lit("_"), F.col("p_brand"),
        F.when(F.col("l_linenumber") > 3, F.concat(F.lit("_"), F.col("l_returnflag"))).otherwise(""))
    return named.groupBy(
        F.col("o_custkey").alias("pid"), feature.alias("feature"),
        F.when(F.col("l_linestatus") == "F", 365.0).otherwise(1825.0).alias("timepoint"),
    ).agg(
        F.sum(F.col("l_discount") - 0.05).alias("shap"), F.max(F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0)).alias("vals"),
    ).select("pid", "feature", "shap", "vals", "timepoint")


@_view("v_trials", "SELECT o_orderkey AS number, o_orderpriority AS param_name, CAST(o_custkey AS DOUBLE) AS param_value, o_totalprice / 250000 AS value, o_orderstatus AS study_name FROM orders")
def v_trials(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("param_name"), F.col("o_custkey").cast("double").alias("param_value"),
        (F.col("o_totalprice") / 250000).alias("value"), F.col("o_orderstatus").alias("study_name"))


@_view("v_persons", """
SELECT c_custkey AS pid, CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'K' END AS sex,
       DATE '1925-01-01' + CAST(c_custkey * 37 % 22000 AS INTEGER) AS born,
       CASE WHEN c_custkey % 3 = 0 THEN '90' WHEN c_custkey % 7 = 0 THEN '70' ELSE '01' END AS status,
       CASE WHEN c_custkey % 3 = 0 THEN DATE '1999-06-01' + CAST(c_custkey % 1500 AS INTEGER) END AS status_date
FROM customer""")
def v_persons(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("pid"), F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("K").alias("sex"),
        F.date_add(F.lit("1925-01-01").cast("date"), (k * 37 % 22000).cast("int")).alias("born"),
        F.when(k % 3 == 0, "90").when(k % 7 == 0, "70").otherwise("01").alias("status"),
        F.when(k % 3 == 0, F.date_add(F.lit("1999-06-01").cast("date"), (k % 1500).cast("int"))).alias("status_date"))


@_view("v_baseline", """
SELECT pid, sex, age, CAST(CASE WHEN pid % 9 <> 0 THEN 40 + pid % 120 END AS INTEGER) AS pulse,
       CAST(CASE WHEN pid % 8 <> 0 THEN 80 + pid % 110 END AS INTEGER) AS sys_bp,
       CAST(CASE WHEN pid % 6 <> 0 THEN 40 + pid * 7 % 90 END AS INTEGER) AS dia_bp,
       CAST(CASE WHEN pid % 10 <> 0 THEN 40 + pid * 3 % 300 END AS DOUBLE) AS crea,
       CAST(CASE WHEN pid % 13 <> 0 THEN 145 + pid % 55 END AS DOUBLE) AS height,
       CAST(CASE WHEN pid % 14 <> 0 THEN 45 + pid % 85 END AS DOUBLE) AS weight,
       (pid % 17 = 0) AS arrest, CASE WHEN pid % 4 <> 3 THEN pid % 4 = 0 END AS enzymes, (pid % 5 = 0) AS stemi,
       CASE pid % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'ex' END AS smoking,
       CASE pid % 4 WHEN 0 THEN 'DIF' WHEN 1 THEN '1VD' WHEN 2 THEN '2VD' ELSE '3VD' END AS vessels,
       CASE pid % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'R' WHEN 2 THEN 'L' END AS dominance,
       CAST(CASE WHEN pid % 7 <> 0 THEN 1 + pid % 4 END AS INTEGER) AS nyha,
       CAST(CASE WHEN pid % 11 <> 0 THEN pid % 5 END AS INTEGER) AS ccs,
       CAST(CASE WHEN pid % 3 <> 0 THEN 1 + pid % 4 END AS INTEGER) AS killip
FROM v_patients WHERE status_date > index_date""")
def v_baseline(spark, sf):
    """Baseline measures derived from the patient key; patients without follow-up have no row."""
    return baseline_of(v_patients(spark, sf))


def baseline_of(patients: DataFrame) -> DataFrame:
    p = F.col("pid")
    when = lambda cond, value, kind: F.when(cond, value).cast(kind)
    return patients.where(F.col("status_date") > F.col("index_date")).select(
        "pid", "sex", "age", when(p % 9 != 0, p % 120 + 40, "int").alias("pulse"), when(p % 8 != 0, p % 110 + 80, "int").alias("sys_bp"),
        when(p % 6 != 0, p * 7 % 90 + 40, "int").alias("dia_bp"), when(p % 10 != 0, p * 3 % 300 + 40, "double").alias("crea"),
        when(p % 13 != 0, p % 55 + 145, "double").alias("height"), when(p % 14 != 0, p % 85 + 45, "double").alias("weight"),
        (p % 17 == 0).alias("arrest"), F.when(p % 4 != 3, p % 4 == 0).alias("enzymes"), (p % 5 == 0).alias("stemi"),
        F.when(p % 4 == 0, "yes").when(p % 4 == 1, "no").when(p % 4 == 2, "ex").alias("smoking"),
        F.when(p % 4 == 0, "DIF").when(p % 4 == 1, "1VD").when(p % 4 == 2, "2VD").otherwise("3VD").alias("vessels"),
        F.when(p % 5 == 0, "B").when(p % 5 == 1, "R").when(p % 5 == 2, "L").alias("dominance"),
        when(p % 7 != 0, p % 4 + 1, "int").alias("nyha"), when(p % 11 != 0, p % 5, "int").alias("ccs"),
        when(p % 3 != 0, p % 4 + 1, "int").alias("killip"))


@_view("v_index", """
SELECT pid, entryid, sex, age, index_date, status, status_date FROM (
  SELECT p.pid, o.o_orderkey AS entryid, CASE WHEN p.sex THEN 'M' ELSE 'F' END AS sex, p.age, p.index_date,
         CASE WHEN p.event THEN 'dead' ELSE 'alive' END AS status, p.status_date,
         ROW_NUMBER() OVER (PARTITION BY p.pid ORDER BY o.o_orderkey) AS rn
  FROM v_patients p JOIN orders o ON o.o_custkey = p.pid AND CAST(o.o_orderdate AS DATE) = p.index_date) WHERE rn = 1""")
def v_index(spark, sf, patients=None):
    """Patients with the entry of their index procedure."""
    p = v_patients(spark, sf) if patients is None else patients
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), F.col("o_orderkey"), F.col("o_orderdate").cast("date").alias("index_date"))
    entries = p.join(o, ["pid", "index_date"]).groupBy("pid").agg(F.min("o_orderkey").alias("entryid"))
    return p.join(entries, "pid").select(
        "pid", "entryid", F.when(F.col("sex"), "M").otherwise("F").alias("sex"), "age", "index_date",
        F.when(F.col("event"), "dead").otherwise("alive").alias("status"), "status_date")


@_view("v_pats", """
SELECT o_custkey AS pid, o_orderkey AS entryid, CAST(o_orderdate AS DATE) AS proc_date,
  CAST(CASE WHEN o_orderkey % 3 <> 0 THEN 120 + o_orderkey % 140 END AS DOUBLE) AS height_cm, CAST(CASE WHEN o_orderkey % 4 <> 0 THEN 40 + o_orderkey * 7 % 600 END AS DOUBLE) AS weight_kg,
  CAST(CASE WHEN o_orderkey % 5 <> 0 THEN 20 + o_orderkey % 320 END AS INTEGER) AS pulse, CAST(CASE WHEN o_orderkey % 6 <> 0 THEN 60 + o_orderkey % 270 END AS INTEGER) AS sys_bp,
  CAST(CASE WHEN o_orderkey % 7 <> 0 THEN 40 + o_orderkey * 3 % 290 END AS INTEGER) AS dia_bp, CAST(CASE WHEN o_orderkey % 8 <> 0 THEN 30 + o_orderkey % 450 END AS DOUBLE) AS creatinine,
  CASE o_orderkey % 3 WHEN 0 THEN 'Positiv' WHEN 1 THEN 'Negativ' END AS enzymes, CASE o_orderkey % 4 WHEN 0 THEN 'Ja' WHEN 1 THEN 'Nej' END AS arrest,
  CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 5 = 0 END AS stemi, CASE o_orderkey % 4 WHEN 0 THEN 'Aktiv ryger' WHEN 1 THEN 'Aldrig' WHEN 2 THEN 'Eks-ryger' END AS smoking_status,
  CASE o_orderkey % 5 WHEN 0 THEN 'Diffus' WHEN 4 THEN NULL ELSE CAST(o_orderkey % 5 AS VARCHAR(4)) || ' gebet' END AS native_kar,
  CASE o_orderkey % 4 WHEN 0 THEN 'Balanceret' WHEN 1 THEN 'Højre' WHEN 2 THEN 'Venstre' END AS dominance,
  CASE o_orderkey % 6 WHEN 0 THEN 'NYHA I' WHEN 1 THEN 'NYHA II' WHEN 2 THEN 'NYHA III' WHEN 3 THEN 'NYHA IV' WHEN 4 THEN 'ukendt' END AS nyha_class,
  CASE o_orderkey % 5 WHEN 0 THEN 'Ingen' WHEN 1 THEN 'CCS I' WHEN 2 THEN 'CCS II' WHEN 3 THEN 'CCS IV' END AS ccs_class,
  CASE o_orderkey % 4 WHEN 0 THEN 'II' WHEN 1 THEN 'I' WHEN 2 THEN 'IV' END AS killip_class,
  CASE o_orderkey % 3 WHEN 0 THEN 'Ja' WHEN 1 THEN 'Nej' END AS familiary_ihd, CASE o_orderkey % 7 WHEN 0 THEN 'ICD' WHEN 1 THEN 'PM' WHEN 2 THEN 'Ingen' END AS arrhythmia_device,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 75 AS VARCHAR(4)) ELSE 'ukendt' END AS lvef,
  CASE o_orderkey % 6 WHEN 0 THEN 'Positiv' WHEN 1 THEN 'Negativ' WHEN 2 THEN 'Ikke konklusiv' WHEN 3 THEN 'Ikke udført' WHEN 4 THEN 'Andet' END AS ischemia_test,
  CASE o_orderkey % 3 WHEN 0 THEN 'Ja' WHEN 1 THEN 'Nej' END AS abnormal_ekg, CASE o_orderkey % 4 WHEN 0 THEN 'Ja' WHEN 1 THEN 'Nej' END AS abnormal_qrs
FROM orders""")
def v_pats(spark, sf, orders=None):
    """Full procedure records with text categories, of all orders or of the given ones."""
    k = F.col("o_orderkey")
    def pick(n, *values):
        out = F
        for i, v in enumerate(values):
            if v is not None:
                out = out.when(k % n == i, F.lit(v))
        return out
    return (table(spark, sf, "orders") if orders is None else orders).select(
        F.col("o_custkey").alias("pid"), k.alias("entryid"), F.col("o_orderdate").cast("date").alias("proc_date"),
        F.when(k % 3 != 0, k % 140 + 120).cast("double").alias("height_cm"), F.when(k % 4 != 0, k * 7 % 600 + 40).cast("double").alias("weight_kg"),
        F.when(k % 5 != 0, k % 320 + 20).cast("int").alias("pulse"), F.when(k % 6 != 0, k % 270 + 60).cast("int").alias("sys_bp"),
        F.when(k % 7 != 0, k * 3 % 290 + 40).cast("int").alias("dia_bp"), F.when(k % 8 != 0, k % 450 + 30).cast("double").alias("creatinine"),
        pick(3, "Positiv", "Negativ").alias("enzymes"), pick(4, "Ja", "Nej").alias("arrest"), F.when(k % 5 < 4, k % 5 == 0).alias("stemi"),
        pick(4, "Aktiv ryger", "Aldrig", "Eks-ryger").alias("smoking_status"),
        F.when(k % 5 == 0, "Diffus").when(k % 5 < 4, F.concat((k % 5).cast("string"), F.lit(" gebet"))).alias("native_kar"),
        pick(4, "Balanceret", "Højre", "Venstre").alias("dominance"), pick(6, "NYHA I", "NYHA II", "NYHA III", "NYHA IV", "ukendt").alias("nyha_class"),
        pick(5, "Ingen", "CCS I", "CCS II", "CCS IV").alias("ccs_class"), pick(4, "II", "I", "IV").alias("killip_class"),
        pick(3, "Ja", "Nej").alias("familiary_ihd"), pick(7, "ICD", "PM", "Ingen").alias("arrhythmia_device"),
        F.when(k % 6 != 0, (k % 75).cast("string")).otherwise("ukendt").alias("lvef"),
        pick(6, "Positiv", "Negativ", "Ikke konklusiv", "Ikke udført", "Andet").alias("ischemia_test"),
        pick(3, "Ja", "Nej").alias("abnormal_ekg"), pick(4, "Ja", "Nej").alias("abnormal_qrs"))


@_view("v_labs", """
SELECT p.pid, t.test_id, CASE t.test_id % 4 WHEN 0 THEN 'TROPONIN I, CARDIAC MUSCLE' WHEN 1 THEN 'CREATINE KINASE MB' ELSE 'CREATININIUM' END AS component_db,
  CASE WHEN t.test_id % 5 = 0 THEN 'mmol/L' ELSE 'umol/L' END AS unit_clean, datediff('day', p.index_date, t.drawn_date) AS t_since,
  CAST(t.result AS VARCHAR) AS shown_value, CASE WHEN t.test_id % 7 = 0 THEN '<20' ELSE CAST(CAST(t.result AS BIGINT) * 3 AS VARCHAR) END AS shown_clean,
  CASE WHEN t.test_id % 3 = 0 THEN NULL ELSE t.result > 40 END AS flag
FROM v_tests t JOIN v_patients p ON p.pid = t.pid""")
def v_labs(spark, sf, lines=None):
    i = F.col("test_id")
    tests = v_tests(spark, sf, lines)
    if lines is None:
        tests = tests.join(v_patients(spark, sf).select("pid", "index_date"), "pid")
    return tests.select(
        "pid", "test_id", F.when(i % 4 == 0, "TROPONIN I, CARDIAC MUSCLE").when(i % 4 == 1, "CREATINE KINASE MB").otherwise("CREATININIUM").alias("component_db"),
        F.when(i % 5 == 0, "mmol/L").otherwise("umol/L").alias("unit_clean"), F.datediff("drawn_date", "index_date").cast("bigint").alias("t_since"),
        F.col("result").cast("string").alias("shown_value"),
        F.when(i % 7 == 0, "<20").otherwise((F.col("result").cast("bigint") * 3).cast("string")).alias("shown_clean"),
        F.when(i % 3 != 0, F.col("result") > 40).alias("flag"))
