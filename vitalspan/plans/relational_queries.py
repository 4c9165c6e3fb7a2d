"""Scans, sinks, scalar functions, joins, aggregations, windows and sampling over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalspan.functions import scalars as S
from vitalspan.functions.aggregates import all3, any3, ordered_text
from vitalspan.operators import joins as J
from vitalspan.operators import reshape as H
from vitalspan.operators.ordered import random_rank, running
from vitalspan.plans.cohort_queries import DIAG_SQL, LAB_SQL, diagnosis_events, lab_events
from vitalspan.plans.registry import longs, q6, query, r6, rounded
from vitalspan.plans.views import (
    table, v_attributions, v_baseline, v_patients, v_persons, v_predictions, v_procedures_raw, v_scores, v_surv, v_tests, v_trials, SCORED_MODELS, TIMES,
)
from vitalspan.session import run_folder
from vitalspan.sources import readers, writers


def _fresh(spark, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------------------------------


@query("typed_text_scan", "A1 A9 B16", f"""
SELECT o_orderkey AS entryid, o_custkey AS pid, CAST(o_orderdate AS DATE) AS proc_date, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status, {q6("o_totalprice", "price")} FROM orders""")
def typed_text_scan(spark, sf):
    """Written as compressed tab-separated text with spreadsheet dates, read back with declared types."""
    path = _fresh(spark, "text")
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entryid"), F.col("o_custkey").alias("pid"), serial.alias("serial"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("price"), F.lit("x").alias("unused"))
    writers.write_delimited(rows, path, compression="gzip")
    back = readers.read_typed(
        spark, path, "entryid BIGINT, pid BIGINT, serial STRING, status STRING, price DOUBLE, unused STRING",
        columns=["entryid", "pid", "serial", "status", "price"])
    return rounded(back.select("entryid", "pid", S.excel_serial_to_date("serial").alias("proc_date"), "status", "price"), "price")


@query("raw_text_scan", "A2 B15 B14", """
SELECT o_orderkey AS entryid, TRY_CAST(CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE CAST(o_orderkey % 350 AS VARCHAR) END AS INTEGER) AS pulse,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS INTEGER) AS killip FROM orders""")
def raw_text_scan(spark, sf):
    path = _fresh(spark, "raw")
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.alias("entryid"), F.when(k % 5 == 0, "x").when(k % 5 != 1, (k % 350).cast("string")).alias("pulse"),
        F.when(k % 4 == 0, "Killip I").when(k % 4 == 1, "II (let)").when(k % 4 == 2, "IV").alias("killip"))
    writers.write_delimited(rows, path, null_token="")
    back = readers.read_raw(spark, path, ["entryid", "pulse", "killip"])
    return back.select(F.col("entryid").try_cast("bigint").alias("entryid"), F.col("pulse").try_cast("int").alias("pulse"), S.roman_to_int("killip").alias("killip"))


@query("inferred_text_scan", "A3", "SELECT name, COUNT(*) AS n, round(SUM(score), 2) AS total FROM v_scores GROUP BY name")
def inferred_text_scan(spark, sf):
    path = _fresh(spark, "inferred")
    writers.write_delimited(v_scores(spark, sf), path)
    back = readers.read_inferred(spark, path).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))
    return back


@query("many_files_scan", "A4 H10 B6", f"SELECT name, COUNT(*) AS n, {q6('AVG(score)', 'mean')} FROM v_scores GROUP BY name")
def many_files_scan(spark, sf):
    """One folder per score, read back in one scan with the score's name taken from the path."""
    path = _fresh(spark, "scores")
    v_scores(spark, sf).select("pid", "score", F.col("name").alias("file")).write.partitionBy("file").csv(path, sep="\t", header=True)
    back = readers.read_many(spark, f"{path}/*", "pid BIGINT, score DOUBLE", r"file=([^/]+)/")
    return rounded(back.groupBy("name").agg(F.count("*").alias("n"), F.avg("score").alias("mean")), "mean")


@query("append_and_read_table", "A5 A6 A7 A8", "SELECT train, COUNT(*) AS n, CAST(SUM(time) AS BIGINT) AS days FROM v_surv GROUP BY train")
def append_and_read_table(spark, sf):
    path, surv = _fresh(spark, "surv"), v_surv(spark, sf)
    writers.create_table(surv.where("train"), path, ["pid"])
    writers.append_table(surv.where("NOT train"), path, [{"rule": "primary_key", "columns": ["pid"]}, {"rule": "not_null", "column": "time"}])
    back = readers.read_table(spark, path, ["train", "time"])
    return longs(back.groupBy("train").agg(F.count("*").alias("n"), F.sum("time").alias("days")), "days")


_WIDE_TIMES = TIMES


@query("wide_predictions", "A10 D20", "SELECT pid, model, " + ", ".join(q6(f"MAX(CASE WHEN time = {t} THEN surv END)", f"t{t:g}") for t in _WIDE_TIMES) + " FROM v_predictions GROUP BY pid, model")
def wide_predictions(spark, sf):
    wide = writers.wide_predictions(v_predictions(spark, sf), _WIDE_TIMES, keys=("pid", "model"))
    return rounded(wide.withColumnsRenamed({f"{t:g}": f"t{t:g}" for t in _WIDE_TIMES}), *[f"t{t:g}" for t in _WIDE_TIMES])


@query("long_predictions", "A10 D19 A9", f"SELECT pid, model, time, {q6('surv', 'surv')} FROM v_predictions")
def long_predictions(spark, sf):
    """Wide text export read back as long rows."""
    path = _fresh(spark, "wide")
    writers.write_delimited(writers.wide_predictions(v_predictions(spark, sf), TIMES, keys=("pid", "model")), path, sep=",")
    columns = ", ".join(f"`{t:g}` DOUBLE" for t in TIMES)
    back = readers.read_typed(spark, path, f"pid BIGINT, model STRING, {columns}", sep=",")
    return rounded(writers.long_predictions(back, ("pid", "model")), "surv")


@query("feature_list_scan", "A14 B7 D25", """
SELECT DISTINCT split_part(feature, '_', 1) AS fgroup, split_part(feature, '_', 2) AS fname, NULLIF(split_part(feature, '_', 3), '') AS fvalue FROM v_attributions""")
def feature_list_scan(spark, sf):
    path = _fresh(spark, "features")
    v_attributions(spark, sf).select("feature").distinct().write.text(path)
    return readers.read_feature_list(spark, path)


@query("lookup_join", "A12 C15 C2", "SELECT n.n_nationkey AS nation, r.r_name AS region, COUNT(c.c_custkey) AS n FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2")
def lookup_join(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return nations.join(counts, "n_nationkey", "left").select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region"), F.coalesce("n", F.lit(0)).alias("n"))


# --- scalar functions --------------------------------------------------------------------------------------------


@query("three_valued_branches", "B11 B12 B25 B28 M1", """
SELECT entryid, CASE WHEN sys_bp > 200 THEN 'high' WHEN NOT sys_bp > 200 THEN 'low' END AS level, COALESCE(sys_bp > 200 OR dia_bp > 200, FALSE) AS any_high,
  COALESCE(dia_bp, sys_bp, -1) AS filled, CASE WHEN dia_bp > sys_bp THEN sys_bp ELSE dia_bp END AS kept_dia, native_kar IN ('1 gebet', '2 gebet') AS listed FROM v_procedures_raw""")
def three_valued_branches(spark, sf):
    high = lambda c: F.col(c) > 200
    _, kept = S.swap_if(F.col("dia_bp") > F.col("sys_bp"), "sys_bp", "dia_bp", null_keeps=True)
    return v_procedures_raw(spark, sf).select(
        "entryid", S.if_else3(high("sys_bp"), F.lit("high"), F.lit("low")).alias("level"), S.any_true(high("sys_bp"), high("dia_bp")).alias("any_high"),
        F.coalesce("dia_bp", "sys_bp", F.lit(-1.0)).alias("filled"), kept.alias("kept_dia"), F.col("native_kar").isin("1 gebet", "2 gebet").alias("listed"))


@query("code_texts", "B5 B6 B8 B9 B10", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, 'D' || chr(CAST(65 + l_partkey % 26 AS INTEGER)) || CAST(l_partkey AS VARCHAR) AS code FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN length(code) = 4 THEN code || '9' ELSE substr(code, 1, 5) END AS leaf, regexp_matches(code, '^(?:D[A-C]|DX1)') AS chosen,
  NULLIF(regexp_extract(code, '[0-9]{3}', 0), '') AS digits, CASE substr(code, 2, 1) WHEN 'A' THEN 'first' WHEN 'Z' THEN 'last' ELSE substr(code, 2, 1) END AS letter, upper(lower(code)) || '-' || CAST(l_linenumber AS VARCHAR) AS label FROM c""")
def code_texts(spark, sf):
    code = F.concat(F.lit("D"), F.char(F.col("l_partkey") % 26 + 65), F.col("l_partkey").cast("string"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", code.alias("code"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", S.normalise_code("code").alias("leaf"), S.matches_prefix("code", "D[A-C]", "DX1").alias("chosen"),
        S.extract("code", "[0-9]{3}").alias("digits"), S.recode(F.substring("code", 2, 1), {"A": "first", "Z": "last"}).alias("letter"),
        F.concat(F.upper(F.lower("code")), F.lit("-"), F.col("l_linenumber").cast("string")).alias("label"))


@query("feature_parts", "B7 B6", "SELECT DISTINCT feature, split_part(feature, '_', 1) AS fgroup, split_part(feature, '_', 2) AS fname, NULLIF(split_part(feature, '_', 3), '') AS fvalue FROM v_attributions")
def feature_parts(spark, sf):
    parts = S.split_feature("feature")
    return v_attributions(spark, sf).select("feature").distinct().select("feature", *[c.alias(n) for n, c in parts.items()])


@query("dates_and_ages", "B16 B17 B18 B19 B20 B21", f"""
WITH p AS (SELECT v.pid, v.born, o.index_date, o.age FROM v_persons v JOIN v_patients o ON o.pid = v.pid),
f AS (SELECT *, CAST(year(index_date) - year(born) - CASE WHEN born + to_years(CAST(year(index_date) - year(born) AS INTEGER)) > index_date THEN 1 ELSE 0 END AS INTEGER) AS y FROM p)
SELECT pid, {q6("ROUND(y + datediff('day', born + to_years(y), index_date) / CAST(datediff('day', born + to_years(y), born + to_years(y + 1)) AS DOUBLE), 2)", "age_years")},
  CAST(round(age * 365.25) + datediff('day', index_date, DATE '1999-01-01') AS BIGINT) AS age_days, COALESCE(index_date BETWEEN born AND CASE WHEN pid % 2 = 0 THEN DATE '1998-01-01' END, TRUE) AS open_range FROM f""")
def dates_and_ages(spark, sf):
    rows = v_persons(spark, sf).select("pid", "born").join(v_patients(spark, sf).select("pid", "index_date", "age"), "pid")
    limit = F.when(F.col("pid") % 2 == 0, F.lit("1998-01-01").cast("date"))
    return rows.select(
        "pid", r6(S.age_years("born", "index_date")).alias("age_years"),
        S.age_days_at("age", "index_date", F.lit("1999-01-01").cast("date")).cast("bigint").alias("age_days"),
        S.between_or_unknown("index_date", F.col("born"), limit).alias("open_range"))


@query("elapsed_fractions", "B17 B18", f"SELECT event_id, {q6('(epoch_us(ts) - epoch_us(index_ts)) / 86400000000.0', 'days')}, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute FROM v_vitals")
def elapsed_fractions(spark, sf):
    from vitalspan.plans.views import v_vitals
    text = F.date_format("ts", "yyyy-MM-dd HH:mm")
    return v_vitals(spark, sf).select(
        "event_id", r6(S.elapsed_days("index_ts", "ts")).alias("days"), F.date_format(S.parse_ymd_hm(text), "yyyy-MM-dd HH:mm").alias("minute"))


@query("numeric_scaling", "B13 B22 B26", f"""
SELECT entryid, {q6("CASE WHEN weight BETWEEN 50 AND 250 THEN weight END", "weight")}, {q6("round_even(height, 0)", "height_even")}, {q6("ln(1 + weight)", "log_weight")},
  {q6("(weight - 20) / 271", "unit")}, {q6("weight", "back")}, {q6("LEAST(weight, 200)", "capped")}, {q6("CASE WHEN weight > 300 THEN weight / 10 ELSE weight END", "fixed")}, format('{{:+.1f}}', dia_bp - sys_bp) AS gap FROM v_procedures_raw""")
def numeric_scaling(spark, sf):
    return v_procedures_raw(spark, sf).select(
        "entryid", r6(S.clean_range("weight", 50, 250)).alias("weight"), r6(F.bround("height", 0)).alias("height_even"), r6(F.log1p("weight")).alias("log_weight"),
        r6(S.min_max("weight", 20, 291)).alias("unit"), r6(S.from_min_max(S.min_max("weight", 20, 291), 20, 291)).alias("back"), r6(S.cap("weight", 200)).alias("capped"), r6(S.rescale_above("weight", 300, 10)).alias("fixed"),
        F.when(F.col("dia_bp").isNotNull() & F.col("sys_bp").isNotNull(), S.signed_fixed(F.col("dia_bp") - F.col("sys_bp"))).alias("gap"))


@query("binned_values", "B23 D5", """
SELECT CASE WHEN weight > 0 AND weight <= 50 THEN '(0,50]' WHEN weight > 50 AND weight <= 150 THEN '(50,150]' WHEN weight > 150 AND weight <= 300 THEN '(150,300]' END AS bin,
  CASE WHEN height >= 0 AND height <= 50 THEN '[0,50]' WHEN height > 50 AND height <= 100 THEN '(50,100]' WHEN height > 100 AND height <= 150 THEN '(100,150]' END AS equal, COUNT(*) AS n FROM v_procedures_raw GROUP BY 1, 2""")
def binned_values(spark, sf):
    return v_procedures_raw(spark, sf).groupBy(
        S.cut_breaks("weight", [0, 50, 150, 300]).alias("bin"), S.equal_width_bins("height", 50, 0, 150).alias("equal")).agg(F.count("*").alias("n"))


@query("administrative_censoring", "B24", "SELECT pid, LEAST(time, 400 + pid % 300) AS time, CASE WHEN time > 400 + pid % 300 THEN FALSE ELSE event END AS event FROM v_surv")
def administrative_censoring(spark, sf):
    time, event = S.censor_at("time", "event", F.col("pid") % 300 + 400)
    return v_surv(spark, sf).select("pid", time.alias("time"), event.alias("event"))


@query("columns_by_kind", "B1 B2 B4 B12 B27", """
SELECT entryid, pid, COALESCE(prev_ami, 'Nej') AS prev_ami, COALESCE(prev_pci, 'Nej') AS prev_pci, COALESCE(sys_bp, 0) AS "sys-bp", COALESCE(dia_bp, 0) AS "dia-bp" FROM v_procedures_raw
WHERE COALESCE(prev_ami, 'Nej') = 'Nej' AND COALESCE(prev_pci, 'Nej') = 'Nej'""")
def columns_by_kind(spark, sf):
    rows = v_procedures_raw(spark, sf).select("entryid", "pid", "prev_ami", "prev_pci", "sys_bp", "dia_bp")
    prev = [c for c in rows.columns if c.startswith("prev")]
    filled = rows.fillna("Nej", subset=prev).fillna(0.0, subset=[c for c, t in rows.dtypes if t == "double"])
    return filled.where(S.all_equal(prev, "Nej")).withColumnsRenamed({c: c.replace("_", "-") for c in rows.columns if c.endswith("_bp")})


# --- joins -------------------------------------------------------------------------------------------------------


@query("supplemented_join", "C2 B12", f"""
SELECT p.pid, p.entryid, {q6("COALESCE(p.sys_bp, b.sys_bp)", "sys_bp")}, {q6("COALESCE(p.dia_bp, b.dia_bp)", "dia_bp")}, b.crea FROM v_procedures_raw p LEFT JOIN v_baseline b ON b.pid = p.pid""")
def supplemented_join(spark, sf):
    left = v_procedures_raw(spark, sf).select("pid", "entryid", "sys_bp", "dia_bp")
    return rounded(J.join_coalesced(left, v_baseline(spark, sf).select("pid", "sys_bp", "dia_bp", "crea"), ["pid"]), "sys_bp", "dia_bp")


@query("outer_joins", "C3 C4 C12", """
WITH a AS (SELECT pid, COUNT(*) AS n_tests FROM v_tests WHERE result > 45 GROUP BY pid), b AS (SELECT pid, COUNT(*) AS n_proc FROM v_procedures_raw WHERE sys_bp > 300 GROUP BY pid)
SELECT pid, n_tests, n_proc, s.train FROM a FULL JOIN b USING (pid) RIGHT JOIN v_surv s USING (pid)""")
def outer_joins(spark, sf):
    a = v_tests(spark, sf).where("result > 45").groupBy("pid").agg(F.count("*").alias("n_tests"))
    b = v_procedures_raw(spark, sf).where("sys_bp > 300").groupBy("pid").agg(F.count("*").alias("n_proc"))
    return J.natural_join(J.natural_join(a, b, "full"), v_surv(spark, sf).select("pid", "train"), "right")


@query("key_set_operations", "C5 C6 C18 G3 G4 B28", """
WITH t AS (SELECT DISTINCT pid FROM v_tests WHERE result > 48), s AS (SELECT DISTINCT pid FROM v_scores WHERE name = 'SEG1')
SELECT (SELECT COUNT(*) FROM v_surv WHERE pid IN (SELECT pid FROM t)) AS semi, (SELECT COUNT(*) FROM v_surv WHERE pid NOT IN (SELECT pid FROM t)) AS anti,
  (SELECT COUNT(*) FROM (SELECT pid FROM t INTERSECT SELECT pid FROM s)) AS both_sets, (SELECT COUNT(*) FROM (SELECT pid FROM t EXCEPT SELECT pid FROM s)) AS only_tests,
  (SELECT COUNT(*) FROM v_surv WHERE pid IN (SELECT pid FROM s)) AS flagged""")
def key_set_operations(spark, sf):
    surv = v_surv(spark, sf)
    tested = v_tests(spark, sf).where("result > 48").select("pid").distinct()
    scored = v_scores(spark, sf).where("name = 'SEG1'").select("pid").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [
        count(J.restrict_to(surv, tested, ["pid"]), "semi"), count(J.exclude(surv, tested, ["pid"]), "anti"), count(tested.intersect(scored), "both_sets"),
        count(tested.exceptAll(scored), "only_tests"), count(J.membership_flag(surv, scored, ["pid"], "has").where("has"), "flagged")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = ["semi", "anti", "both_sets", "only_tests", "flagged"]
    return rows.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])


@query("group_filter", "D4 D3", """
SELECT pid, entryid FROM v_procedures_raw WHERE pid IN (SELECT pid FROM v_procedures_raw GROUP BY pid HAVING bool_and(proc_date > DATE '1995-02-01') AND COUNT(*) > 5)""")
def group_filter(spark, sf):
    condition = all3(F.col("proc_date") > F.lit("1995-02-01").cast("date")) & (F.count("*") > 5)
    return J.keep_groups(v_procedures_raw(spark, sf), ["pid"], condition).select("pid", "entryid")


@query("interval_join_modes", "C7", f"""
WITH t AS (SELECT t.test_id, t.qid, t.drawn_date, p.sex FROM v_tests t JOIN v_patients p ON p.pid = t.pid), j AS (SELECT t.*, r.npu_code, COALESCE(t.drawn_date BETWEEN r.valid_from AND r.valid_to, TRUE) AS ok FROM t LEFT JOIN v_refint r ON r.npu_code = t.qid AND r.sex = t.sex)
SELECT 'drop' AS mode, COUNT(*) AS n FROM j WHERE npu_code IS NOT NULL AND ok UNION ALL SELECT 'no_key_only', COUNT(*) FROM j WHERE ok UNION ALL SELECT 'keep', COUNT(DISTINCT test_id || '-' || qid || '-' || CAST(drawn_date AS VARCHAR)) FROM j""")
def interval_join_modes(spark, sf):
    from vitalspan.plans.views import v_refint
    tests = v_tests(spark, sf).join(v_patients(spark, sf).select("pid", "sex"), "pid").select("test_id", "qid", "drawn_date", "sex")
    lookup = v_refint(spark, sf).withColumnRenamed("npu_code", "qid")
    ranges = [("drawn_date", "valid_from", "valid_to")]
    def count(mode):
        joined = J.interval_join(tests, lookup, ["qid", "sex"], ranges, mode)
        rows = joined.select("test_id", "qid", "drawn_date").distinct() if mode == "keep" else joined
        return rows.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
    return count("drop").unionByName(count("no_key_only")).unionByName(count("keep"))


@query("nearest_and_bracket_lookup", "C10 C11", f"""
WITH lk AS (SELECT p_brand AS grp, CAST(p_size AS DOUBLE) AS at, AVG(p_retailprice) AS price FROM part GROUP BY 1, 2), x AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS grp, l_quantity + 0.25 AS q FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT CAST(n_nationkey * 2 AS DOUBLE) AS lo, CAST(n_nationkey * 2 + 2 AS DOUBLE) AS hi, n_name FROM nation),
n AS (SELECT l_orderkey, l_linenumber, l_partkey, q, price FROM (SELECT x.*, lk.price, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, q ORDER BY abs(lk.at - x.q), lk.at) AS rn FROM x JOIN lk ON lk.grp = x.grp) WHERE rn = 1)
SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, {q6("q", "q")}, {q6("price", "price")}, b.n_name AS bracket FROM n LEFT JOIN b ON q > b.lo AND q <= b.hi""")
def nearest_and_bracket_lookup(spark, sf):
    part = table(spark, sf, "part")
    lookup = part.groupBy(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("at")).agg(F.avg("p_retailprice").alias("price"))
    rows = table(spark, sf, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("grp")), "l_partkey")
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "grp", (F.col("l_quantity") + 0.25).alias("q"))
    near = J.nearest_lookup_join(rows, "q", lookup, ["grp"], "at", "price")
    brackets = table(spark, sf, "nation").select(
        (F.col("n_nationkey") * 2).cast("double").alias("from"), (F.col("n_nationkey") * 2 + 2).cast("double").alias("to"), F.col("n_name").alias("bracket"))
    return rounded(J.bracket_join(near, "q", brackets, "bracket").drop("grp").distinct(), "q", "price")


@query("aligned_predictions", "C17 C13", f"""
WITH k AS (SELECT pid, model, time FROM (SELECT pid FROM v_surv), (SELECT DISTINCT model FROM v_predictions), (SELECT DISTINCT time FROM v_predictions UNION ALL SELECT CAST(30 AS DOUBLE)))
SELECT k.pid, k.model, k.time, {q6("COALESCE(p.surv, 0)", "surv")} FROM k LEFT JOIN v_predictions p ON p.pid = k.pid AND p.model = k.model AND p.time = k.time""")
def aligned_predictions(spark, sf):
    """All predictions for the patients at hand, and a time that has none."""
    wanted = J.with_values(J.with_values(v_surv(spark, sf).select("pid"), "model", list(SCORED_MODELS)), "time", [*TIMES, 30.0])
    return rounded(J.align_to(v_predictions(spark, sf), wanted, ["pid", "model", "time"], {"surv": 0.0}), "surv")


@query("repeated_for_horizons", "C14", "SELECT h AS tau, COUNT(*) AS n, COUNT(*) FILTER (WHERE time > h) AS alive FROM v_surv, (SELECT 183 AS h UNION ALL SELECT 365 UNION ALL SELECT 1095) GROUP BY h")
def repeated_for_horizons(spark, sf):
    rows = J.with_values(v_surv(spark, sf), "tau", [183, 365, 1095])
    return rows.groupBy("tau").agg(F.count("*").alias("n"), F.count_if(F.col("time") > F.col("tau")).alias("alive"))


# --- aggregations and reshaping ------------------------------------------------------------------------------------


@query("any_all_unknown", "D3", """
SELECT pid, CASE WHEN bool_or(sys_bp > 300) THEN TRUE WHEN bool_or(sys_bp IS NULL) THEN NULL ELSE FALSE END AS any_high, CASE WHEN NOT bool_and(sys_bp > 20) THEN FALSE WHEN bool_or(sys_bp IS NULL) THEN NULL ELSE TRUE END AS all_plausible FROM v_procedures_raw GROUP BY pid""")
def any_all_unknown(spark, sf):
    return v_procedures_raw(spark, sf).groupBy("pid").agg(any3(F.col("sys_bp") > 300).alias("any_high"), all3(F.col("sys_bp") > 20).alias("all_plausible"))


@query("ordered_lists", "D1", """
SELECT pid, CASE WHEN COUNT(prev_pci) = COUNT(*) THEN string_agg(prev_pci, ',' ORDER BY proc_date, entryid) END AS strict, string_agg(prev_pci, ';' ORDER BY proc_date, entryid) AS loose FROM v_procedures_raw GROUP BY pid""")
def ordered_lists(spark, sf):
    order = F.struct("proc_date", "entryid")
    return v_procedures_raw(spark, sf).groupBy("pid").agg(
        ordered_text("prev_pci", order).alias("strict"), ordered_text("prev_pci", order, ";", null_poisons=False).alias("loose"))


@query("distinct_counts", "D2 D5", "SELECT native_kar, COUNT(*) AS n, COUNT(DISTINCT pid) AS patients, COUNT(DISTINCT proc_date) AS days FROM v_procedures_raw GROUP BY native_kar")
def distinct_counts(spark, sf):
    return v_procedures_raw(spark, sf).groupBy("native_kar").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("patients"), F.count_distinct("proc_date").alias("days"))


_PROFILED = ["age", "height", "weight", "pulse", "crea", "sys_bp", "dia_bp"]


@query("numeric_profile", "D9 D10 B27 C12", " UNION ALL ".join(
    f"SELECT train, '{c}' AS name, {q6(f'AVG({c})', 'mean')}, {q6(f'stddev_samp({c})', 'sd')}, {q6(f'MIN({c})', 'min')}, {q6(f'MAX({c})', 'max')}, {q6(f'AVG(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END)', 'missing')} "
    "FROM v_baseline b JOIN v_surv s ON s.pid = b.pid GROUP BY train" for c in _PROFILED))
def numeric_profile(spark, sf):
    rows = J.natural_join(v_baseline(spark, sf), v_surv(spark, sf).select("pid", "train"))
    return rounded(H.numeric_profile(rows, ["train"], _PROFILED), "mean", "sd", "min", "max", "missing")


_CATEGORIES = ["smoking", "vessels", "dominance", "nyha", "killip"]


@query("categorical_profile", "D11 D13 B12 D15 D19", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT train, '{c}' AS name, COALESCE(CAST({c} AS VARCHAR), 'missing') AS value FROM v_baseline b JOIN v_surv s ON s.pid = b.pid" for c in _CATEGORIES) + f"""),
g AS (SELECT train, name, value, GREATEST(COUNT(*), 5) AS n FROM l GROUP BY 1, 2, 3) SELECT train, name, value, n, {q6("n * 100 / SUM(n) OVER (PARTITION BY train, name)", "p")} FROM g""")
def categorical_profile(spark, sf):
    rows = v_baseline(spark, sf).join(v_surv(spark, sf).select("pid", "train"), "pid")
    return rounded(H.categorical_profile(rows, ["train"], _CATEGORIES, mask=5), "p")


@query("prevalence_masked", "D12 D13 D15 D21", f"""
WITH {DIAG_SQL}, seen AS (SELECT code, s.train, COUNT(DISTINCT d.pid) AS k FROM diag d JOIN v_surv s ON s.pid = d.pid WHERE level = 'lvl3' AND d.time >= -1000 GROUP BY 1, 2),
grid AS (SELECT c.code, s.train, s.size, COALESCE(k, 0) AS k FROM (SELECT DISTINCT code FROM seen) c CROSS JOIN (SELECT train, COUNT(*) AS size FROM v_surv GROUP BY train) s LEFT JOIN seen ON seen.code = c.code AND seen.train = s.train),
cells AS (SELECT train, code, TRUE AS seen, k AS n FROM grid UNION ALL SELECT train, code, FALSE, size - k FROM grid), m AS (SELECT train, code, seen, GREATEST(n, 5) AS n FROM cells WHERE n > 0)
SELECT train, code, seen, n, {q6("n * 100 / SUM(n) OVER (PARTITION BY code, train)", "p")} FROM m""")
def prevalence_masked(spark, sf):
    events = diagnosis_events(spark, sf).where((F.col("level") == "lvl3") & (F.col("time") >= -1000))
    return rounded(H.event_prevalence(events, v_surv(spark, sf), "train"), "p")


@query("lab_profile", "D11 D13 E1 D20 C3", f"""
WITH {LAB_SQL}, r AS (SELECT s.train, q.qid AS name, COALESCE(CASE l.value WHEN -1 THEN 'low' WHEN 0 THEN 'normal' WHEN 1 THEN 'high' END, 'missing') AS value
  FROM v_surv s CROSS JOIN (SELECT DISTINCT qid FROM labs) q LEFT JOIN labs l ON l.pid = s.pid AND l.qid = q.qid AND l.time BETWEEN 0 AND 3650),
g AS (SELECT train, name, value, GREATEST(COUNT(*), 5) AS n FROM r GROUP BY 1, 2, 3) SELECT train, name, value, n, {q6("n * 100 / SUM(n) OVER (PARTITION BY train, name)", "p")} FROM g""")
def lab_profile(spark, sf):
    qids = [f"NPU{i}" for i in range(1, 8)]
    labs = lab_events(spark, sf).where(F.col("time").between(0, 3650)).withColumn("label", F.when(F.col("value") == -1, "low").when(F.col("value") == 0, "normal").otherwise("high"))
    wide = H.to_wide(labs, ["pid"], "qid", "label", qids)
    rows = wide.join(v_surv(spark, sf).select("pid", "train"), "pid", "right")
    return rounded(H.categorical_profile(rows, ["train"], qids, mask=5), "p")


@query("shares_within_group", "D15 E12 D14", f"""
WITH a AS (SELECT name, pid, SUM(score) AS s FROM v_scores GROUP BY 1, 2), b AS (SELECT name, SUM(abs(s)) AS total, AVG(s) AS mean FROM a GROUP BY name)
SELECT name, round(total, 2) AS total, {q6("mean", "mean")}, {q6("total / SUM(total) OVER ()", "share")} FROM b""")
def shares_within_group(spark, sf):
    per = v_scores(spark, sf).groupBy("name", "pid").agg(F.sum("score").alias("s"))
    totals = per.groupBy("name").agg(F.sum(F.abs("s")).alias("total"), F.avg("s").alias("mean"))
    return rounded(H.share_within(totals, "total", [], "share").withColumn("total", F.round("total", 2)), "mean", "share")


@query("exact_quantiles", "D16", " UNION ALL ".join(
    f"SELECT name, CAST({i} AS INTEGER) AS i, {q6(f'quantile_cont(score, {p})', 'value')} FROM v_scores GROUP BY name" for i, p in enumerate([0.025, 0.25, 0.5, 0.975])))
def exact_quantiles(spark, sf):
    from vitalspan.operators.ordered import quantiles
    out = quantiles(v_scores(spark, sf), ["name"], "score", [0.025, 0.25, 0.5, 0.975])
    return rounded(out.select("name", F.posexplode("q").alias("i", "value")), "value")


@query("value_kinds", "D18", """
SELECT split_part(feature, '_', 2) AS fname, CASE WHEN COUNT(DISTINCT feature) > 1 THEN 'categorical' WHEN COUNT(DISTINCT vals) > 2 THEN 'continuous' ELSE 'logical' END AS type FROM v_attributions GROUP BY 1
UNION ALL SELECT name, CASE WHEN COUNT(DISTINCT score) > 2 THEN 'continuous' ELSE 'logical' END FROM v_scores GROUP BY 1""")
def value_kinds(spark, sf):
    a = v_attributions(spark, sf).select(S.split_feature("feature")["fname"].alias("fname"), "feature", F.col("vals").alias("value"))
    b = v_scores(spark, sf).select(F.col("name").alias("fname"), F.col("name").alias("feature"), F.col("score").alias("value"))
    return H.value_kind(a.unionByName(b), ["fname"], "value", F.col("feature"))


@query("wide_and_long", "D19 D20 A10", f"""
SELECT pid, name, {q6("score", "value")} FROM v_scores""")
def wide_and_long(spark, sf):
    names = ["ENGAGE", "SEG1", "SEG2", "SEG3", "SEG4", "SEG5"]
    wide = H.to_wide(v_scores(spark, sf), ["pid"], "name", "score", names)
    return rounded(H.to_long(wide, ["pid"], names).where(F.col("value").isNotNull()), "value")


@query("completed_grid", "D21", "SELECT g.name, y.yr, COALESCE(c.n, 0) AS n FROM (SELECT DISTINCT name FROM v_scores) g CROSS JOIN (SELECT DISTINCT CAST(floor(abs(score) / 50000) AS BIGINT) AS yr FROM v_scores) y LEFT JOIN (SELECT name, CAST(floor(abs(score) / 50000) AS BIGINT) AS yr, COUNT(*) AS n FROM v_scores GROUP BY 1, 2) c ON c.name = g.name AND c.yr = y.yr")
def completed_grid(spark, sf):
    counts = v_scores(spark, sf).groupBy("name", F.floor(F.abs("score") / 50000).alias("yr")).agg(F.count("*").alias("n"))
    return H.complete_grid(counts, ["name"], "yr", {"n": 0})


@query("nested_rows", "D22 M2", f"SELECT pid, name, {q6('score', 'score')} FROM v_scores")
def nested_rows(spark, sf):
    return rounded(H.unnest(H.nest(v_scores(spark, sf), ["pid"]), "data").select("pid", "name", "score"), "score")


@query("prediction_histogram", "D23", f"""
WITH b AS (SELECT model, time, CAST(ceil(surv / 0.025) - 1 AS BIGINT) AS bin, COUNT(*) AS n FROM v_predictions GROUP BY 1, 2, 3) SELECT model, time, bin, n, {q6("bin * CAST(0.025 AS DOUBLE)", "lower")}, {q6("n / SUM(n) OVER (PARTITION BY model, time)", "share")} FROM b""")
def prediction_histogram(spark, sf):
    return rounded(H.histogram(v_predictions(spark, sf), "surv", 0.025, ["model", "time"]), "lower", "share")


@query("first_row_per_key", "D25 E1 E2", """
SELECT pid, entryid, proc_date, native_kar FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY proc_date, entryid) AS rn FROM v_procedures_raw) WHERE rn = 1""")
def first_row_per_key(spark, sf):
    return J.first_row(v_procedures_raw(spark, sf), ["pid"], [F.col("proc_date"), F.col("entryid")], ["entryid", "proc_date", "native_kar"])


# --- windows, sampling, unions --------------------------------------------------------------------------------------


@query("ranked_scores", "E4 E6 E13", f"""
WITH a AS (SELECT name, AVG(score) AS m, COUNT(*) AS n FROM v_scores GROUP BY name)
SELECT name, {q6("m", "m")}, CAST(dense_rank() OVER (ORDER BY round(m, 9) DESC) AS INTEGER) AS rank, CAST(SUM(n) OVER (ORDER BY name) AS BIGINT) AS upto, CAST(LAG(n, 1, 0) OVER (ORDER BY name) AS BIGINT) AS previous FROM a""")
def ranked_scores(spark, sf):
    means = v_scores(spark, sf).groupBy("name").agg(F.avg("score").alias("m"), F.count("*").alias("n")).withColumn("k", F.lit(0))
    w = Window.partitionBy("k").orderBy("name")  # one row per score name
    ranked = H.dense_ranked(means, ["k"], "m")
    out = ranked.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "previous": F.lag("n", 1, 0).over(w)})
    return rounded(longs(out.drop("n", "k"), "upto", "previous"), "m")


@query("running_totals", "E6 E7", f"""
SELECT study_name, number, {q6("SUM(value) OVER (PARTITION BY study_name ORDER BY number)", "total")}, {q6("MAX(value) OVER (PARTITION BY study_name ORDER BY number DESC)", "best_after")} FROM v_trials""")
def running_totals(spark, sf):
    rows = v_trials(spark, sf).select("study_name", "number", "value")
    first = running(rows, ["study_name"], ["number"], {"total": ("sum", "value")})
    return rounded(running(first, ["study_name"], ["number"], {"best_after": ("max", "value")}, descending=True).drop("value"), "total", "best_after")


@query("top_k_global", "F2 F1", f"SELECT feature, {q6('m', 'm')} FROM (SELECT feature, round(SUM(abs(shap)), 9) AS m FROM v_attributions GROUP BY feature) ORDER BY m DESC, feature LIMIT 25")
def top_k_global(spark, sf):
    sums = v_attributions(spark, sf).groupBy("feature").agg(F.round(F.sum(F.abs("shap")), 9).alias("m"))
    return rounded(sums.orderBy(F.col("m").desc(), "feature").limit(25), "m")


@query("random_sample_per_group", "F3", """
SELECT pid, name FROM (SELECT pid, name, ROW_NUMBER() OVER (PARTITION BY name ORDER BY md5(CAST(pid AS VARCHAR)), pid) AS rn FROM v_scores) WHERE rn <= 6""")
def random_sample_per_group(spark, sf):
    ranked = random_rank(v_scores(spark, sf), "pid", ["name"], F.md5(F.col("pid").cast("string").cast("binary")))
    return ranked.where("rank <= 6").select("pid", "name")


@query("tagged_union", "G1 G2", """
SELECT 'tests' AS source, COUNT(*) AS n, COUNT(result) AS results, COUNT(weight) AS weights FROM (SELECT pid, result, NULL AS weight FROM v_tests) UNION ALL SELECT 'procedures', COUNT(*), 0, COUNT(weight) FROM v_procedures_raw""")
def tagged_union(spark, sf):
    rows = H.tagged_union({"tests": v_tests(spark, sf).select("pid", "result"), "procedures": v_procedures_raw(spark, sf).select("pid", "weight")})
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("result").alias("results"), F.count("weight").alias("weights"))


@query("rare_and_common_codes", "D6 D7 D8 G4", """
WITH e AS (SELECT DISTINCT o_custkey AS pid, o_orderpriority || o_orderstatus AS code FROM orders), s AS (SELECT code, COUNT(*) AS n FROM e GROUP BY code), z AS (SELECT COUNT(*) AS size FROM customer)
SELECT s.code, n, n / CAST(size AS DOUBLE) >= 0.5 AS kept, n > size * 0.52 AS common FROM s, z""")
def rare_and_common_codes(spark, sf):
    events = table(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), F.concat("o_orderpriority", "o_orderstatus").alias("code")).distinct()
    cohort = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"))
    counts = events.groupBy("code").agg(F.count("*").alias("n"))
    kept = H.drop_rare_codes(events, cohort, 0.5).select("code").distinct()
    common = H.keep_common_codes(events, cohort, 0.52).select("code").distinct()
    return J.membership_flag(J.membership_flag(counts, kept, ["code"], "kept"), common, ["code"], "common")
