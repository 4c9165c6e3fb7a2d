import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitalspan.operators import cohort as C
from vitalspan.operators.validate import require_valid, validate_table
from vitalspan.session import settle
from vitalspan.sources import readers, writers
from vitalspan.sources.schemas import DDL, RULES, schema


def test_typed_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2010, 1, 2), None), (2, None, "b")], "pid INT, d DATE, t STRING")
    path = str(tmp_path / "typed")
    writers.write_delimited(df, path, compression="gzip")
    back = readers.read_typed(spark, path, "pid INT, d DATE, t STRING", columns=["pid", "t"])
    assert back.columns == ["pid", "t"] and sorted(tuple(r) for r in back.collect()) == [(1, None), (2, "b")]
    assert any(p.suffix == ".gz" for p in (tmp_path / "typed").iterdir())
    assert readers.header_columns(spark, path) == ["pid", "d", "t"]


def test_open_band_reads_as_infinity(spark, tmp_path):
    (tmp_path / "bands.csv").write_text("from,to,probability\n0,7,0.002\n240,Inf,2.13\n")
    rows = readers.read_bands(spark, str(tmp_path / "bands.csv")).orderBy("from").collect()
    assert rows[1]["to"] == float("inf")


def test_many_files_carry_their_name(spark, tmp_path):
    for name in ("ENGAGE", "OTHER"):
        (tmp_path / f"{name}.tsv").write_text(f"pid\tscore\n1\t{len(name)}.5\n")
    out = readers.read_many(spark, str(tmp_path / "*.tsv"), "pid INT, score DOUBLE", r"([^/]+)\.tsv")
    assert {r["name"]: r["score"] for r in out.collect()} == {"ENGAGE": 6.5, "OTHER": 5.5}


def test_wide_and_long_predictions(spark):
    long = spark.createDataFrame([(1, 10.0, 0.9), (1, 20.5, 0.8), (2, 10.0, 0.7)], "pid INT, time DOUBLE, surv DOUBLE")
    wide = writers.wide_predictions(long, [10.0, 20.5])
    assert wide.columns == ["pid", "10", "20.5"]
    back = writers.long_predictions(wide).where("surv IS NOT NULL")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in long.collect())


def test_append_refuses_broken_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, True, 5, False)], schema("surv_master"))
    writers.create_table(good, path, ["pid"])
    with pytest.raises(ValueError, match="primary_key"):
        writers.append_table(good.unionByName(good), path, RULES["surv_master"])
    assert readers.read_table(spark, path).count() == 1


def test_every_rule_counts_its_violations(spark):
    parent = spark.createDataFrame([(1,), (2,)], "pid INT")
    df = spark.createDataFrame([(1, "yes", 2), (1, "odd", 9), (3, None, None)], "pid INT, smoking STRING, nyha INT")
    rules = [{"rule": "primary_key", "columns": ["pid"]}, {"rule": "foreign_key", "columns": ["pid"], "parent": "p"},
             {"rule": "domain", "column": "smoking", "values": ["yes"]}, {"rule": "range", "column": "nyha", "lo": 1, "hi": 4}, {"rule": "not_null", "column": "nyha"}]
    out = {r["rule"]: r["violations"] for r in validate_table(df, rules, {"p": parent}).collect()}
    assert out == {"primary_key:pid": 1, "foreign_key:pid": 1, "domain:smoking": 1, "range:nyha": 1, "not_null:nyha": 1}
    require_valid(parent, [{"rule": "primary_key", "columns": ["pid"]}], {})


def test_schemas_parse():
    assert all(schema(t).fields for t in DDL)


def test_settled_table_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [1.0], None)], "a INT, b ARRAY<DOUBLE>, c STRING")
    out = settle(df)
    assert out.collect() == df.collect() and out.schema == df.schema


def test_cohort_steps(spark):
    d = dt.date.fromisoformat
    procedures = [
        (1, 11, d("2010-01-01"), "Nej", "2 gebet"), (1, 12, d("2012-01-01"), "Ja", "3 gebet"),   # kept: first entry untreated
        (2, 21, d("2010-01-01"), "Ja", "2 gebet"),                                              # prior treatment
        (3, 31, d("2005-01-01"), "Nej", "1 gebet"), (3, 32, d("2010-01-01"), "Nej", "1 gebet"),   # an entry too early
        (4, 41, d("2010-01-01"), "Nej", "Normal"),                                              # site
        (5, 51, d("2010-01-01"), None, "Ateromatose"),                                          # no diagnosis
        (6, 61, d("2018-01-01"), "Nej", "1 gebet"),                                             # too late
        (7, 71, d("2010-01-01"), None, "Ateromatose"), (8, 81, d("2010-01-01"), "Nej", "1 gebet"), (9, 91, d("2010-01-01"), "Nej", "1 gebet")]
    pats = spark.createDataFrame(procedures, "pid INT, entryid INT, proc_date DATE, prev_ami STRING, native_kar STRING")
    dia = spark.createDataFrame([(i, "DI251" if i != 5 else "DI101", "A") for i in range(1, 10)], "pid INT, code STRING, type STRING")
    persons = spark.createDataFrame(
        [(i, "K", d("1950-01-01") if i != 8 else d("2000-01-01"), "80" if i == 9 else "90", d("2015-01-01") if i != 7 else None) for i in range(1, 10)],
        "pid INT, sex STRING, born DATE, status STRING, status_date DATE")
    steps = C.patient_steps(pats, dia, persons, "2017-01-01", "2006-01-01", "2019-12-31", ["prev_ami"])
    counts = [r["patients"] for r in C.attrition_log(steps).orderBy("step").collect()]
    assert counts == [8, 7, 6, 5, 4, 3, 2]
    out = {r["pid"]: (r["entryid"], r["sex"], r["index_type"], r["status"], r["status_date"]) for r in C.select_cohort(steps).collect()}
    assert out == {1: (11, "F", "2", "dead", d("2015-01-01")), 7: (71, "F", "0", "dead", d("2019-12-31"))}


def test_index_values_come_from_before_then_after(spark):
    rows = spark.createDataFrame(
        [(1, dt.date(2010, 1, i), i, x, y, z) for i, x, y, z in ((1, 5, None, None), (2, None, None, None), (3, 9, 7, None), (4, None, 8, None))],
        "pid INT, d DATE, e INT, x INT, y INT, z INT")
    for entry in (lambda e: e, lambda e: e - 10, lambda e: e + 2**60):  # negative and huge entry numbers
        placed = rows.withColumns({"e": entry(F.col("e").cast("bigint")), "_d": F.lit(dt.date(2010, 1, 2)), "_e": entry(F.lit(2).cast("bigint"))})
        out = C.filled_at_index(placed, "pid", ["d", "e"], ["_d", "_e"], ["x", "y", "z"]).first()
        assert (out["x"], out["y"], out["z"]) == (5, 7, None)
    out = C.filled_at_index(placed, "pid", ["d", "e"], ["_d", "_e"], ["x", "y", "z"]).first()
    assert (out["x"], out["y"], out["z"]) == (5, 7, None)
