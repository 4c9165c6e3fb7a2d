import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitalspan.functions import scalars as S
from vitalspan.functions.aggregates import active_text, all3, any3, ordered_text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


def test_swap_with_unknown_condition_blanks_both(spark):
    rows = spark.createDataFrame([(80, 120), (120, 80), (None, 80), (120, None)], "sys INT, dia INT")
    a, b = S.swap_if(F.col("dia") > F.col("sys"), "sys", "dia")
    assert [tuple(r) for r in rows.select(a, b).collect()] == [(120, 80), (120, 80), (None, None), (None, None)]
    a, b = S.swap_if(F.col("dia") > F.col("sys"), "sys", "dia", null_keeps=True)
    assert [tuple(r) for r in rows.select(a, b).collect()] == [(120, 80), (120, 80), (None, 80), (120, None)]


def test_height_weight_swap_only_unknown_when_undecided(spark):
    rows = spark.createDataFrame([(120.0, 160.0), (None, 160.0), (None, 60.0)], "h DOUBLE, w DOUBLE")
    w, h = S.swap_if((F.col("h") < 150) & (F.col("w") > 150), "w", "h")
    assert [tuple(r) for r in rows.select(h, w).collect()] == [(160.0, 120.0), (None, None), (None, 60.0)]


@pytest.mark.parametrize("text,expected", [("1.5", True), ("0", False), ("-1", False), ("", None), ("x", None), (None, None)])
def test_text_numbers_compare_as_numbers(spark, text, expected):
    assert one(spark, F.col("t").try_cast("double") > 0, t=("STRING", text)) is expected


@pytest.mark.parametrize("born,at,age", [
    ("1950-06-15", "2010-06-14", 60.0), ("1950-06-15", "2010-06-15", 60.0), ("1950-06-15", "2010-12-15", 60.5),
    ("1952-02-29", "2011-02-28", 59.0), ("1952-02-29", "2012-02-28", 60.0), ("1952-02-29", "2012-02-29", 60.0)])
def test_age_is_calendar_exact(spark, born, at, age):
    value = one(spark, S.age_years("b", "a"), b=("DATE", dt.date.fromisoformat(born)), a=("DATE", dt.date.fromisoformat(at)))
    assert value == pytest.approx(age, abs=0.011)


@pytest.mark.parametrize("x,label", [(0.0, None), (0.25, "(0,0.5]"), (0.5, "(0,0.5]"), (0.5000001, "(0.5,1]"), (1.0, "(0.5,1]"), (None, None)])
def test_bins_are_right_closed(spark, x, label):
    assert one(spark, S.cut_breaks("v", [0, 0.5, 1]), v=("DOUBLE", x)) == label


def test_lowest_edge_belongs_to_first_equal_width_bin(spark):
    assert one(spark, S.equal_width_bins("v", 10, 0, 60), v=("DOUBLE", 0.0)) == "[0,10]"
    assert one(spark, S.equal_width_bins("v", 10, 0, 60), v=("DOUBLE", 10.0)) == "[0,10]"


@pytest.mark.parametrize("code,out", [("DI25", "DI259"), ("DI251", "DI251"), ("DI2512", "DI251"), ("DI2", "DI2")])
def test_normalise_code(spark, code, out):
    assert one(spark, S.normalise_code("c"), c=("STRING", code)) == out


@pytest.mark.parametrize("kind,hit", [("A", True), ("B", True), ("CA", False), ("AB", True)])
def test_prefix_alternation_is_grouped(spark, kind, hit):
    assert one(spark, S.matches_prefix("t", "A", "B"), t=("STRING", kind)) is hit


def test_small_conversions(spark):
    assert one(spark, S.excel_serial_to_date("t"), t=("STRING", "39448")) == dt.date(2008, 1, 1)
    assert one(spark, S.excel_serial_to_date("t"), t=("STRING", "n/a")) is None
    assert one(spark, S.roman_to_int("t"), t=("STRING", "NYHA III")) == 3
    assert one(spark, S.roman_to_int("t"), t=("STRING", "unknown")) is None
    assert one(spark, S.extract("t", r"\d"), t=("STRING", "none")) is None
    assert one(spark, S.datetime_from_parts("d", "h"), d=("DATE", dt.date(2010, 1, 2)), h=("INT", None)) == dt.datetime(2010, 1, 2)
    assert one(spark, S.datetime_from_parts("d", "h", "m"), d=("DATE", dt.date(2010, 1, 2)), h=("INT", 5), m=("INT", 7)) == dt.datetime(2010, 1, 2, 5, 7)
    assert one(spark, S.parse_ymd_hm("t"), t=("STRING", "2010-01-02 03:04")) == dt.datetime(2010, 1, 2, 3, 4)
    assert one(spark, S.parse_ymd_hm("t"), t=("STRING", "soon")) is None
    assert one(spark, S.elapsed_days("a", "b"), a=("TIMESTAMP_NTZ", dt.datetime(2010, 1, 1)), b=("TIMESTAMP_NTZ", dt.datetime(2010, 1, 2, 12))) == 1.5
    assert one(spark, S.estimate_label("a", "b", "c"), a=("DOUBLE", 1.25), b=("DOUBLE", -0.5), c=("DOUBLE", 2.0)) == "+1.3 [-0.5; +2.0]"
    assert one(spark, S.rescale_above("w", 500, 10), w=("DOUBLE", 700.0)) == 70.0


def test_feature_names_split(spark):
    rows = spark.createDataFrame([("clnc-1_killip_2",), ("clnc-1_age",), ("alone",)], "f STRING")
    parts = S.split_feature("f")
    out = [tuple(r) for r in rows.select(parts["fgroup"], parts["fname"], parts["fvalue"], S.feature_stem("f")).collect()]
    assert out == [("clnc-1", "killip", "2", "clnc-1_killip"), ("clnc-1", "age", None, "clnc-1_age"), ("alone", None, None, None)]


def test_any_and_all_keep_unknowns(spark):
    rows = [("a", True), ("a", False), ("b", False), ("b", False), ("c", False), ("c", None), ("d", True), ("d", None), ("e", None)]
    out = spark.createDataFrame(rows, "g STRING, x BOOLEAN").groupBy("g").agg(any3("x").alias("some"), all3("x").alias("all"))
    found = {r["g"]: (r["some"], r["all"]) for r in out.collect()}
    assert found == {"a": (True, False), "b": (False, False), "c": (None, False), "d": (True, None), "e": (None, None)}


def test_ordered_text_is_poisoned_by_null_and_ordered(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, None)], "g STRING, o INT, v STRING")
    out = {r["g"]: (r["t"], r["l"]) for r in rows.groupBy("g").agg(ordered_text("v", "o").alias("t"), ordered_text("v", "o", null_poisons=False).alias("l")).collect()}
    assert out == {"a": ("x,y", "x,y"), "b": (None, "x")}


def test_active_text(spark):
    rows = spark.createDataFrame([("a", "y", True), ("a", "x", True), ("b", "x", False)], "g STRING, v STRING, f BOOLEAN")
    assert {r["g"]: r["t"] for r in rows.groupBy("g").agg(active_text("v", "f").alias("t")).collect()} == {"a": "x;y", "b": "missing"}


def test_censoring(spark):
    rows = spark.createDataFrame([(10, True), (20, True), (30, True)], "time INT, event BOOLEAN")
    time, event = S.censor_at("time", "event", 20)
    assert [tuple(r) for r in rows.select(time, event).collect()] == [(10, True), (20, True), (20, False)]
