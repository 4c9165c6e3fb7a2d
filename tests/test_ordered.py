"""Blocked running aggregates must equal plain ones, whatever the block size and however hot a group is."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalspan.operators import ordered
from vitalspan.operators.ordered import fill_downup, quantiles, random_rank, running, with_blocks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 2003, float(rng.randint(-50, 50)), None if rng.random() < 0.4 else rng.randint(0, 9)) for i in range(2003)]
    return pd.DataFrame(data, columns=["g", "o", "v", "x"]), spark.createDataFrame(data, "g STRING, o INT, v DOUBLE, x INT")


def test_hot_group_is_cut_and_small_ones_are_not(rows):
    pdf, df = rows
    sizes = with_blocks(df, ["g"], ["o"], block_rows=50).groupBy("g", "_block").count().toPandas()
    assert (sizes["g"] == "hot").sum() > 5 and sizes["count"].max() < 600
    assert with_blocks(df, ["g"], ["o"]).where("_cut OR _block IS NOT NULL").count() == 0


def test_blocks_hold_the_rows_between_two_cut_points(rows, monkeypatch):
    pdf, df = rows
    monkeypatch.setattr(ordered, "FAN", 4)  # marks and lists of several cut points
    out = with_blocks(df, ["g"], ["o"], block_rows=5).toPandas()
    for _, group in out.groupby("g"):
        cuts = np.array(sorted(group["_block"].dropna().unique()))
        at = np.searchsorted(cuts, group["o"], side="right")
        assert all((i == 0 and np.isnan(b)) or cuts[i - 1] == b for i, b in zip(at, group["_block"].astype(float)))


@pytest.mark.parametrize("block_rows", [3, 7, 50, 1 << 20])
@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_plain_window(rows, block_rows, descending):
    pdf, df = rows
    out = running(df.select("g", "o", "v"), ["g"], ["o"], {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, descending, block_rows).toPandas()
    out = out.sort_values(["g", "o"], ascending=[True, not descending]).reset_index(drop=True)
    ref = pdf.sort_values(["g", "o"], ascending=[True, not descending]).reset_index(drop=True).groupby("g")["v"]
    assert np.allclose(out["s"], ref.cumsum()) and np.allclose(out["lo"], ref.cummin()) and np.allclose(out["hi"], ref.cummax())


def test_running_without_groups(rows):
    pdf, df = rows
    out = running(df.select("o", "v"), [], ["o"], {"s": ("sum", "v")}, block_rows=20).toPandas().sort_values("o")
    assert list(out.columns) == ["o", "v", "s"]
    assert np.allclose(out["s"], pdf.sort_values("o")["v"].cumsum())


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, i, 1.0) for i in range(40)] + [("a", i, 1.0) for i in range(5)], "g STRING, o INT, v DOUBLE")
    out = running(df, ["g"], ["o"], {"s": ("sum", "v")}, block_rows=4).groupBy("g").agg(F.max("s").alias("m")).collect()
    assert {r["g"]: r["m"] for r in out} == {None: 40.0, "a": 5.0}


@pytest.mark.parametrize("block_rows", [7, 1 << 20])
def test_fill_down_then_up(rows, block_rows):
    pdf, df = rows
    out = fill_downup(df, ["g"], ["o"], ["x"], block_rows).toPandas().sort_values(["g", "o"])["x"].to_numpy(float)
    ref = pdf.sort_values(["g", "o"]).groupby("g")["x"].transform(lambda s: s.ffill().bfill()).to_numpy(float)
    assert np.array_equal(out, ref, equal_nan=True)


def test_fill_edge_runs(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("a", 4, 7), ("a", 5, None), ("b", 1, None), ("b", 2, None)], "g STRING, o INT, x INT")
    out = [r["x"] for r in fill_downup(df, ["g"], ["o"], ["x"]).orderBy("g", "o").collect()]
    assert out == [5, 5, 5, 7, 7, None, None]


def test_fill_of_a_long_group(spark):
    """A million rows of one group, known at few places: each row is looked at once each way."""
    n = 1_000_000
    known = F.when(F.col("id") % 250_000 == 125_000, F.col("id"))
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("o"), known.alias("x"))
    filled = fill_downup(df, ["g"], ["o"], ["x"], 1 << 24)
    last = F.greatest(F.floor((F.col("o") - 125_000) / 250_000), F.lit(0)) * 250_000 + 125_000
    assert filled.where(F.col("x") != last).count() == 0 and filled.where("x IS NULL").count() == 0


@pytest.mark.parametrize("block_rows", [11, 1 << 20])
def test_quantiles_match_linear_interpolation(rows, block_rows):
    pdf, df = rows
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    for r in quantiles(df, ["g"], "v", probs, block_rows=block_rows).collect():
        assert np.allclose(r["q"], np.quantile(pdf[pdf.g == r["g"]]["v"], probs))
    assert np.allclose(quantiles(df, [], "v", probs).first()["q"], np.quantile(pdf["v"], probs))


def test_random_rank_is_a_permutation_and_stable(spark):
    df = spark.range(500).withColumnRenamed("id", "pid")
    first = {r["pid"]: r["rank"] for r in random_rank(df, "pid", block_rows=40).collect()}
    second = {r["pid"]: r["rank"] for r in random_rank(df.repartition(3), "pid", block_rows=64).collect()}
    assert sorted(first.values()) == list(range(1, 501)) and first == second
    assert first != {r["pid"]: r["rank"] for r in random_rank(df, "pid", seed=7).collect()}
