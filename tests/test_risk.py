import math

import pytest

from vitalspan.operators import risk as R
from vitalspan.sources import lookups as L


def by_hand(values):
    """Nearest tabulated points per term (lower on ties), then the published formulas."""
    out = {}
    for model in L.MODELS:
        score = 0.0
        for term, x in values.items():
            points = [(v, s) for v, s, t, m in L.points_rows() if t == term and m == model]
            score += min((abs(v - x), v, s) for v, s in points)[2]
        score = round(score, 7)
        if model == "6m":
            p = next((p for a, b, p in L.BANDS if a < score and (b is None or score <= b)), None)
            p = None if p is None else p * 100 * (80 / 91)
            out[model] = (score, 92.0 if p is not None and p > 90 else p)
        else:
            out[model] = (score, (1 - L.BASELINE_SURVIVAL[model] ** math.exp(score)) * 100)
    return out


CASES = [
    dict(age=66.5, pulse=80, sbp=120, creatinine=1.0, killip=1, arrest=0, enzymes=1, stemi=0),
    dict(age=25, pulse=40, sbp=250, creatinine=0.395, killip=1, arrest=0, enzymes=0, stemi=0),
    dict(age=104, pulse=200, sbp=60, creatinine=9.0, killip=4, arrest=1, enzymes=1, stemi=1),
    dict(age=71, pulse=114.5, sbp=99.5, creatinine=2.2, killip=3, arrest=0, enzymes=1, stemi=1),
]


@pytest.mark.parametrize("case", CASES)
def test_score_against_the_formulas(spark, case):
    names = {"sbp": "sys_bp", "creatinine": "crea"}
    df = spark.createDataFrame([(1, *[float(v) for v in case.values()])], "pid INT, " + ", ".join(f"{names.get(k, k)} DOUBLE" for k in case))
    ref = by_hand(case)
    for r in R.risk_score(df).collect():
        score, prob = ref[r["model"]]
        assert r["score"] == pytest.approx(score, abs=1e-7)
        assert (r["prob"] is None and prob is None) or r["prob"] == pytest.approx(prob)


@pytest.mark.parametrize("score,prob", [(0.0, None), (7.0, 0.002 * 8000 / 91), (7.1, 0.004 * 8000 / 91), (240.0, 0.99 * 8000 / 91), (241.0, 92.0)])
def test_band_edges_and_cap(spark, score, prob):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([(score,)], "s DOUBLE").select(R.six_month_probability(F.col("s")).alias("p")).first()["p"]
    assert got is None if prob is None else got == pytest.approx(prob)


def test_missing_input_gives_no_score_and_marks_imputation(spark):
    schema = "pid INT, age DOUBLE, pulse INT, sys_bp INT, crea DOUBLE, killip INT, arrest BOOLEAN, enzymes BOOLEAN, stemi BOOLEAN"
    df = spark.createDataFrame([(1, 60.0, None, 120, 90.0, None, False, True, False), (2, 60.0, 80, 120, 90.0, None, False, True, False)], schema)
    out = R.risk_scores_table(df).collect()
    assert all(r["value"] is None and r["imputed"] for r in out if r["pid"] == 1)
    assert all(r["value"] is not None and not r["imputed"] for r in out if r["pid"] == 2)  # missing Killip class counts as 1
    assert sorted(r["time"] for r in out if r["pid"] == 2) == [183.0, 365.0, 1095.0]


def test_points_can_come_from_a_table(spark):
    df = spark.createDataFrame([(1, 5.0)], "pid INT, x DOUBLE")
    rows = [(0.0, 1.0, "x", "1y"), (10.0, 2.0, "x", "1y")]
    assert R.risk_score(df, rows, inputs={"x": "x"}).first()["score"] == 1.0


def test_imputation_fills_everything_and_keeps_known_cells(spark):
    rows = [(i, float(i % 10), None if i % 7 == 0 else 2.0 * (i % 10), None if i % 5 == 0 else ("lo" if i % 10 < 5 else "hi")) for i in range(200)]
    df = spark.createDataFrame(rows, "pid INT, a DOUBLE, b DOUBLE, c STRING")
    out = R.impute_forest(df, "pid", ["a", "b"], ["c"], iterations=1, trees=5, depth=4).toPandas().set_index("pid")
    assert out.notna().all().all()
    for i, a, b, c in rows:
        assert out.loc[i, "a"] == a and (b is None or out.loc[i, "b"] == b) and (c is None or out.loc[i, "c"] == c)
    guessed = [(out.loc[i, "b"], 2 * a) for i, a, b, _ in rows if b is None]
    assert sum(abs(x - y) for x, y in guessed) / len(guessed) < 4


def test_imputation_stops_and_reports_its_errors(spark):
    rows = [(i, float(i % 10), 2.0 * (i % 10) if i % 7 else None, ("lo" if i % 10 < 5 else "hi") if i % 5 else None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "pid INT, a DOUBLE, b DOUBLE, c STRING, d STRING")
    filled, changes = R.impute_rounds(df, "pid", ["a", "b"], ["c", "d"], iterations=8, trees=10, depth=5)
    assert 2 <= len(changes) < 8 and filled.where("b IS NULL OR c IS NULL OR a IS NULL OR d IS NOT NULL").count() == 0
    last = [x for pair in changes[-2:] for x in pair]
    assert all(b >= a for a, b in zip(last[:2], last[2:]))  # the round that changed no less than the one before is not taken
    found = {r.name: r for r in R.imputation_errors(df, "pid", ["a", "b"], ["c"], iterations=3, trees=10).collect()}
    assert all(r.n_masked > 10 and r.error < 0.8 * r.start_error for r in found.values())
    none = R.impute_rounds(df.where("false"), "pid", ["a"], ["c"])
    assert none[0].count() == 0 and none[1] == []


def test_plausible_input_ranges(spark):
    schema = "pid INT, age DOUBLE, pulse INT, sys_bp INT, crea DOUBLE, killip INT, arrest BOOLEAN, enzymes BOOLEAN, stemi BOOLEAN"
    df = spark.createDataFrame([(1, 60.0, None, 120, 1.0, 1, False, True, False), (2, 12.0, 80, 120, 1.0, 1, False, True, False)], schema)
    assert {r["pid"]: r["ok"] for r in df.select("pid", R.in_score_range().alias("ok")).collect()} == {1: True, 2: False}


def test_imputation_trains_on_rows_dealt_over_all_cores(spark, monkeypatch):
    """No forest works through the one before it again, and each is trained on as many partitions as there are cores."""
    seen = []
    settled = R.settle
    monkeypatch.setattr(R, "settle", lambda df: seen.append(df.rdd.getNumPartitions()) or settled(df))
    rows = [(i, float(i % 7) if i % 5 else None, float(i % 3) if i % 4 else None, "ab"[i % 2] if i % 6 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "pid BIGINT, a DOUBLE, b DOUBLE, c STRING").coalesce(1)
    out = R.impute_forest(df, "pid", ["a", "b"], ["c"], iterations=1, trees=3, depth=2)
    assert seen == [spark.sparkContext.defaultParallelism] * 4
    assert out.count() == 60 and out.where("a IS NULL OR b IS NULL OR c IS NULL").count() == 0
