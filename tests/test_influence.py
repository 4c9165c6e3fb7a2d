"""Influence values against numerical derivatives by a subject's weight."""
import math
import random

import pytest
from pyspark.sql import functions as F

from vitalspan.operators import influence as I
from vitalspan.operators import metrics as M
from vitalspan.operators import resample as B

TAU = 6.0


def _subjects(n=40, seed=3):
    rng = random.Random(seed)
    return [(i, rng.randint(1, 10), rng.random() < 0.55, rng.randint(0, 6) / 7, rng.random()) for i in range(n)]


def _metrics(rows, weight, k, null=None):
    """Weighted AUC, Brier score and index of prediction accuracy of prediction ``k``, by the definitions."""
    total = sum(weight)

    def at_risk(t):  # for censoring at t: events at t have left
        return sum(v for (_, time, event, *_), v in zip(rows, weight) if time > t or (time == t and not event))

    def g(t, before):
        out = 1.0
        for u in sorted({time for _, time, event, *_ in rows if not event}):
            if u < t or (u == t and not before):
                gone = sum(v for (_, time, event, *_), v in zip(rows, weight) if time == u and not event)
                out *= 1 - gone / at_risk(u)
        return out

    case = [v / g(r[1], True) if r[2] and r[1] <= TAU else 0 for r, v in zip(rows, weight)]
    control = [v / g(TAU, False) if r[1] > TAU else 0 for r, v in zip(rows, weight)]
    risk = [r[k] for r in rows]
    won = sum(a * b * (x > y) + a * b * (x == y) / 2 for a, x in zip(case, risk) for b, y in zip(control, risk))
    error = lambda p: sum(a * (1 - x) ** 2 + b * x**2 for a, b, x in zip(case, control, p)) / total
    brier = error(risk)
    return {"auc": won / sum(case) / sum(control), "brier": brier, "ipa": None if null is None else 1 - brier / error([null] * len(rows))}


def _weighted(spark, rows):
    surv = spark.createDataFrame([r[:3] for r in rows], "pid bigint, time bigint, event boolean")
    scored = spark.createDataFrame(
        [(r[0], m, TAU, r[k]) for r in rows for m, k in (("x", 3), ("y", 4))], "pid bigint, model string, tau double, risk double")
    return M.ipcw(scored, surv, [TAU]), surv


@pytest.mark.parametrize("metric", ["auc", "brier", "ipa"])
def test_values_are_derivatives(spark, metric):
    rows = _subjects()
    weighted, surv = _weighted(spark, rows)
    null = M.null_risk(surv, [TAU]).first()["null_risk"]
    found = {(r.model, r.pid): r for r in I.influence(weighted, ["model", "tau"], metric, surv=surv, block_rows=8).collect()}
    for m, k in (("x", 3), ("y", 4)):
        for i in range(0, len(rows), 3):
            up, down = ([1 + (e if j == i else 0) for j in range(len(rows))] for e in (1e-5, -1e-5))
            slope = (_metrics(rows, up, k, null)[metric] - _metrics(rows, down, k, null)[metric]) / 2e-5
            assert math.isclose(found[m, i].influence / len(rows), slope, rel_tol=1e-4, abs_tol=1e-8)
        assert math.isclose(found[m, 0].value, _metrics(rows, [1] * len(rows), k, null)[metric], rel_tol=1e-9)


def test_contrasts_from_values(spark):
    weighted, _ = _weighted(spark, _subjects())
    values = I.influence(weighted, ["model", "tau"], "auc")
    own = {(r.model, r.pid): r for r in values.collect()}
    row = I.contrasts(values, "x").collect()[0]
    gaps = [own["y", i].influence - own["x", i].influence for i in range(40)]
    assert row.model == "y" and math.isclose(row.se, math.sqrt(sum(g * g for g in gaps)) / 40)
    assert math.isclose(row.delta, own["y", 0].value - own["x", 0].value) and row.p_adjusted == row.p
    single = {r.model: r for r in I.estimates(values, ["model", "tau"]).collect()}
    assert math.isclose(single["x"].se, math.sqrt(sum(own["x", i].influence ** 2 for i in range(40))) / 40)


def test_undefined_and_unknown(spark):
    rows = [(i, 3 + i % 2, True, 0.1 * i, 0.5) for i in range(6)]  # nobody is left at the horizon
    weighted, _ = _weighted(spark, rows)
    assert {r.value for r in I.influence(weighted, ["model", "tau"], "auc").collect()} == {None}
    none = I.contrasts(I.influence(weighted, ["model", "tau"], "auc"), "x").collect()
    assert len(none) == 1 and none[0].p is None and none[0].p_adjusted is None
    missing = weighted.withColumn("risk", F.when(F.col("pid") != 2, F.col("risk")))
    assert I.influence(missing, ["model", "tau"], "brier").count() == 10
    with pytest.raises(ValueError):
        I.influence(weighted, ["model", "tau"], "ipa")
    with pytest.raises(ValueError):
        I.influence(weighted, ["model", "tau"], "c")


def test_a_score_and_a_time_of_most_rows(spark):
    """One score and one time of a third of the rows: sums by score and by time, blocks of a few."""
    rows = [(i, 9 if i % 3 else 1 + i % 7, i % 5 != 0, 0.5 if i % 3 == 1 else (i % 89) / 89, (i * 37 % 101) / 101) for i in range(600)]
    weighted, _ = _weighted(spark, rows)
    a, b = (sorted((r.model, r.pid, round(r.influence, 9)) for r in I.influence(weighted, ["model", "tau"], "auc", block_rows=n).collect()) for n in (4, 1 << 20))
    assert a == b


@pytest.mark.parametrize("block_rows", [1 << 6, 1 << 16])
def test_bootstrap_of_shared_scores(spark, block_rows):
    """One score of a third of the rows, some of a few rows, most of one: the same as with all replicates written out."""
    rows = [(i, 9 if i % 3 else 1 + i % 7, i % 5 != 0, 0.5 if i % 3 == 1 else (i % 89 if i % 2 else i) / 601, (i * 37 % 101) / 101) for i in range(600)]
    weighted, _ = _weighted(spark, rows)
    got = {(r.model, r.replicate): r.auc for r in B.bootstrap_auc(weighted, ["model", "tau"], 12, block_rows=block_rows).collect()}
    plain = M.td_auc(B.with_replicates(weighted, "pid", 12), ["model", "tau", "replicate"], weight="w_boot")
    want = {(r.model, r.replicate): r.auc for r in plain.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
