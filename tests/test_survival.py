import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspan.operators import metrics as M
from vitalspan.operators import resample as B
from vitalspan.operators import survival as V


def frame(spark, rows):
    return spark.createDataFrame(rows, "time INT, event BOOLEAN")


def test_km_without_censoring_is_the_empirical_survival_function(spark):
    times = [1, 2, 2, 3, 5, 8, 8, 9]
    curve = {r["time"]: r["surv"] for r in V.kaplan_meier(frame(spark, [(t, True) for t in times])).collect()}
    for t, s in curve.items():
        assert s == pytest.approx(sum(x > t for x in times) / len(times), abs=1e-12)


def test_km_starts_at_one_and_never_rises(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 60), rng.random() < 0.5) for _ in range(300)], "g STRING, time INT, event BOOLEAN")
    rows = V.kaplan_meier(df, ["g"], leading_row=True).orderBy("g", F.col("surv").desc(), "time").collect()
    for g in "ab":
        values = [r["surv"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: (r["time"], -r["surv"]))]
        assert values[0] == 1.0 and all(a >= b - 1e-12 for a, b in zip(values, values[1:]))


def test_integer_and_fractional_times_agree(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 40), rng.random() < 0.4) for _ in range(200)]
    a = {r["time"]: r["surv"] for r in V.kaplan_meier(frame(spark, rows)).collect()}
    b = {r["time"]: r["surv"] for r in V.kaplan_meier(spark.createDataFrame([(float(t), e) for t, e in rows], "time DOUBLE, event BOOLEAN")).collect()}
    assert a.keys() == {int(t) for t in b} and all(abs(a[int(t)] - s) < 1e-12 for t, s in b.items())


def test_last_subject_dying_gives_zero_and_no_interval(spark):
    last = V.kaplan_meier(frame(spark, [(1, True), (2, True)])).orderBy("time").collect()[-1]
    assert (last["surv"], last["lower"], last["upper"]) == (0.0, None, None)


def test_known_greenwood_interval(spark):
    row = V.kaplan_meier(frame(spark, [(1, True)] + [(2, False)] * 9)).orderBy("time").first()
    se = math.sqrt(1 / (10 * 9))
    assert row["surv"] == pytest.approx(0.9) and row["lower"] == pytest.approx(0.9 * math.exp(-V.Z95 * se)) and row["upper"] == 1.0


def test_step_lookup_and_restricted_mean(spark):
    curve = V.kaplan_meier(frame(spark, [(2, True), (4, False), (6, True), (6, True)]))
    at = {r["tau"]: r["surv"] for r in V.km_at(curve, [], [0.0, 2.0, 3.0, 6.0, 99.0]).collect()}
    assert at == {0.0: 1.0, 2.0: pytest.approx(0.75), 3.0: pytest.approx(0.75), 6.0: 0.0, 99.0: 0.0}
    assert V.km_at(curve, [], [99.0], extend=False).first()["surv"] is None
    assert V.rmst(curve, [], 5.0).first()["rmst"] == pytest.approx(2 + 3 * 0.75)


def test_logrank_is_symmetric_and_null_for_equal_groups(spark):
    rows = [(g, t, e) for t, e in [(1, True), (2, False), (3, True), (5, True)] for g in ("a", "b")]
    df = spark.createDataFrame(rows, "g STRING, time INT, event BOOLEAN")
    out = V.logrank(df, "g", ["a", "b"]).first()
    assert out["chisq"] == pytest.approx(0) and out["p"] == pytest.approx(1, abs=1e-6) and out["observed_1"] == 3
    skew = spark.createDataFrame(rows + [("a", 1, True)] * 3, "g STRING, time INT, event BOOLEAN")
    x, y = V.logrank(skew, "g", ["a", "b"]).first(), V.logrank(skew, "g", ["b", "a"]).first()
    assert x["chisq"] == pytest.approx(y["chisq"]) and x["expected_1"] == pytest.approx(y["expected_2"])


@pytest.mark.parametrize("z,p", [(0.0, 1.0), (1.0, 0.3173105), (1.959964, 0.05), (4.0, 6.33425e-5)])
def test_normal_tail(spark, z, p):
    assert spark.range(1).select(V.normal_two_sided(F.lit(z)).alias("p")).first()["p"] == pytest.approx(p, rel=1e-5)


def test_interpolation_inside_outside_and_clamped(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 0.5), (1, 40.0, 0.1)], "pid INT, time DOUBLE, surv DOUBLE")
    taus = [5.0, 10.0, 15.0, 20.0, 30.0, 40.0, 50.0]
    plain = {r["tau"]: r["pred"] for r in V.interpolate_at(df, ["pid"], taus).collect()}
    assert plain == {5.0: None, 10.0: 1.0, 15.0: 0.75, 20.0: 0.5, 30.0: pytest.approx(0.3), 40.0: 0.1, 50.0: None}
    clamped = {r["tau"]: r["pred"] for r in V.interpolate_at(df, ["pid"], taus, clamp=True).collect()}
    assert clamped[5.0] == 1.0 and clamped[50.0] == 0.1 and clamped[30.0] == pytest.approx(0.3)
    arrays = df.groupBy("pid").agg(F.array_sort(F.collect_list("surv")).alias("s")).select(F.reverse("s").alias("s"))
    for tau in taus:
        for clamp, ref in ((False, plain), (True, clamped)):
            got = arrays.select(V.curve_at(F.col("s"), [10.0, 20.0, 40.0], tau, clamp).alias("x")).first()["x"]
            assert got is None if ref[tau] is None else got == pytest.approx(ref[tau])


def brute_concordance(rows):
    pairs = conc = tied = 0
    for ti, ei, ri in rows:
        for tj, ej, rj in rows:
            if ei and (ti < tj or (ti == tj and not ej)):
                pairs, conc, tied = pairs + 1, conc + (ri > rj), tied + (ri == rj)
    return pairs, conc, tied


@pytest.mark.parametrize("block_rows", [5, 1 << 20])
@pytest.mark.parametrize("kind", ["INT", "DOUBLE", "negative", "BIGINT"])
def test_concordance_against_all_pairs(spark, block_rows, kind):
    rng = random.Random(11)
    rows = [(rng.randint(0, 25), rng.random() < 0.6, rng.randint(0, 12) / 10) for _ in range(150)]
    rows += [(7, False, 0.3)] * 60  # a third of all rows are copies
    if kind == "DOUBLE":
        rows = [(t / 2, e, r) for t, e, r in rows]
    if kind == "negative":
        rows, kind = [(t - 12, e, r) for t, e, r in rows], "INT"
    if kind == "BIGINT":  # a span that no long holds
        rows = [((t - 12) << 59, e, r) for t, e, r in rows]
    df = spark.createDataFrame(rows, f"time {kind}, event BOOLEAN, risk DOUBLE")
    out = M.concordance(df, block_rows=block_rows).first()
    pairs, conc, tied = brute_concordance(rows)
    assert (out["pairs"], out["concordant"], out["tied"]) == (pairs, conc, tied)
    assert out["c_index"] == pytest.approx((conc + tied / 2) / pairs)


def test_concordance_of_an_empty_table(spark):
    for kind in ("INT", "DOUBLE"):
        df = spark.createDataFrame([], f"grp INT, time {kind}, event BOOLEAN, risk DOUBLE")
        assert M.concordance(df, ["grp"]).count() == 0


def test_concordance_of_negated_risk(spark):
    rows = [(t, t % 3 != 0, (t * 7 % 31) + t / 100) for t in range(1, 40)]
    df = spark.createDataFrame(rows, "time INT, event BOOLEAN, risk DOUBLE")
    a = M.concordance(df).first()["c_index"]
    b = M.concordance(df.withColumn("risk", -F.col("risk"))).first()["c_index"]
    assert a == pytest.approx(1 - b)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(13)
    surv = [(i, rng.randint(1, 50), rng.random() < 0.5) for i in range(200)]
    risk = [(i, 25.0, round(rng.random(), 2)) for i in range(200)]
    s = spark.createDataFrame(surv, "pid INT, time INT, event BOOLEAN")
    return surv, risk, s, spark.createDataFrame(risk, "pid INT, tau DOUBLE, risk DOUBLE")


def brute_weights(surv, tau):
    times = sorted({t for _, t, _ in surv})
    g, before, after = 1.0, {}, {}
    for t in times:
        before[t] = g
        d = sum(x == t and e for _, x, e in surv)
        c = sum(x == t and not e for _, x, e in surv)
        r = sum(x >= t for _, x, _ in surv) - d
        g *= 1 - c / r if r else 1.0
        after[t] = g
    g_tau = after[max(t for t in times if t <= tau)]
    return {p: (1 / before[t], "case") if e and t <= tau else ((1 / g_tau, "control") if t > tau else (0.0, "none")) for p, t, e in surv}


def test_auc_and_brier_against_brute_force(scored):
    surv, risk, s, r = scored
    weights = brute_weights(surv, 25)
    by = {p: x for p, _, x in risk}
    num = den = 0.0
    for i, (wi, ki) in weights.items():
        for j, (wj, kj) in weights.items():
            if ki == "case" and kj == "control":
                den += wi * wj
                num += wi * wj * ((by[i] > by[j]) + 0.5 * (by[i] == by[j]))
    w = M.ipcw(r, s, [25.0])
    for block_rows in (4, 1 << 20):
        assert M.td_auc(w, ["tau"], block_rows=block_rows).first()["auc"] == pytest.approx(num / den)
    assert M.td_auc(w.withColumn("risk", F.pow("risk", F.lit(3.0)) + 1), ["tau"]).first()["auc"] == pytest.approx(num / den)
    ref = np.mean([v * ((1 - by[p]) ** 2 if k == "case" else by[p] ** 2) for p, (v, k) in weights.items()])
    assert M.brier(w, ["tau"]).first()["brier"] == pytest.approx(ref)


def test_roc_ends_at_one_and_its_area_is_the_auc(scored):
    _, _, s, r = scored
    w = M.ipcw(r, s, [25.0])
    points = sorted((x["fpr"], x["tpr"]) for x in M.td_roc(w, ["tau"]).collect())
    assert points[-1] == (pytest.approx(1), pytest.approx(1))
    path = [(0.0, 0.0), *points]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(path, path[1:]))
    assert area == pytest.approx(M.td_auc(w, ["tau"]).first()["auc"])


def test_brier_without_censoring_is_the_mean_squared_error(spark):
    surv = spark.createDataFrame([(i, i + 1, True) for i in range(10)], "pid INT, time INT, event BOOLEAN")
    risk = spark.createDataFrame([(i, 5.0, i / 10) for i in range(10)], "pid INT, tau DOUBLE, risk DOUBLE")
    ref = np.mean([((1 if i + 1 <= 5 else 0) - i / 10) ** 2 for i in range(10)])
    out = M.brier_ipa(M.ipcw(risk, surv, [5.0]), surv, ["tau"], [5.0]).first()
    assert out["brier"] == pytest.approx(ref) and out["null_brier"] == pytest.approx(0.25) and out["ipa"] == pytest.approx(1 - ref / 0.25)


def test_quantile_strata_keep_ties_together(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.1] * 10 + [0.2, 0.3, 0.4, 0.5])], "pid INT, pred DOUBLE")
    out = M.quantile_strata(df, [], "pred", 4).groupBy("pred").agg(F.count_distinct("stratum").alias("k")).collect()
    assert all(r["k"] == 1 for r in out)


def test_bh_adjustment(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.2, 0.04]
    m = len(p)
    order = np.argsort(p)
    ref, best = [0.0] * m, 1.0
    for rank in range(m, 0, -1):
        best = min(best, p[order[rank - 1]] * m / rank)
        ref[order[rank - 1]] = best
    out = B.adjust_bh(spark.createDataFrame(list(enumerate(p)), "id INT, p DOUBLE"), "p", ["id"]).orderBy("id").collect()
    assert [r["p_adjusted"] for r in out] == pytest.approx(ref)


def test_bootstrap_is_paired_and_reproducible(spark, scored):
    _, _, s, r = scored
    both = r.withColumn("model", F.lit("a")).unionByName(r.withColumn("model", F.lit("b")))
    w = M.ipcw(both, s, [25.0])
    out = B.contrast(w, "a", "brier", n=20).first()
    assert (out["delta"], out["lower"], out["upper"]) == (0.0, 0.0, 0.0)
    one = B.bootstrap_mean(r, ["tau"], "risk", "pid", 50).first()
    two = B.bootstrap_mean(r.repartition(7), ["tau"], "risk", "pid", 50).first()
    assert one["lower"] < one["estimate"] < one["upper"] and one["lower"] == pytest.approx(two["lower"])


def test_poisson_weights_have_mean_and_variance_one(spark):
    rows = B.with_replicates(spark.range(2000).withColumnRenamed("id", "pid"), "pid", 10)
    total = rows.where("replicate > 0").agg(F.sum("w_boot").alias("s"), F.sum(F.col("w_boot") * F.col("w_boot")).alias("q")).first()
    assert total["s"] / 20000 == pytest.approx(1, abs=0.03) and total["q"] / 20000 == pytest.approx(2, abs=0.1)


def test_external_horizons(spark):
    row = M.align_external(spark.createDataFrame([(1, 183.0, 25.0)], "pid INT, time DOUBLE, value DOUBLE")).first()
    assert (row["tau"], row["risk"], row["surv"]) == (182.5, 0.25, 0.75)


@pytest.mark.parametrize("risk_rows, limit", [(3, 1 << 22), (1 << 17, 1 << 22), (3, 0)])
def test_concordance_in_blocks_of_risks(spark, monkeypatch, risk_rows, limit):
    monkeypatch.setattr(M, "RISK_ROWS", risk_rows)
    monkeypatch.setattr(M, "BLOCK_LIMIT", limit)
    rows = [(i * 7 % 23, i % 3 == 0, round((i * 37 % 41) / 41, 3), g) for g in ("a", None) for i in range(90 if g else 40)]
    df = spark.createDataFrame(rows, "time long, event boolean, risk double, grp string")
    found = {r["grp"]: r for r in M.concordance(df, ["grp"], block_rows=5).collect()}
    assert len(found) == 2
    for g, r in found.items():
        assert (r["pairs"], r["concordant"], r["tied"]) == brute_concordance([x[:3] for x in rows if x[3] == g])


def test_concordance_shuffles_no_row_for_each_bit_of_the_time(spark):
    df = spark.createDataFrame([(i % 1000, i % 2 == 0, i / 7) for i in range(4000)], "time long, event boolean, risk double")
    sent = []
    whole = M._cells_of_times

    def counted(base, *rest):
        sent.append(base.count())
        return whole(base, *rest)
    M._cells_of_times = counted
    try:
        M.concordance(df).collect()
    finally:
        M._cells_of_times = whole
    assert sent == [1000]  # times and events of one block, where the risks have 4000 values
