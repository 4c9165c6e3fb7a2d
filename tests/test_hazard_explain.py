"""Attribution and ablation over sparse rows against the dense operators."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspan.operators import hazard as Z
from vitalspan.operators import hazard_explain as E
from vitalspan.operators import hazard_search as S

WIDTH = 5
MODEL = Z.HazardModel([0.0, 1.0, 2.0, 4.0], [f"f{j}" for j in range(WIDTH)], np.random.default_rng(3).normal(0, 0.6, (3, WIDTH + 1)))


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((70, WIDTH)) < [0.2, 0.8, 0.5, 0.0, 0.9], rng.normal(1, 1, (70, WIDTH)).round(1), 0.0)
    long = spark.createDataFrame([(p, f"f{j}", float(v)) for p, row in enumerate(x) for j, v in enumerate(row) if v], "pid long, feature string, value double")
    vocabulary = spark.createDataFrame([(f"f{j}", j) for j in range(WIDTH)], "feature string, column_index int")
    everyone = spark.createDataFrame([(p, p % 3 == 0, ["a", "b", None][p % 3]) for p in range(70)], "pid long, train boolean, s string")
    dense = spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(x)], "pid long, features array<double>")
    return x, S.sparse_cells(long, vocabulary, everyone), dense


def test_medians(people):
    x, rows, _ = people
    assert E.sparse_medians(rows, WIDTH + 1) == pytest.approx([1, *np.median(x, axis=0)])
    assert E.sparse_medians(rows.where("pid < 1"), WIDTH + 1) == pytest.approx([1, *x[0]])


def test_summary_of_the_dense_ablation(spark, people):
    x, rows, dense = people
    medians = E.sparse_medians(rows.where("train"), WIDTH + 1)
    groups = {"f0": [1], "f1": [2], "none": [4], "pair": [3, 5]}
    got = {(r.s, r.feature, r.tau): r for r in E.ablation_summary(MODEL, rows.repartition(4), medians, groups, (1.5, 3.0, 9.0), ["s"]).collect()}
    plain = Z.ablate_features(MODEL, dense, list(medians[1:]), {n: [p - 1 for p in at] for n, at in groups.items()}, (1.5, 3.0, 9.0)).toPandas()
    full = plain[plain.feature == "full"].set_index(["pid", "tau"]).surv
    plain["delta"] = plain.surv - full.reindex(list(zip(plain.pid, plain.tau))).to_numpy()
    plain["s"] = [["a", "b", None][p % 3] for p in plain.pid]
    assert len(got) == 3 * 4 * 3
    for (s, feature, tau), r in got.items():
        own = plain[(plain.feature == feature) & (plain.tau == tau) & (plain.pid % 3 == ["a", "b", None].index(s))].delta
        if tau == 9.0:
            assert r.mean_delta is None and r.mean_abs_delta is None
        else:
            assert r.n == len(own) and r.mean_delta == pytest.approx(own.mean(), abs=1e-12) and r.mean_abs_delta == pytest.approx(own.abs().mean(), abs=1e-12)
    assert E.ablation_summary(MODEL, rows.where("false"), medians, groups).count() == 0


def test_drawn_backgrounds_add_up(spark, people):
    x, rows, dense = people
    training, test = rows.where("train"), rows.where("NOT train")
    out = E.attribute_drawn(MODEL, test, training, 3.0, draws=30, steps=60).toPandas()
    ranks = {r["rank"]: r["pid"] for r in E.ranked_by_hash(training).collect()}
    assert sorted(ranks) == list(range(24))
    curve = lambda v: np.cumprod(1 - 1 / (1 + np.exp(-(MODEL.weights[:, 0] + MODEL.weights[:, 1:] @ v))))[1:].mean()
    from vitalspan.operators.resample import hashed_uniform
    draws = spark.range(70).selectExpr("id AS pid").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("u", hashed_uniform("pid", "j")).toPandas()
    met = set()
    for p in range(70):
        if p % 3:
            own = [ranks[int(u * 24)] for u in draws[draws.pid == p].u]
            met |= {*own}
            base = np.mean([curve(x[b]) for b in own])
            assert out[out.pid == p].shap.sum() == pytest.approx(curve(x[p]) - base, abs=1e-4)
            assert {r.feature: r.vals for r in out[(out.pid == p) & (out.vals != 0)].itertuples()} == {f"f{j}": v for j, v in enumerate(x[p]) if v}
    assert met == {*ranks.values()}  # every training row is somebody's background
