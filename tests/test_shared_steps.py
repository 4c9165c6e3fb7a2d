"""Steps that several branches of a query share are worked out once, and over all cores."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspan.operators import attribution as A
from vitalspan.operators import hazard as Z
from vitalspan.operators import resample as B
from vitalspan.plans import attribution_queries
from vitalspan.plans.views import v_attributions

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_of_keys_are_worked_out_once_a_key_over_all_tasks(spark):
    rows = spark.createDataFrame([(i % 40, m) for i in range(80) for m in ("a", "b")] + [(None, "a")], "pid long, model string")
    weights = B.key_weights(rows, "pid", 30)
    assert weights.rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = {r["_key"]: r["_weights"] for r in weights.collect()}
    assert len(found) == 41 == weights.count()
    for key, text in found.items():
        heads = [f"{key}:{r}" if key is not None else str(r) for r in range(1, 31)]
        uniform = [int(hashlib.md5(h.encode()).hexdigest()[:12], 16) / 2**48 for h in heads]
        assert text == "1" + "".join(chr(48 + sum(u >= p for p in B.POISSON_CDF)) for u in uniform)


@pytest.mark.parametrize("rows_at_once", [1 << 15, 7])
def test_weighted_sums_are_those_of_the_copies(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(B, "SUMMED_ROWS", rows_at_once)
    rows = spark.createDataFrame(
        [(i, m, None if i % 9 == 0 else (float("inf") if i == 50 and m == "b" else i / 7)) for i in range(60) for m in ("a", "b", None)] + [(100, "c", None)],
        "pid long, model string, x double")
    key = lambda r: (str(r["model"]), r["replicate"])
    got = {key(r): (r["x"], r["_weight"]) for r in B.weighted_sums(B.with_weights(rows, "pid", 20), ["model"], ["x"], 20).collect()}
    want = B.with_replicates(rows, "pid", 20).groupBy("model", "replicate").agg(
        F.coalesce(F.sum(F.col("x") * F.col("w_boot")), F.lit(0.0)).alias("x"), F.sum("w_boot").alias("w")).collect()
    assert set(got) == {key(r) for r in want}
    for r in want:
        assert np.allclose(got[key(r)], (r["x"], r["w"]))
    means = {str(r["model"]): r["estimate"] for r in B.bootstrap_mean(rows, ["model"], "x", "pid", 5).collect()}
    assert means["c"] is None and means["b"] == float("inf")


def test_levels_and_top_features_read_settled_rows(spark):
    values = A.level_values(A.collapse_one_hot(v_attributions(spark, FOLDER)))
    assert "lineitem" not in plan(values) and "collect_list" not in plan(values)
    assert "lineitem" not in plan(attribution_queries.top_feature_rows(spark, FOLDER))


@pytest.mark.parametrize("query", ["tri_state_labs", "study_005", "study_006", "study_007", "assemble_features"])
def test_events_are_settled_where_they_are_made(spark, query):
    from vitalspan.plans import load_entries

    text = plan(load_entries()[query].run(spark, FOLDER))
    assert "lineitem" not in text


def test_labelled_rows_are_fitted_without_a_join(spark):
    rows = spark.createDataFrame([(i, [float(i % 3)], [i % 2 == 0, False], [i % 2 == 1, i % 4 == 1]) for i in range(60)],
                                 "pid long, features array<double>, died array<boolean>, survived array<boolean>")
    assert "Join" not in plan(Z.rows_of_labelled(rows, 2, 1))
    model = Z.fit_labelled(rows, [0.0, 1.0, 2.0], ["x"], reg=0.01)
    apart = Z.fit_hazard(rows.select("pid", "features"), rows.drop("features"), [0.0, 1.0, 2.0], ["x"], reg=0.01)
    assert np.allclose(model.weights, apart.weights, atol=1e-6)
    assert np.isclose(Z.labelled_loss(model, rows).first()["nll"], Z.model_loss(model, rows.select("pid", "features"), rows.drop("features")).first()["nll"])


def test_order_lines_meet_their_patients_once(spark, monkeypatch):
    from vitalspan.operators.features import STUDIES
    from vitalspan.plans import feature_queries, views

    made, read = [], views.table
    monkeypatch.setattr(views, "table", lambda s, sf, name: (made.append(name), read(s, sf, name))[1])
    shared = feature_queries.sources(spark, FOLDER, STUDIES["007"])
    assert made.count("lineitem") == 1 and "Aggregate" not in plan(shared["polygenic_scores"])
    apart = {"biochem": feature_queries.lab_events(spark, FOLDER), "diagnoses": feature_queries.diagnosis_events(spark, FOLDER),
             "nomesco": feature_queries.proc_events(spark, FOLDER), "clinicaltwo": feature_queries.clinical_two_table(spark, FOLDER)}
    for name, rows in apart.items():
        columns = rows.columns
        assert sorted(map(str, shared[name].select(columns).collect())) == sorted(map(str, rows.collect())), name


def test_values_are_carried_to_the_index_without_a_sort(spark):
    import datetime as dt

    from vitalspan.operators import cohort as C

    days = [dt.date(1950, 1, 1), dt.date(2010, 1, 2), dt.date(2010, 1, 2), dt.date(2010, 1, 2), None, dt.date(2031, 1, 1)]
    entries = [2**62, -(2**62), 5, 2**62, 1, -(2**62)]
    rows = spark.createDataFrame([(1, d, e, x, y) for d, e, x, y in zip(days, entries, [1.0, 2.0, None, 4.0, 5.0, 6.0], [None, None, None, 7, 8, 9])],
                                 "pid long, d date, e long, x double, y int").withColumns({"_d": F.lit(days[2]), "_e": F.lit(5).cast("long")})
    out = C.filled_at_index(rows, "pid", ["d", "e"], ["_d", "_e"], ["x", "y"])
    assert "SortAggregate" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [(1, 2.0, 7)]
    assert C.filled_at_index(rows.where("e <> 5"), "pid", ["d", "e"], ["_d", "_e"], ["x", "y"]).count() == 0


@pytest.mark.parametrize("study", ["005", "012"])
def test_studies_read_order_lines_once(spark, monkeypatch, study):
    from vitalspan.operators.features import STUDIES
    from vitalspan.plans import feature_queries, views

    made, read = [], views.table
    monkeypatch.setattr(views, "table", lambda s, sf, name: (made.append(name), read(s, sf, name))[1])
    feature_queries.sources(spark, FOLDER, STUDIES[study])
    assert made.count("lineitem") == 1
