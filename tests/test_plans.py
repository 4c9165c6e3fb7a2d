"""How the planner joins rows whose number it cannot know."""
import re

import pytest

from vitalspan.operators import joins as J
from vitalspan.plans.survival_queries import external_scores, weighted
from vitalspan.plans.views import v_continuous, v_patients, v_predictions, v_surv
from vitalspan.sources import writers

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("source", [v_predictions, v_continuous, external_scores])
def test_exploded_rows_are_not_broadcast(spark, source):
    """The tables here are far below any threshold, as a small file of many rows is."""
    text = plan(source(spark, FOLDER).join(v_surv(spark, FOLDER).select("pid", "event"), "pid"))
    assert "BroadcastExchange" not in text and "SortMergeJoin [pid" in text


def test_patients_are_not_broadcast(spark):
    assert "Broadcast" not in plan(v_patients(spark, FOLDER))


def test_weights_meet_by_patient_in_a_sort_merge_join(spark):
    text = plan(weighted(spark, FOLDER, [365.0, 730.0]))
    assert re.search(r"SortMergeJoin \[pid", text) and not re.search(r"BroadcastHashJoin \[pid", text)


def test_aligned_keys_are_not_broadcast(spark):
    wanted = J.with_values(spark.range(5).withColumnRenamed("id", "pid"), "time", [1.0, 2.0])
    given = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, None)], "pid long, time double, surv double")
    out = J.align_to(given, wanted, ["pid", "time"], {"surv": 0.0})
    assert "Broadcast" not in plan(out)
    assert out.count() == 10 and out.where("surv IS NULL").count() == 1 and out.where("surv = 0").count() == 8


def test_wide_predictions_group_once(spark):
    """One aggregation by patient and model, and one shuffle, that of the patients before their rows are made."""
    text = plan(writers.wide_predictions(v_predictions(spark, FOLDER), [20.0, 100.0], keys=("pid", "model")))
    assert text.count("Exchange") == 1 and "pivotfirst" not in text.lower()
    assert not re.search(r"keys=\[[^\]]*time", text)
