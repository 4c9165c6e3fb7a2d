"""Registered queries against their SQL on DuckDB. All of them with VITALSPAN_ALL=1, otherwise a cross-section."""
import math
import os

import duckdb
import pytest

from vitalspan.plans import load_entries

FOLDER = os.environ.get("VITALSPAN_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "part", "orders", "lineitem", "events"]
SECTION = [
    "km_by_risk_group", "cohort_attrition", "baseline_table", "diagnosis_rollup_common", "lab_flags", "procedure_codes_common", "closest_vital",
    "tri_state_labs", "clinical_features_1", "polygenic_features", "person_period_labels", "risk_score", "concordance", "td_auc", "calibration_20",
    "contrast_brier", "adjust_bh", "global_importance", "collapse_one_hot", "force_contribution", "fingerprint_matches", "ablate_features",
    "interval_join_modes", "prevalence_masked", "long_predictions",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def names():
    checked = [n for n, e in load_entries().items() if e.sql]
    return checked if os.environ.get("VITALSPAN_ALL") else [n for n in checked if n in SECTION]


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    entry = load_entries()[name]
    df = entry.run(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted("|".join(map(normal, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = duck.execute(entry.sql)
    have = [c[0] for c in cursor.description]
    assert sorted(have) == columns
    order = [have.index(c) for c in columns]
    assert got == sorted("|".join(normal(r[i]) for i in order) for r in cursor.fetchall())


def test_every_blueprint_operator_is_covered():
    """Each operator id of the inventory is exercised by at least one query."""
    wanted = {
        "A": 14, "B": 28, "C": 19, "D": 25, "E": 13, "F": 4, "G": 4, "H": 28, "I": 21, "J": 6, "K": 11, "M": 6}
    covered = {c for e in load_entries().values() for c in e.covers.split()}
    missing = [f"{k}{i}" for k, n in wanted.items() for i in range(1, n + 1) if f"{k}{i}" not in covered]
    assert missing == []


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
