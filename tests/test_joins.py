import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitalspan.operators import joins as J
from vitalspan.operators.events import flag_lab_results


def day(text):
    return dt.date.fromisoformat(text) if text else None


@pytest.mark.parametrize("mode,kept", [
    ("no_key_only", ["absent", "valid", "open"]), ("drop", ["valid", "open"]), ("keep", ["absent", "expired", "open", "valid"])])
def test_interval_join_filters_after_the_left_join(spark, mode, kept):
    events = spark.createDataFrame([("absent", "Z", day("2005-01-01")), ("valid", "A", day("2005-01-01")), ("expired", "A", day("2011-01-01")), ("open", "B", day("2050-01-01"))], "id STRING, code STRING, d DATE")
    lookup = spark.createDataFrame([("A", day("2000-01-01"), day("2010-01-01"), 1), ("B", None, None, 2)], "code STRING, f DATE, t DATE, v INT")
    out = J.interval_join(events, lookup, ["code"], [("d", "f", "t")], mode)
    assert sorted(r["id"] for r in out.collect()) == sorted(kept)


def _valid(x, lo, hi):
    """BETWEEN in three-valued logic, unknown as true."""
    low = None if x is None or lo is None else lo <= x
    high = None if x is None or hi is None else x <= hi
    return low is not False and high is not False


@pytest.mark.parametrize("kind", ["double", "date", "string", "timestamp"])
def test_interval_join_against_all_pairs(spark, kind):
    rng = random.Random(4)
    make = {"double": float, "date": lambda x: dt.date(2000, 1, 1) + dt.timedelta(x), "string": lambda x: f"v{x:05d}",
            "timestamp": lambda x: dt.datetime(2000, 1, 1) + dt.timedelta(hours=x)}[kind]
    def bound(x):
        return None if rng.random() < 0.1 else make(x)
    lookup = []
    for i in range(150):
        a = rng.randrange(2000)
        lookup.append((rng.choice(["a", "a", "b", None]), bound(a), bound(a + rng.choice([-3, 0, 0, 1, 5, 40, 700, 5000])), i, rng.choice([None, 1, 2])))
    events = [(rng.choice(["a", "a", "b", "none", None]), None if rng.random() < 0.05 else make(rng.randrange(-50, 2500)), rng.randrange(4), rng.randrange(3)) for _ in range(300)]
    events += events[:20]  # equal rows count each
    left = spark.createDataFrame(events, f"k STRING, x {kind}, z INT, e INT")
    right = spark.createDataFrame(lookup, f"k STRING, lo {kind}, hi {kind}, v INT, top INT")
    pairs = [[r[3] for r in lookup if e[0] is not None and r[0] == e[0] and _valid(e[1], r[1], r[2]) and _valid(e[2], None, r[4])] for e in events]
    has_key = [e[0] in {r[0] for r in lookup if r[0]} for e in events]
    want = {
        "drop": [(e, v) for e, vs in zip(events, pairs) for v in vs],
        "no_key_only": [(e, v) for e, vs, k in zip(events, pairs, has_key) for v in (vs if k else [None])],
        "keep": [(e, v) for e, vs in zip(events, pairs) for v in vs or [None]]}
    for mode, rows in want.items():
        got = J.interval_join(left, right.withColumn("low_top", F.lit(None).cast("int")), ["k"], [("x", "lo", "hi"), ("z", "low_top", "top")], mode).collect()
        assert sorted(repr(((r.k, r.x, r.z, r.e), r.v)) for r in got) == sorted(map(repr, rows))


def test_interval_join_of_a_key_with_a_million_intervals(spark):
    """Events of one key meet the few intervals of their cells: narrow ones, wide ones and half-open ones."""
    n = 1_000_000
    i = F.col("id")
    high = F.when(i % 1000 == 0, i + 20_000).when(i % 250_000 != 1, i + 1)
    lookup = spark.range(n).select(F.lit("k").alias("k"), i.cast("double").alias("lo"), high.cast("double").alias("hi"), i.alias("v"))
    events = spark.range(0, n, 100).select(F.lit("k").alias("k"), (i + 0.5).alias("x"))
    found = J.interval_join(events, lookup, ["k"], [("x", "lo", "hi")], "drop")
    got = {r.x: r.n for r in found.groupBy("x").agg(F.count("*").alias("n")).collect()}
    open_ended = [1, 250_001, 500_001, 750_001]
    for e in range(0, n, 100):
        wide = sum(1 for w in range(max(0, (e - 20_000) // 1000 * 1000), e + 1, 1000) if w <= e + 0.5 <= w + 20_000)
        assert got[e + 0.5] == wide + (e % 1000 != 0) + sum(o < e for o in open_ended)


def test_one_sided_flags_and_age_window(spark):
    patients = spark.createDataFrame([(1, day("2010-01-10"), 50.0, True)], "pid BIGINT, index_date DATE, age DOUBLE, sex BOOLEAN")
    cases = {"low1": (10.0, None, 5.0), "high1": (None, 40.0, 50.0), "two_low": (10.0, 40.0, 5.0), "inside": (10.0, 40.0, 20.0), "none": (None, None, 5.0), "late": (10.0, None, 5.0)}
    tests = spark.createDataFrame(
        [(1, q, day("2010-01-12") if q == "late" else day("2010-01-11"), r, lo, hi, 1) for q, (lo, hi, r) in cases.items()],
        "pid BIGINT, qid STRING, drawn_date DATE, result DOUBLE, ref_lower DOUBLE, ref_upper DOUBLE, test_id BIGINT")
    lookup = spark.createDataFrame([], "npu_code STRING, sex BOOLEAN, refint_1 DOUBLE, refint_2 DOUBLE, valid_from DATE, valid_to DATE, age_from_days DOUBLE, age_to_days DOUBLE")
    out = {r["qid"]: (r["value"], r["time"]) for r in flag_lab_results(tests, patients, lookup).collect()}
    assert out == {"low1": (-1, -1), "high1": (1, -1), "two_low": (1, -1), "inside": (0, -1)}


def test_limit_type_hides_the_other_limit(spark):
    patients = spark.createDataFrame([(1, day("2010-01-10"), 50.0, True)], "pid BIGINT, index_date DATE, age DOUBLE, sex BOOLEAN")
    tests = spark.createDataFrame([(1, "Q", day("2010-01-01"), 5.0, 10.0, 40.0, "upper_limit", 1)], "pid BIGINT, qid STRING, drawn_date DATE, result DOUBLE, ref_lower DOUBLE, ref_upper DOUBLE, ref_type STRING, test_id BIGINT")
    lookup = spark.createDataFrame([], "npu_code STRING, sex BOOLEAN, refint_1 DOUBLE, refint_2 DOUBLE, valid_from DATE, valid_to DATE, age_from_days DOUBLE, age_to_days DOUBLE")
    assert flag_lab_results(tests, patients, lookup).first()["value"] == 0


@pytest.mark.parametrize("offsets,best", [
    ([-90.0, -1.0, 0.5], 0.5), ([-1.0, 0.0, 22.0], 0.0), ([1.5, 21.0], 1.5), ([1.0, -2.0], 1.0), ([-91.0, 22.0], None), ([1.5, -89.0], -89.0)])
def test_closest_event_prefers_the_past_with_one_day_of_grace(spark, offsets, best):
    events = spark.createDataFrame([(1, o, o) for o in offsets], "pid INT, t DOUBLE, v DOUBLE")
    row = J.nearest_before_else_after(events, ["pid"], "t", -90, 21, ["v"]).first()
    assert (row["v"] if row else None) == best


def test_closest_of_equal_events_does_not_depend_on_their_order(spark):
    """Two lines of one order may have the same number and day, and so the same tie-break."""
    found = set()
    for values in ([30.0, None, 6.0], [6.0, 30.0, None], [None, 6.0, 30.0]):
        events = spark.createDataFrame([(1, 0.0, 7, v) for v in values], "pid INT, t DOUBLE, id INT, v DOUBLE").coalesce(1)
        found.add(J.nearest_before_else_after(events, ["pid"], "t", -90, 21, ["v"], ["id"]).first()["v"])
    assert found == {6.0}


def test_nearest_lookup_takes_the_lower_value_on_a_tie(spark):
    lookup = spark.createDataFrame([("t", 10.0, 1.0), ("t", 20.0, 2.0), ("u", 0.0, 9.0)], "term STRING, at DOUBLE, points DOUBLE")
    rows = spark.createDataFrame([("t", 15.0), ("t", 15.1), ("t", -5.0), ("t", 99.0), ("t", None), ("w", 1.0)], "term STRING, x DOUBLE")
    out = J.nearest_lookup_join(rows, "x", lookup, ["term"], "at", "points").collect()
    found = {(r["term"], r["x"]): r["points"] for r in out}
    assert found == {("t", 15.0): 1.0, ("t", 15.1): 2.0, ("t", -5.0): 1.0, ("t", 99.0): 2.0, ("t", None): None, ("w", 1.0): None}


def test_nearest_lookup_against_brute_force(spark):
    rng = random.Random(8)
    points = [(k, rng.randrange(200) / 2, rng.randrange(5)) for k in "ab" for _ in range(40)]
    rows = [(k, rng.randrange(-20, 240) / 2) for k in "abc" for _ in range(60)] + [("a", None), (None, 1.0)]
    out = J.nearest_lookup_join(spark.createDataFrame(rows, "k STRING, x DOUBLE"), "x", spark.createDataFrame(points, "k STRING, at DOUBLE, o INT"), ["k"], "at", "o")
    best = lambda k, x: None if x is None else min(((abs(a - x), a, o) for q, a, o in points if q == k), default=(0, 0, None))[2]
    assert sorted(map(repr, map(tuple, out.select("k", "x", "o").collect()))) == sorted(repr((k, x, best(k, x))) for k, x in rows)


def test_bracket_join(spark):
    brackets = spark.createDataFrame([(0.0, 7.0, "a"), (7.0, 27.0, "b"), (30.0, 40.0, "c"), (240.0, None, "d")], "`from` DOUBLE, `to` DOUBLE, band STRING")
    rows = spark.createDataFrame([(v,) for v in (0.0, 0.1, 7.0, 7.5, 28.0, 40.0, 240.0, 241.0, None, 7.0)], "x DOUBLE")
    out = sorted(((r["x"], r["band"]) for r in J.bracket_join(rows, "x", brackets, "band").collect()), key=str)
    assert out == sorted([(0.0, None), (0.1, "a"), (7.0, "a"), (7.0, "a"), (7.5, "b"), (28.0, None), (40.0, "c"), (240.0, None), (241.0, "d"), (None, None)], key=str)


def test_bracket_join_with_open_and_many_brackets(spark):
    rows = spark.range(-5, 10_005).select((F.col("id") / 1).alias("x"), F.col("id").alias("_at0"))
    many = spark.range(10_000).select(F.col("id").cast("double").alias("from"), (F.col("id") + 1.0).alias("to"), F.col("id").alias("band"))
    opened = many.unionByName(spark.createDataFrame([(None, 0.0, -1), (10_000.0, None, -2)], "`from` DOUBLE, `to` DOUBLE, band BIGINT"))
    out = {int(r["x"]): r["band"] for r in J.bracket_join(rows, "x", opened, "band").collect()}
    assert out == {x: -1 if x <= 0 else -2 if x > 10_000 else x - 1 for x in range(-5, 10_005)}
    none = J.bracket_join(rows, "x", many.limit(0), "band")
    assert dict(none.dtypes)["band"] == "bigint" and none.where("band IS NOT NULL").count() == 0


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(3)
    held = {p: {(f"f{i}", rng.randint(0, 1)) for i in range(8) if rng.random() < 0.8 or i == 0} for p in range(60)}
    held[40_000] = set(held[1])  # another bitmap chunk
    prints = {p: set(sorted(s)[:3]) for p, s in held.items()}
    items = spark.createDataFrame([(p, f, v) for p, s in held.items() for f, v in s], "pid BIGINT, f STRING, v INT")
    top = spark.createDataFrame([(p, f, v) for p, s in prints.items() for f, v in s], "pid BIGINT, f STRING, v INT")
    out = {r["pid"]: r["n_matches"] for r in J.fingerprint_matches(items, "pid", top, ["f", "v"]).collect()}
    want = {p: sum(s <= other for other in held.values()) for p, s in prints.items()}
    assert out == want
    kept = J.rows_of_matched(items, "pid", J.fingerprint_matches(items, "pid", top, ["f", "v"]), 3)
    assert {r["pid"] for r in kept.collect()} == {p for p, n in want.items() if n >= 3}


def test_fingerprints_of_frequent_items(spark):
    """Sets of items that nearly everybody holds share the nodes of one trie, so their holders are found once a node."""
    rng = random.Random(6)
    held = {p: {f"f{i}" for i in range(12) if rng.random() < 0.9} for p in range(300)}
    held[999] = set()
    items = spark.createDataFrame([(p, f) for p, s in held.items() for f in s], "pid BIGINT, f STRING")
    out = {r["pid"]: r["n_matches"] for r in J.fingerprint_matches(items, "pid", items, ["f"]).collect()}
    assert out == {p: sum(s <= other for other in held.values()) for p, s in held.items() if s}
    other = spark.createDataFrame([(1, "f0"), (1, "none"), (2, None)], "pid BIGINT, f STRING")
    assert {r["pid"]: r["n_matches"] for r in J.fingerprint_matches(items, "pid", other, ["f"]).collect()} == {1: 0, 2: 0}
    assert J.fingerprint_matches(items, "pid", other.where("false"), ["f"]).count() == 0


def test_fingerprints_in_blocks_of_owners_and_parts_of_sets(spark, monkeypatch):
    """Many blocks, parts and slices of bits; no row is made for a set and its holder."""
    for name, value in (("OWNERS_A_BLOCK", 70), ("SETS_A_PART", 30), ("BIT_WORDS", 12)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(7)
    held = {p: {f"f{i}" for i in range(10) if rng.random() < 0.8} | {"all"} for p in range(400)}
    prints = {p: set(rng.sample(sorted(s), min(len(s), 4))) for p, s in held.items()}
    frame = lambda sets: spark.createDataFrame([(p, f) for p, s in sets.items() for f in s], "pid BIGINT, f STRING")
    out = J.fingerprint_matches(frame(held), "pid", frame(prints), ["f"])
    assert {r["pid"]: r["n_matches"] for r in out.collect()} == {p: sum(s <= other for other in held.values()) for p, s in prints.items()}
    bits = J._count_holders(pa.table({"_owner": [1, 1, 2], "_item": ["a", "b", "a"]}), pa.table({"_id": ["x", "y", "z"], "_set": [["a"], ["a", "b"], ["c"]]}))
    assert bits["_n"].to_pylist() == [2, 1, 0]


def test_fingerprints_write_each_item_and_set_once(spark, monkeypatch):
    """However many blocks meet however many parts: an owner's items and a set are packed once, and the product is not dealt."""
    for name, value in (("OWNERS_A_BLOCK", 60), ("SETS_A_PART", 25), ("PACKED_ROWS", 100)):
        monkeypatch.setattr(J, name, value)
    settled = []
    settle = J.settle

    def kept(df, *args, **kwargs):
        settled.append((df._jdf.queryExecution().executedPlan().toString(), out := settle(df, *args, **kwargs)))
        return out

    monkeypatch.setattr(J, "settle", kept)
    rng = random.Random(8)
    held = {p: {f"f{i}" for i in range(12) if rng.random() < 0.6} | {"all"} for p in range(400)}
    prints = {p: set(rng.sample(sorted(s), min(len(s), 4))) for p, s in held.items()}
    frame = lambda sets: spark.createDataFrame([(p, f) for p, s in sets.items() for f in s], "pid BIGINT, f STRING")
    repeated = frame(held).unionAll(frame(held)).repartition(7)  # an owner's rows come from several tasks, and twice
    out = J.fingerprint_matches(repeated, "pid", frame(prints), ["f"])
    assert {r["pid"]: r["n_matches"] for r in out.collect()} == {p: sum(s <= other for other in held.values()) for p, s in prints.items()}
    plans = [plan for plan, _ in settled]
    assert sum("CartesianProduct" in plan for plan in plans) == 1 and not any("Generate explode(sequence" in plan for plan in plans)
    tables = {tuple(df.columns): df for _, df in settled}
    blocks = next(df for columns, df in tables.items() if "_at" in columns).collect()
    parts = next(df for columns, df in tables.items() if "_ids" in columns).collect()
    assert len(blocks) > 3 and sum(r["_n"] for r in blocks) == sum(map(len, held.values()))
    assert len(parts) > 3 and sum(len(r["_ids"]) for r in parts) == 16 * len({frozenset(s) for s in prints.values()})


def test_a_null_owner_holds_and_matches_nothing(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, "b"), (2, "b")], "pid BIGINT, f STRING")
    out = {r["pid"]: r["n_matches"] for r in J.fingerprint_matches(items, "pid", items, ["f"]).collect()}
    assert out == {1: 1, 2: 2, None: 0}


@pytest.mark.parametrize("share", [0.02, 0.2, 0.95])
def test_holders_of_rare_and_frequent_items(monkeypatch, share):
    """Sets of one to nine items whose holders are listed, or kept as bits, in one or many slices of owners."""
    rng = np.random.default_rng(4)
    has = rng.random((500, 40)) < share
    has[:, 5:8] |= rng.random((500, 3)) < 0.9
    at, item = np.nonzero(has)
    wanted = [sorted(rng.choice(41, size, replace=False).tolist()) for size in rng.integers(1, 10, 300)]  # nobody has the last item
    wanted += [rng.choice(np.flatnonzero(has[i]), min(6, has[i].sum()), replace=False).tolist() for i in range(200) if has[i].any()]
    want = [int(np.column_stack([has, np.zeros(500, bool)])[:, s].all(axis=1).sum()) for s in wanted]
    for words, candidates in ((1 << 22, 1 << 20), (100, 50)):
        monkeypatch.setattr(J, "BIT_WORDS", words)
        monkeypatch.setattr(J, "CANDIDATES", candidates)
        got = J._Holders(item, at, 40, 500).count(np.concatenate([np.array(s) for s in wanted]), np.array([len(s) for s in wanted]))
        assert got.tolist() == want


def test_rows_of_few_matched_owners_are_not_dealt(spark):
    """A few owners are broadcast, although their number is not known before the matches are worked out."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "100000")
    try:
        items = spark.range(100_000).selectExpr("IF(id < 50, 1, id) AS pid", "id AS item")
        matches = items.groupBy("pid").agg(F.count("item").alias("n_matches"))
        out = J.rows_of_matched(items, "pid", matches, 3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((r["pid"], r["item"], r["n_matches"]) for r in out.collect()) == [(1, i, 50) for i in range(50)]
    finally:
        spark.conf.set(key, before)


def test_align_fills_only_absent_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "pid INT, x DOUBLE")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "pid INT")
    assert {r["pid"]: r["x"] for r in J.align_to(df, keys, ["pid"], {"x": 0.0}).collect()} == {1: 5.0, 2: None, 3: 0.0}


def test_rounded_keys_meet(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2)], "pid INT, t DOUBLE")
    b = spark.createDataFrame([(1, 0.3, "x")], "pid INT, t DOUBLE, v STRING")
    assert J.join_rounded(a, b, ["pid", "t"]).count() == 1


def test_first_and_last_row(spark):
    df = spark.createDataFrame([("a", 1, 9, "x"), ("a", 1, 8, "y"), ("a", 2, 1, "z")], "g STRING, d INT, e INT, v STRING")
    assert J.first_row(df, ["g"], [F.col("d"), F.col("e")], ["v"]).first()["v"] == "y"
    assert J.last_row(df, ["g"], [F.col("d"), F.col("e")], ["v"]).first()["v"] == "z"


def test_a_vocabulary_of_any_size_meets_every_row(spark):
    rows = spark.range(40).selectExpr("id % 37 AS pid", "IF(id = 5, NULL, 'x') AS note")
    values = spark.range(230).selectExpr("IF(id = 7, NULL, id % 200) AS code", "1 AS size")
    want = sorted((r.pid, str(r.note), str(v.code)) for r in rows.collect() for v in values.distinct().collect())
    for block_values in (1000, 20):
        got = J.with_vocabulary(rows, values, block_values, 4)
        assert got.columns == ["pid", "note", "code", "size"]
        assert sorted((r.pid, str(r.note), str(r.code)) for r in got.collect()) == want
    assert J.with_vocabulary(rows, values.limit(0)).count() == 0 and J.with_vocabulary(rows.limit(0), values, 20).count() == 0
