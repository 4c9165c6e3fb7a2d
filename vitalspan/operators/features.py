"""Feature sets in long form, survival labels, time grids and folds.

A feature row is ``(pid, feature, value)``; the vocabulary of a set is a table ``(feature, column_index)``. The width
of the matrix is data dependent, so wide frames are avoided and vectors are built only for the model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.scalars import min_max, split_feature
from vitalspan.operators.joins import with_vocabulary
from vitalspan.operators.ordered import BLOCK_ROWS, quantiles, random_rank, running
from vitalspan.operators.reshape import to_long, value_kind, with_group_stats
from vitalspan.session import settle

# Names of the feature sets and the label of each laboratory flag.
DIAGNOSES, CLINICAL_1, CLINICAL_2, LABS, PROCEDURES, GENETIC = "diag-simple", "clnc-1", "clnc-2", "bioc-1", "proc-1", "pgss-1"
FLAG_LABELS = {-1: "low", 0: "normal", 1: "high"}
AGE_RANGE = (15, 105)


def one_hot(column: str, domain: Sequence, null_level: bool = True, name: str | None = None) -> dict[str, Column]:
    """One 0/1 column per declared level, so a level absent from the data keeps its column. Exactly one is 1
    when the value is in the domain (or, with ``null_level``, missing)."""
    name = name or column
    out = {}
    for v in domain:
        text = v if isinstance(v, str) else str(v)
        out[f"{name}_{text}"] = F.when(F.col(column).eqNullSafe(F.lit(v)), 1.0).otherwise(0.0)
    if null_level:
        known = F.coalesce(F.col(column).isin(list(domain)), F.lit(False))
        out[f"{name}_nan"] = F.when(known, 0.0).otherwise(1.0)
    return out


def zscore(value: Column, mean: str, sd: str, null_value: float | None = 0.0) -> Column:
    """Standardised value; unknown values (and constant columns) become ``null_value``."""
    z = F.try_divide(value - F.col(mean), F.col(sd))
    return z if null_value is None else F.coalesce(z, F.lit(null_value))


def index_features(features: DataFrame, name: str = "feature") -> DataFrame:
    """Vocabulary with a 0-based column index in alphabetical order."""
    ranked = running(features.select(name).distinct(), [], [name], {"_rank": ("sum", F.lit(1))})
    return ranked.select(name, (F.col("_rank") - 1).alias("column_index"))


def _named(alias: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(alias), *parts)


def _held(events: DataFrame, patients: DataFrame, alias: str) -> DataFrame:
    """1 for each code of a patient.

    Codes are made different and settled before they meet the patients: the planner would move the join below that step, and
    one task would hold the sort of the join and both halves of the step at once.
    """
    rows = settle(events.select("pid", "code").distinct()).join(patients.select("pid"), "pid", "left_semi")
    return rows.select("pid", _named(alias, F.col("code")).alias("feature"), F.lit(1.0).alias("value"))


def multi_hot_vocabulary(events: DataFrame, alias: str, condition: Column | None = None) -> DataFrame:
    codes = events if condition is None else events.where(condition)
    return index_features(codes.select(_named(alias, F.col("code")).alias("feature")))


def diagnosis_window(level: str, horizon: float) -> Column:
    return (F.col("level") == level) & (F.col("time") > -horizon)


def multi_hot_diagnoses(events: DataFrame, patients: DataFrame, level: str, horizon: float) -> DataFrame:
    """1 for each code of a level seen within the horizon before the index; absent rows mean 0."""
    return _held(events.where(diagnosis_window(level, horizon)), patients, DIAGNOSES)


def multi_hot_procedures(events: DataFrame, patients: DataFrame, horizon: float) -> DataFrame:
    """1 for each procedure within the horizon; its vocabulary covers all codes whatever the horizon."""
    return _held(events.where(F.col("time") < horizon), patients, PROCEDURES)


def tri_state_labs(tests: DataFrame, patients: DataFrame, horizon: float, pattern: str = "") -> DataFrame:
    """One of low / normal / high per test within the horizon; no row at all when there was no test."""
    rows = tests.where((F.col("time") <= horizon) & F.col("qid").rlike(pattern)).join(patients.select("pid"), "pid", "left_semi")
    label = reduce(lambda acc, kv: acc.when(F.col("value") == kv[0], F.lit(kv[1])), FLAG_LABELS.items(), F)
    return rows.select("pid", _named(LABS, F.col("qid"), label).alias("feature"), F.lit(1.0).alias("value"))


def tri_state_vocabulary(tests: DataFrame, pattern: str = "") -> DataFrame:
    """Three columns per test in the order low, normal, high."""
    qids = index_features(tests.where(F.col("qid").rlike(pattern)), "qid")
    labels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(l).alias("l")) for i, l in enumerate(FLAG_LABELS.values())])
    return qids.select("qid", "column_index", F.inline(labels)).select(
        _named(LABS, F.col("qid"), F.col("l")).alias("feature"), (F.col("column_index") * 3 + F.col("i")).alias("column_index"))


def _moments(columns: Sequence[str], log: Sequence[str] = ()) -> dict[str, Column]:
    stats = {}
    for c in columns:
        x = F.col(c).cast("double")
        stats[f"_m_{c}"], stats[f"_s_{c}"] = F.avg(x), F.stddev_samp(x)
    for c in log:
        x = F.log1p(F.col(c).cast("double"))
        stats[f"_m_{c}"], stats[f"_s_{c}"] = F.avg(x), F.stddev_pop(x)
    return stats


def _long(df: DataFrame, alias: str, columns: dict[str, Column], remove: Sequence[str] = ()) -> DataFrame:
    kept = {n: c for n, c in columns.items() if not any(n.startswith(p) for p in remove)}
    wide = df.select("pid", *[c.cast("double").alias(f"{alias}_{n}") for n, c in kept.items()])
    return to_long(wide, ["pid"], None, "feature", "value")


def clinical_1_columns() -> list[str]:
    return ["age", "pulse", "sysbp", "crea", "arrest", "stemi", "enzymes_True", "enzymes_False", "enzymes_nan",
            "killip_1", "killip_2", "killip_3", "killip_4", "killip_nan"]


def clinical_features_1(baseline: DataFrame, patients: DataFrame, remove: Sequence[str] = (), fit_on: DataFrame | None = None) -> DataFrame:
    """Risk-score inputs: scaled age, standardised vitals, log creatinine, one-hot enzymes and Killip class.

    Scaling statistics come from ``fit_on`` (default: the whole baseline table) in one pass. Patients without a
    baseline row get NULL values, so that a missing patient differs from an average one.
    """
    fit = (baseline if fit_on is None else fit_on).agg(*[c.alias(n) for n, c in _moments(["pulse", "sys_bp"], ["crea"]).items()])
    rows = baseline.withColumn("_k", F.lit(0)).join(F.broadcast(fit.withColumn("_k", F.lit(0))), "_k")
    columns = {
        "age": min_max(F.col("age"), *AGE_RANGE),
        "pulse": zscore(F.col("pulse").cast("double"), "_m_pulse", "_s_pulse"),
        "sysbp": zscore(F.col("sys_bp").cast("double"), "_m_sys_bp", "_s_sys_bp"),
        "crea": zscore(F.log1p(F.col("crea").cast("double")), "_m_crea", "_s_crea"),
        "arrest": F.col("arrest"), "stemi": F.col("stemi"),
        "enzymes_True": F.when(F.col("enzymes"), 1.0).otherwise(0.0),
        "enzymes_False": F.when(~F.col("enzymes"), 1.0).otherwise(0.0),
        "enzymes_nan": F.col("enzymes").isNull(),
        **one_hot("killip", [1, 2, 3, 4]),
    }
    aligned = patients.select("pid").join(rows.withColumn("_present", F.lit(True)), "pid", "left")
    present = {n: F.when(F.col("_present"), c.cast("double")) for n, c in columns.items()}
    return _long(aligned, CLINICAL_1, present, remove)


# Declared domains of the second clinical table.
DOMAINS = {
    "smoking": ["no", "ex", "yes"], "vessels": ["DIF", "1VD", "2VD", "3VD"], "dominance": ["B", "R", "L"],
    "nyha": [1, 2, 3, 4], "ccs": [0, 1, 2, 3, 4],
}
EXPLICIT_MISSING = {
    "lvef": ["[0,10]", "(10,20]", "(20,30]", "(30,40]", "(40,50]", "(50,60]", "missing"],
    "ischemia_test": ["inconclusive", "missing", "negative", "positive"],
    "abnormal_ekg": ["missing", "no", "yes"], "abnormal_qrs_st": ["missing", "no", "yes"],
    "familiary_ihd": ["missing", "no", "yes"],
}


def clinical_features_2(table: DataFrame, patients: DataFrame, remove: Sequence[str] = (), fit_on: DataFrame | None = None,
                        domains: dict[str, Sequence] | None = None, explicit: dict[str, Sequence] | None = None) -> DataFrame:
    """Standardised body measures and one-hot categories with fixed domains; column names in alphabetical order."""
    measures = ["height", "weight", "dia_bp"]
    fit = (table if fit_on is None else fit_on).agg(*[c.alias(n) for n, c in _moments(measures).items()])
    rows = table.withColumn("_k", F.lit(0)).join(F.broadcast(fit.withColumn("_k", F.lit(0))), "_k")
    columns: dict[str, Column] = {"sex": F.col("sex"), "icd-or-pm": F.col("icd_or_pm")}
    for c in measures:
        columns[c.replace("_", "-")] = zscore(F.col(c).cast("double"), f"_m_{c}", f"_s_{c}")
    for c, domain in (DOMAINS if domains is None else domains).items():
        columns.update(one_hot(c, domain, True, c.replace("_", "-")))
    for c, domain in (EXPLICIT_MISSING if explicit is None else explicit).items():
        columns.update(one_hot(c, domain, False, c.replace("_", "-")))
    aligned = patients.select("pid").join(rows.withColumn("_present", F.lit(True)), "pid", "left")
    present = {n: F.when(F.col("_present"), columns[n].cast("double")) for n in sorted(columns)}
    return _long(aligned, CLINICAL_2, present, remove)


def winsorize(df: DataFrame, by: Sequence[str], value: str, limit: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Clamp both tails of each group: with ``k = floor(limit * n)`` the k lowest become the next value, likewise on top.

    The two clamps are order statistics found by running counts over distinct values, then joined back.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_w"))
    ranked = running(counts, by, [value], {"_cum": ("sum", "_w")}, block_rows=block_rows)
    ranked = settle(ranked)
    sized = with_group_stats(ranked, by, {"_n": F.sum("_w")})
    k = F.floor(F.col("_n") * F.lit(float(limit)))
    bounds = settle(sized.groupBy(*by).agg(
        F.min(F.when(F.col("_cum") > k, F.col(value))).alias("_lo"),
        F.min(F.when(F.col("_cum") >= F.col("_n") - k, F.col(value))).alias("_hi")))
    clamped = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi")))
    return df.join(bounds, list(by)).withColumn(value, clamped).drop("_lo", "_hi")


def polygenic_features(scores: DataFrame, patients: DataFrame, limit: float = 0.0) -> DataFrame:
    """Winsorised scores standardised per score. Patients without any score are 0; a single missing score is NULL."""
    clamped = settle(winsorize(scores, ["name"], "score", limit))  # read twice below
    stats = with_group_stats(clamped, ["name"], {"_m": F.avg("score"), "_s": F.stddev_samp("score")})
    z = stats.select("pid", "name", zscore(F.col("score"), "_m", "_s", None).alias("value"))
    has = scores.select("pid").distinct().withColumn("_has", F.lit(True))
    names = scores.select("name").where(F.col("name").isNotNull())
    grid = with_vocabulary(patients.select("pid").join(has, "pid", "left"), names)
    filled = grid.join(z, ["pid", "name"], "left")
    value = F.when(F.col("_has"), F.col("value")).otherwise(F.lit(0.0))
    return filled.select("pid", _named(GENETIC, F.col("name")).alias("feature"), value.alias("value"))


# --- assembly ------------------------------------------------------------------------------------------------------

FeatureSet = Callable[..., DataFrame]

FEATURE_SETS: dict[str, tuple[str, FeatureSet]] = {
    CLINICAL_1: ("baseline", clinical_features_1),
    CLINICAL_2: ("clinicaltwo", clinical_features_2),
    DIAGNOSES: ("diagnoses", multi_hot_diagnoses),
    LABS: ("biochem", tri_state_labs),
    PROCEDURES: ("nomesco", multi_hot_procedures),
    GENETIC: ("polygenic_scores", polygenic_features),
}

_DIAG = {"level": "lvl3", "horizon": 3650.0}
_LABS = {"horizon": 3650.0}
_PROC = {"horizon": 3650.0}
_PGS = {"limit": 0.05}

# The twelve feature-set configurations. Windows, code level and tail share are search parameters.
STUDIES: dict[str, dict[str, dict]] = {
    "001": {DIAGNOSES: _DIAG},
    "002": {CLINICAL_1: {}},
    "003": {CLINICAL_1: {}, DIAGNOSES: _DIAG},
    "004": {CLINICAL_1: {}, CLINICAL_2: {}, DIAGNOSES: _DIAG},
    "005": {CLINICAL_1: {}, CLINICAL_2: {}, DIAGNOSES: _DIAG, LABS: _LABS},
    "006": {CLINICAL_1: {}, CLINICAL_2: {}, DIAGNOSES: _DIAG, LABS: _LABS, PROCEDURES: _PROC},
    "007": {CLINICAL_1: {}, CLINICAL_2: {}, DIAGNOSES: _DIAG, LABS: _LABS, PROCEDURES: _PROC, GENETIC: _PGS},
    "008": {CLINICAL_1: {}, CLINICAL_2: {}, GENETIC: _PGS},
    "009": {CLINICAL_1: {}, CLINICAL_2: {}},
    "010": {DIAGNOSES: _DIAG, GENETIC: _PGS},
    "011": {GENETIC: _PGS},
    "012": {
        CLINICAL_1: {"remove": ("arrest", "enzymes")},
        CLINICAL_2: {"remove": ("abnormal-ekg", "abnormal-qrs-st", "dominance", "ischemia-test", "nyha")},
        DIAGNOSES: _DIAG, LABS: {**_LABS, "pattern": "^NPU"},
    },
}
# Ranges of the search parameters (windows in years, tail share), and the code levels.
SEARCH_SPACE = {
    "diag_window": (0.5, 20, 0.5), "diag_level": ("lvl4", "lvl3", "block", "chap"), "bioc_window": (0.5, 5, 0.25),
    "proc_window": (0.5, 20, 0.5), "pgs_limit": (0.0, 0.49, 0.01),
}
# Studies whose cohort is limited to patients with a genetic score.
SCORED_COHORT = ("011",)


def assemble_features(tables: dict[str, DataFrame], patients: DataFrame, sets: dict[str, dict]) -> DataFrame:
    """Union of the long rows of the named sets, each with its parameters."""
    parts = [
        FEATURE_SETS[alias][1](tables[FEATURE_SETS[alias][0]], patients, **params) for alias, params in sets.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def study_patients(surv: DataFrame, tables: dict[str, DataFrame], study: str) -> DataFrame:
    """Patients of a study; some studies keep only patients with genetic scores."""
    if study not in SCORED_COHORT:
        return surv
    return surv.join(tables["polygenic_scores"].select("pid").distinct(), "pid", "left_semi")


def study_features(tables: dict[str, DataFrame], patients: DataFrame, study: str, overrides: dict[str, dict] | None = None) -> DataFrame:
    """Long feature rows of a study; ``overrides`` replaces parameters of its sets, by set name."""
    overrides = overrides or {}
    sets = {alias: {**params, **overrides.get(alias, {})} for alias, params in STUDIES[study].items()}
    return assemble_features(tables, study_patients(patients, tables, study), sets)


def set_vocabulary(alias: str, tables: dict[str, DataFrame], long: DataFrame, params: dict) -> DataFrame:
    """The columns (feature) that a set gives to a matrix, whatever the rows of the patients at hand.

    Diagnoses have the codes seen within the window in all events, procedures all codes whatever the window, tests three
    columns each, the other sets the same columns for every patient.
    """
    source = tables[FEATURE_SETS[alias][0]]
    if alias == DIAGNOSES:
        return multi_hot_vocabulary(source, alias, diagnosis_window(params["level"], params["horizon"])).select("feature")
    if alias == PROCEDURES:
        return multi_hot_vocabulary(source, alias).select("feature")
    if alias == LABS:
        return tri_state_vocabulary(source, params.get("pattern", "")).select("feature")
    return long.where(F.col("feature").startswith(f"{alias}_")).select("feature").distinct()


def study_vocabulary(tables: dict[str, DataFrame], long: DataFrame, study: str, overrides: dict[str, dict] | None = None) -> DataFrame:
    """Feature and column index of a study's matrix; the same for any two cohorts over the same event tables."""
    overrides = overrides or {}
    parts = [set_vocabulary(alias, tables, long, {**params, **overrides.get(alias, {})}) for alias, params in STUDIES[study].items()]
    return index_features(reduce(DataFrame.unionByName, parts))


def feature_arrays(long: DataFrame, vocabulary: DataFrame, width: int, out: str = "features", patients: DataFrame | None = None) -> DataFrame:
    """Dense array per patient in vocabulary order, absent features 0. For the model boundary only.

    With ``patients`` every one of them gets a row, also those without any feature. What is shuffled are the known
    cells; arrays are filled batch by batch, one write a cell.
    """
    cells = long.join(vocabulary, "feature").groupBy("pid").agg(
        F.collect_list(F.struct(F.col("column_index").cast("int").alias("i"), F.coalesce("value", F.lit(0.0)).cast("double").alias("x"))).alias("_m"))
    if patients is not None:
        cells = patients.select("pid").join(cells, "pid", "left")

    @F.pandas_udf("array<double>")
    def fill(places: pd.Series, values: pd.Series) -> pd.Series:
        rows = []
        for at, x in zip(places, values):
            row = np.zeros(width)
            if at is not None and len(at):
                row[np.asarray(at, dtype=np.int64)] = np.asarray(x, dtype=float)
            rows.append(row)
        return pd.Series(rows, dtype=object)

    return cells.select("pid", fill(F.col("_m.i"), F.col("_m.x")).alias(out))


# Which parameter of which feature set a search parameter sets; windows are given in years.
SEARCH_TARGETS = {
    "diag_window": (DIAGNOSES, "horizon", 365), "diag_level": (DIAGNOSES, "level", None), "bioc_window": (LABS, "horizon", 365),
    "proc_window": (PROCEDURES, "horizon", 365), "pgs_limit": (GENETIC, "limit", None),
}


def search_overrides(params: dict) -> dict[str, dict]:
    """Search parameters as overrides for :func:`study_features`."""
    out: dict[str, dict] = {}
    for name, value in params.items():
        alias, key, unit = SEARCH_TARGETS[name]
        out.setdefault(alias, {})[key] = value if unit is None else float(value) * unit
    return out


def feature_dictionary(features: DataFrame, long: DataFrame, *definitions: DataFrame) -> DataFrame:
    """Name parts, joined values, inferred type and the first available definition of every feature.

    ``features`` has ``feature``; each definition table has ``fname`` and one text column.
    """
    parts = features.select(*[c.alias(n) for n, c in split_feature("feature").items()])
    parts = parts.withColumn("fgroup", F.when(F.col("fgroup") == DIAGNOSES, "diag-1").otherwise(F.col("fgroup")))
    listed = parts.groupBy("fgroup", "fname").agg(
        F.array_join(F.array_sort(F.collect_set("fvalue")), "/").alias("values"))
    listed = listed.withColumn("values", F.nullif("values", F.lit("")))
    types = value_kind(long.select(split_feature("feature")["fname"].alias("fname"), "feature", "value"), ["fname"], "value", F.col("feature"))
    out = listed.join(types, "fname")
    names = []
    for i, d in enumerate(definitions):
        text = [c for c in d.columns if c != "fname"][0]
        out = out.join(d.select("fname", F.col(text).alias(f"_d{i}")), "fname", "left")
        names.append(f"_d{i}")
    return out.withColumn("definition", F.coalesce(*names) if names else F.lit(None).cast("string")).drop(*names)


# --- labels and folds --------------------------------------------------------------------------------------------


def time_breaks(surv: DataFrame, n_intervals: int, max_time: float, train_only: bool = True, start_at_zero: bool = False) -> DataFrame:
    """One row with the percentile grid of event times, exact for any number of distinct times."""
    rows = surv.where(F.col("event") & (F.col("time") <= max_time))
    if train_only:
        rows = rows.where("train")
    probs = [i / n_intervals for i in range(n_intervals + 1)]
    out = quantiles(rows.select(F.col("time").cast("double").alias("time")), [], "time", probs, "breaks")
    if start_at_zero:
        out = out.select(F.concat(F.array(F.lit(0.0)), F.slice("breaks", 2, n_intervals)).alias("breaks"))
    return out


def _with_breaks(surv: DataFrame, breaks: DataFrame | Sequence[float]) -> DataFrame:
    if isinstance(breaks, DataFrame):  # one row, n_intervals + 1 numbers
        return surv.withColumn("_k", F.lit(0)).join(F.broadcast(breaks.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return surv.withColumn("breaks", F.array(*[F.lit(float(b)) for b in breaks]))


def survival_labels(surv: DataFrame, breaks: DataFrame | Sequence[float]) -> DataFrame:
    """``died`` and ``survived`` flags per interval.

    An event before the last break marks the first interval whose end is at or after it as died, and every interval
    that ended by then as survived (so a time on a break is both). Otherwise intervals whose midpoint was passed
    count as survived.
    """
    rows = _with_breaks(surv, breaks)
    ends = F.slice("breaks", 2, F.size("breaks") - 1)
    starts = F.slice("breaks", 1, F.size("breaks") - 1)
    time = F.col("time").cast("double")
    observed = F.col("event") & (time < F.try_element_at("breaks", F.lit(-1)))
    hit = F.size(F.filter(ends, lambda e: e < time))  # index of the first interval end at or after the time
    died = F.transform(ends, lambda e, i: observed & (i == hit))
    survived = F.zip_with(starts, ends, lambda s, e: F.when(observed, time >= e).otherwise(time >= s + (e - s) / 2))
    keep = [c for c in surv.columns]
    return rows.select(*keep, died.alias("died"), survived.alias("survived"))


def person_periods(labels: DataFrame, keep: Sequence[str] = ("pid",)) -> DataFrame:
    """One row per patient and interval that carries information (died, survived, or both)."""
    pairs = F.transform(F.arrays_zip("died", "survived"), lambda p, i: F.struct(i.alias("interval"), p["died"].alias("died"), p["survived"].alias("survived")))
    return labels.select(*keep, F.inline(pairs)).where("died OR survived")


def kfold_assign(df: DataFrame, k: int, seed: int = 42, pid: str = "pid", shuffle: Column | None = None) -> DataFrame:
    """Fold 0..k-1 per patient: equal sizes, the remainder goes to the last fold."""
    ranked = with_group_stats(random_rank(df, pid, shuffle=shuffle, seed=seed, out="_rank"), [], {"_n": F.count("*")})
    size = F.greatest(F.floor(F.col("_n") / F.lit(k)), F.lit(1))
    fold = F.least(F.floor((F.col("_rank") - 1) / size), F.lit(k - 1)).cast("int")
    return ranked.withColumn("fold", fold).drop("_rank", "_n")


def ratio_split(df: DataFrame, ratio: float, seed: int = 42, pid: str = "pid", shuffle: Column | None = None) -> DataFrame:
    """``part`` 1 for the first ``floor(n * ratio)`` patients of a random order, 2 for the others."""
    ranked = with_group_stats(random_rank(df, pid, shuffle=shuffle, seed=seed, out="_rank"), [], {"_n": F.count("*")})
    part = F.when(F.col("_rank") <= F.floor(F.col("_n") * F.lit(float(ratio))), 1).otherwise(2)
    return ranked.withColumn("part", part).drop("_rank", "_n")
