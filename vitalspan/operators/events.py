"""Event tables relative to the index date: diagnoses, laboratory flags, procedures, genetic scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions import scalars as S
from vitalspan.operators.joins import interval_join, last_row
from vitalspan.operators.reshape import drop_rare_codes, keep_common_codes
from vitalspan.session import settle

LEVELS = ("lvl4", "lvl3", "block", "chap")


def of_patients(events: DataFrame, patients: DataFrame, *columns: str) -> DataFrame:
    """Events of the patients with these columns of theirs. Events that have the columns are joined with the patients already."""
    if all(c in events.columns for c in columns):
        return events
    return events.join(patients.select("pid", *columns), "pid")


def build_code_hierarchy(definitions: DataFrame, code: str = "icd10", block: str = "block", chapter: str = "chapter") -> DataFrame:
    """Leaf code to its parents, from a definition table."""
    leaf = F.concat(F.lit("D"), F.col(code))
    return definitions.select(
        leaf.alias("code_lvl4"), F.substring(leaf, 1, 4).alias("code_lvl3"), F.col(block).alias("code_block"),
        F.concat(F.lit("Ch"), F.col(chapter).cast("string")).alias("code_chap"),
    ).where(F.length("code_lvl4") == 5)


def roll_up(events: DataFrame, parents: DataFrame, on: str, keep: Sequence[str]) -> DataFrame:
    """One row per event and hierarchy level. Events without a known leaf are dropped.

    The four levels come from one exploded array, so events are joined once.
    """
    return by_level(events.join(parents, on), keep)


def by_level(joined: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per event and level, from events that have their codes of all levels."""
    levels = F.array(*[F.struct(F.lit(l).alias("level"), F.col(f"code_{l}").alias("code")) for l in LEVELS])
    return joined.select(*keep, F.inline(levels))


def diagnosis_events(
    diagnoses: DataFrame, patients: DataFrame, parents: DataFrame, leaf: Column, on: str = "code_lvl4",
    types: Sequence[str] = ("A", "B"), min_share: float = 0.005, cohort: DataFrame | None = None,
) -> DataFrame:
    """Primary and secondary diagnoses strictly before the index, rolled up to four levels, rare codes removed.

    Events are read for the shares of their codes and for the result; they are settled before each becomes four rows.
    Diagnoses may have their patient's ``index_date`` beside them.
    """
    rows = (
        of_patients(diagnoses.where(S.matches_prefix("icd10_type", *types)), patients, "index_date")
        .where(F.col("disc_date") < F.col("index_date"))
        .select("pid", F.datediff("disc_date", "index_date").alias("time"), leaf.alias(on))
    )
    coded = settle(rows.join(parents, on).select("pid", "time", *[f"code_{l}" for l in LEVELS]))
    events = by_level(coded, ["pid", "time"])
    return drop_rare_codes(events, patients if cohort is None else cohort, min_share)


def flag_lab_results(
    tests: DataFrame, patients: DataFrame, intervals: DataFrame, min_share: float = 0.05, slack_days: int = 1,
) -> DataFrame:
    """Latest test per patient and quantity, flagged against its reference interval: ``pid, qid, time, value``.

    The test's own limits win over the lookup's. One-sided limits give -1 below, otherwise any abnormal result is
    1 and a normal one 0. ``intervals`` has ``npu_code, sex, refint_1, refint_2`` and the nullable ranges
    ``valid_from/valid_to``, ``ref_from/ref_to`` (dates) and ``age_from_days/age_to_days``. Tests may have their patient's
    columns beside them.
    """
    rows = of_patients(tests, patients, "index_date", "age", "sex")
    rows = rows.where((F.col("index_date") >= F.date_sub("drawn_date", slack_days)) & F.col("result").isNotNull())
    if "ref_type" in tests.columns:
        rows = rows.withColumns({
            "ref_lower": F.when(F.coalesce(F.col("ref_type") != "upper_limit", F.lit(True)), F.col("ref_lower")),
            "ref_upper": F.when(F.coalesce(F.col("ref_type") != "lower_limit", F.lit(True)), F.col("ref_upper")),
        })
    rows = rows.withColumn("_age", S.age_days_at("age", "index_date", "drawn_date"))
    ranges = [("drawn_date", "valid_from", "valid_to"), ("_age", "age_from_days", "age_to_days")]
    if "ref_from" in intervals.columns:
        ranges.append(("drawn_date", "ref_from", "ref_to"))
    matched = interval_join(rows, intervals.withColumnRenamed("npu_code", "qid"), ["qid", "sex"], ranges)
    limited = matched.withColumns({
        "ref_1": F.coalesce("ref_lower", "refint_1"), "ref_2": F.coalesce("ref_upper", "refint_2"),
    }).where(F.col("ref_1").isNotNull() | F.col("ref_2").isNotNull())
    tiebreak = [c for c in ("test_id",) if c in tests.columns]
    latest = last_row(
        limited, ["pid", "qid"], [F.col("drawn_date"), *[F.col(c) for c in tiebreak], F.col("ref_1"), F.col("ref_2"), F.col("result")],
        ["index_date", "drawn_date", "result", "ref_1", "ref_2"])
    common = keep_common_codes(settle(latest), patients, min_share, code="qid")  # read twice
    onesided = F.col("ref_1").isNull() | F.col("ref_2").isNull()
    low = F.coalesce(F.col("result") < F.col("ref_1"), F.lit(False))
    high = F.coalesce(F.col("result") > F.col("ref_2"), F.lit(False))
    return common.select(
        "pid", "qid", F.datediff("index_date", "drawn_date").alias("time"),
        F.when(low & onesided, -1).when(low | high, 1).otherwise(0).alias("value"),
    )


def procedure_events(codes: Sequence[DataFrame], patients: DataFrame, min_share: float = 0.01, width: int = 6) -> DataFrame:
    """Most recent date of each procedure code before the index, as positive days, common codes only.

    ``codes`` are registries of ``pid, code, date``, already limited to their code prefix; a registry may have its patients'
    ``index_date`` beside the dates.
    """
    rows = [of_patients(own, patients, "index_date").select("pid", "code", "date", "index_date") for own in codes]
    dated = reduce(DataFrame.unionByName, rows).where(F.col("date") < F.col("index_date"))
    recent = dated.groupBy("pid", F.substring("code", 1, width).alias("code")).agg(
        F.min(F.datediff("index_date", "date")).alias("time"))
    return keep_common_codes(settle(recent), patients, min_share)  # read twice


def genetic_scores(scores: DataFrame, cohort: DataFrame, keep_sign: str = "ENGAGE") -> DataFrame:
    """Scores of cohort patients, sign flipped unless the score's name ends with ``keep_sign``."""
    kept = scores.join(cohort.select("pid"), "pid", "left_semi")
    return kept.select("pid", "name", S.if_else3(F.col("name").endswith(keep_sign), F.col("score"), -F.col("score")).alias("score"))
