"""Standard errors and paired contrasts of any number of models from influence values, without resampling.

A metric's influence value of a subject is its derivative by the subject's weight, times the number of subjects. Weighting
by the inverse probability of censoring makes it the sum of two terms: what the subject's own case or control
contribution moves, and what the subject moves in the censoring curve that weighs all others. Both follow from running sums, over
distinct scores and over distinct times, so one pass gives the values of all models and horizons. The variance of a
metric, and of the difference of two metrics on the same subjects, is the sum of squares of the values or of their differences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.metrics import null_risk, score_table
from vitalspan.operators.ordered import BLOCK_ROWS, running
from vitalspan.operators.resample import adjust_bh
from vitalspan.operators.survival import Z95, normal_two_sided
from vitalspan.session import settle

METRICS = ("auc", "brier", "ipa")


def _part_of_auc(known: DataFrame, by: Sequence[str], risk: str, block_rows: int) -> DataFrame:
    """Rows with the AUC (``_value``), their contribution to it (``_part``) and the contributions' mean (``_mean``, 0)."""
    table = settle(score_table(known, by, risk))
    ranked = running(table, by, [risk], {"_a": ("sum", "cases"), "_b": ("sum", "controls")}, block_rows=block_rows)
    ranked = settle(ranked.withColumn("_won", F.col("_b") - F.col("controls") / 2).withColumn("_below", F.col("_a") - F.col("cases") / 2))
    totals = ranked.groupBy(*by).agg(
        F.sum("cases").alias("_cases"), F.sum("controls").alias("_controls"), F.sum(F.col("cases") * F.col("_won")).alias("_pairs"))
    totals = settle(totals.withColumn("_value", F.try_divide("_pairs", F.col("_cases") * F.col("_controls"))))  # a row a group
    place = ranked.join(totals, list(by)).select(*by, risk, "_won", (F.col("_cases") - F.col("_below")).alias("_lost"), "_cases", "_controls", "_value")
    rows = known.join(place, [*by, risk])
    a, b = (F.when(F.col(c), F.col("w")).otherwise(0.0) for c in ("case", "control"))
    won = F.try_divide(a * F.col("_won") + b * F.col("_lost"), F.col("_cases") * F.col("_controls"))
    part = F.col("_n") * (won - F.col("_value") * (F.try_divide(a, "_cases") + F.try_divide(b, "_controls")))
    return rows.withColumns({"_part": part, "_mean": F.lit(0.0)}).drop("_won", "_lost", "_cases", "_controls")


def _error(risk: Column) -> Column:
    squared = F.when(F.col("case"), F.pow(1 - risk, F.lit(2.0))).when(F.col("control"), F.pow(risk, F.lit(2.0))).otherwise(0.0)
    return squared * F.coalesce("w", F.lit(0.0))


def _part_of_brier(known: DataFrame, by: Sequence[str], risk: Column) -> DataFrame:
    rows = known.withColumn("_part", _error(risk))
    mean = rows.groupBy(*by).agg(F.avg("_part").alias("_mean"))
    return rows.join(settle(mean), list(by)).withColumn("_value", F.col("_mean"))


def _with_censoring(rows: DataFrame, by: Sequence[str], tau: str, block_rows: int) -> DataFrame:
    """Adds ``influence``: the part less its mean, and the subject's share in the censoring curve.

    At a time u with c subjects censored of q at risk (events at u have left), a censored subject moves the weights of
    all contributions that lie later by 1 / (q - c), and each one at risk by -c / (q (q - c)).
    """
    times = settle(rows.groupBy(*by, "time").agg(
        F.count(F.lit(1)).alias("_leave"), F.sum(F.col("event").cast("long")).alias("_d"),
        F.sum(F.when(F.col("case"), F.col("_part")).otherwise(0.0)).alias("_s"), F.first("_mean").alias("_mean"), F.first("_n").alias("_n")))
    at_risk = running(times, by, ["time"], {"_risk": ("sum", "_leave")}, descending=True, block_rows=block_rows)
    past = running(settle(at_risk), by, ["time"], {"_past": ("sum", "_s")}, block_rows=block_rows)
    censored, q = F.col("_leave") - F.col("_d"), F.col("_risk") - F.col("_d")
    counts = (F.col("time") <= F.col(tau)) & (censored > 0) & (q > censored)
    jump = F.when(counts, (F.col("_mean") * F.col("_n") - F.col("_past")) / (q - censored)).otherwise(0.0)
    steps = settle(past.withColumn("_jump", jump).withColumn("_step", F.when(counts, F.col("_jump") * censored / q).otherwise(0.0)))
    curve = running(steps, by, ["time"], {"_sum": ("sum", "_step")}, block_rows=block_rows)
    met = rows.drop("_n").join(curve.select(*by, "time", "_jump", "_step", "_sum"), [*by, "time"])
    moved = F.when(F.col("event"), F.col("_step") - F.col("_sum")).otherwise(F.col("_jump") - F.col("_sum"))
    return met.withColumn("influence", F.col("_part") - F.col("_mean") + moved)


def influence(weighted: DataFrame, by: Sequence[str], metric: str, key: str = "pid", risk: str = "risk", tau: str = "tau",
              surv: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, key, value, influence) of every subject: ``auc``, ``brier`` or ``ipa`` at the horizon ``tau``, one of ``by``.

    ``weighted`` comes from :func:`metrics.ipcw`; its censoring curve is that of the scored subjects. ``ipa`` needs
    ``surv`` for the null model, whose risk is taken as given. Rows without a risk are left out; a group without cases
    or without controls has a NULL value and NULL influences.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    columns = [*by, key, risk, "case", "control", "w", "time", "event"]
    known = settle(weighted.where(F.col(risk).isNotNull()).select(*dict.fromkeys(columns)))
    known = known.join(settle(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))), list(by))
    out = [*by, key, F.col("_value").alias("value"), "influence"]
    if metric == "auc":
        return _with_censoring(settle(_part_of_auc(known, by, risk, block_rows)), by, tau, block_rows).select(*out)
    if metric == "brier":
        return _with_censoring(settle(_part_of_brier(known, by, F.col(risk))), by, tau, block_rows).select(*out)
    if surv is None:
        raise ValueError("ipa needs surv, the table of times and events that the null model is fitted on")
    nulls = null_risk(surv, [r[0] for r in known.select(tau).distinct().collect()]).withColumnRenamed("tau", tau)  # a row a horizon
    both = known.join(settle(nulls), tau)
    sums = settle(both.groupBy(*by).agg(F.avg(_error(F.col(risk))).alias("_brier"), F.avg(_error(F.col("null_risk"))).alias("_null")))
    rows = both.join(sums, list(by))
    # 1 - brier / null is linear in the contributions of both scores near their means, and their mean part is 0
    part = F.try_divide(F.col("_brier") * _error(F.col("null_risk")), F.col("_null") * F.col("_null")) - F.try_divide(_error(F.col(risk)), F.col("_null"))
    rows = rows.withColumns({"_part": part, "_mean": F.lit(0.0), "_value": 1 - F.try_divide("_brier", "_null")})
    return _with_censoring(settle(rows), by, tau, block_rows).select(*out)


def _interval(df: DataFrame, value: str, level_z: float = Z95) -> DataFrame:
    return df.withColumns({"lower": F.col(value) - level_z * F.col("se"), "upper": F.col(value) + level_z * F.col("se")})


def estimates(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, value, se, lower, upper) from :func:`influence`."""
    sums = values.groupBy(*by).agg(
        F.max("value").alias("value"), (F.sqrt(F.sum(F.col("influence") * F.col("influence"))) / F.count("influence")).alias("se"))
    return _interval(sums, "value").select(*by, "value", "se", "lower", "upper")


def contrasts(values: DataFrame, reference: str, by: Sequence[str] = ("tau",), model: str = "model", key: str = "pid") -> DataFrame:
    """Every model against the reference on the same subjects: (model, by, value, delta, se, lower, upper, p, p_adjusted).

    ``values`` come from :func:`influence` with ``[model, *by]``. Subjects meet their own value under the reference in one
    join, whatever the number of models. p-values are adjusted for the false-discovery rate within ``by``; a metric that is
    not defined at a horizon has NULLs there.
    """
    values = settle(values)
    base = values.where(F.col(model) == reference).select(*by, key, F.col("value").alias("_base"), F.col("influence").alias("_own"))
    pairs = values.where(F.col(model) != reference).join(base, [*by, key])
    apart = F.col("influence") - F.col("_own")
    sums = pairs.groupBy(model, *by).agg(
        F.max("value").alias("value"), (F.max("value") - F.max("_base")).alias("delta"), (F.sqrt(F.sum(apart * apart)) / F.count(apart)).alias("se"))
    tested = _interval(sums, "delta").withColumn("p", normal_two_sided(F.try_divide("delta", "se")))
    tested = settle(tested)
    unknown = tested.where("p IS NULL").withColumn("p_adjusted", F.lit(None).cast("double"))
    adjusted = adjust_bh(tested, "p", [model], by).unionByName(unknown)
    return adjusted.select(model, *by, "value", "delta", "se", "lower", "upper", "p", "p_adjusted")
