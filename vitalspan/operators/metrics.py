"""Discrimination, calibration and accuracy of survival predictions at any number of horizons and models.

All metrics take long tables and grouping keys, so models, horizons and subgroups are evaluated in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.operators.ordered import BLOCK_ROWS, quantiles, running, with_blocks
from vitalspan.operators.reshape import histogram_2d, to_wide
from vitalspan.operators.survival import censoring_curve, kaplan_meier, km_at, step_at
from vitalspan.session import settle


#: Distinct risks whose pairs a task counts, about.
RISK_ROWS = 1 << 17
#: Rows of a block that a task takes at most.
BLOCK_LIMIT = 1 << 22

# --- concordance -----------------------------------------------------------------------------------------------


def concordance(
    df: DataFrame, by: Sequence[str] = (), time: str = "time", event: str = "event", risk: str = "risk",
    weight: str | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Harrell's C and Somers' Dxy, exact, without forming pairs.

    Two subjects with different whole-day times agree on the leading bits of their times down to exactly one bit
    position, where the earlier one has 0 and the later one 1. So each comparable pair meets in exactly one
    (bit, prefix) cell, and within a cell the pairs ordered by risk are counted by running sums over distinct
    risks. Times count from the first one, so negative ones may occur.

    Rows meet in blocks of some ``RISK_ROWS`` distinct risks, whose own pairs a task counts bit by bit. Pairs of different
    blocks need no single risks: they are counted over times and blocks, as many rows as a block has different times. So
    each row is shuffled once, not once a bit. A subject with an event and one censored
    at the same time are comparable too and meet in a cell of that time. Risk ties count one half.
    """
    kind = dict(df.dtypes)[time]
    w = F.lit(1) if weight is None else F.col(weight)
    known = df.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(risk).isNotNull())
    base = known.groupBy(*by, F.col(time).alias("_t"), F.col(event).alias("_e"), F.col(risk).alias("_r")).agg(F.sum(w).alias("_n"))
    base = settle(base)
    blocks = settle(with_blocks(base, by, ["_r"], RISK_ROWS).drop("_cut", "_all"))
    most = blocks.groupBy(*by, "_block").count().agg(F.max("count")).first()[0]
    if (most or 0) <= BLOCK_LIMIT:
        key = F.struct(F.col("_block").isNotNull().alias("known"), "_block")
        coarse = blocks.groupBy(*by, "_t", "_e", key.alias("_r")).agg(F.sum("_n").alias("_n"))
        across = _cells_of_times(settle(coarse), by, kind, block_rows)
        number = "bigint" if dict(base.dtypes)["_n"] == "bigint" else "double"
        out = f"{''.join(f'`{c}` {dict(base.dtypes)[c]}, ' for c in by)}_conc {number}, _tied {number}"
        own = blocks.groupBy(*by, "_block").applyInArrow(_count_within(list(by), number), out)
        within = own.groupBy(*[F.col(c).alias(f"_b_{c}") for c in by]).agg(F.sum("_conc").alias("_own"), F.sum("_tied").alias("_equal"))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by], F.lit(True))
        total = across.join(F.broadcast(within), same).select(  # a row a group each
            *by, "pairs", (F.col("concordant") + F.col("_own")).alias("concordant"), F.col("_equal").alias("tied"))
    else:  # so many times of one risk that its rows do not fit a task
        total = _cells_of_times(base, by, kind, block_rows)
    c = F.try_divide(F.col("concordant") + F.col("tied") / F.lit(2.0), F.col("pairs"))
    return total.withColumn("c_index", c).withColumn("dxy", (F.col("c_index") - 0.5) * 2)


def _count_within(by: list[str], number: str) -> Callable[[pa.Table], pa.Table]:
    """Concordant and tied pairs of a block of risks: the cells of :func:`_cells_of_times` one bit after the other."""
    def run(rows: pa.Table) -> pa.Table:
        column = lambda name: rows.column(name).to_numpy()
        n = column("_n").astype(np.int64 if number == "bigint" else np.float64)
        event = column("_e").astype(bool)
        rank = np.unique(column("_r"), return_inverse=True)[1]
        # an event comes before what is censored at the same time
        time = np.unique(np.unique(column("_t"), return_inverse=True)[1] * 2 + ~event, return_inverse=True)[1]
        order = np.argsort(rank, kind="stable")
        rank, time, n, event = rank[order], time[order], n[order], event[order]
        concordant, tied = n.dtype.type(0), n.dtype.type(0)
        for level in range(int(time.max()).bit_length()):
            prefix, late = time >> (level + 1), (time >> level) & 1 == 1
            at = np.argsort(prefix, kind="stable")
            upto = np.concatenate([[0], np.cumsum(np.where(late, n, 0)[at])])
            cell = np.diff(prefix[at], prepend=-1) != 0
            begins = np.flatnonzero(cell | (np.diff(rank[at], prepend=-1) != 0))  # of equal risks in a cell
            first = np.add.reduceat(np.where(event & ~late, n, 0)[at], begins)
            below, through = upto[begins], upto[np.append(begins[1:], len(at))]
            start = upto[np.maximum.accumulate(np.where(cell[begins], begins, 0))]
            concordant += (first * (below - start)).sum()
            tied += (first * (through - below)).sum()
        kind = pa.int64() if number == "bigint" else pa.float64()
        return pa.table({**{c: rows.column(c).slice(0, 1) for c in by}, "_conc": pa.array([concordant], kind), "_tied": pa.array([tied], kind)})

    return run


def _cells_of_times(base: DataFrame, by: Sequence[str], kind: str, block_rows: int) -> DataFrame:
    """``pairs``, ``concordant`` and ``tied`` of rows ``_t, _e, _r, _n`` by bits of the time."""
    low, top = (0, None) if kind not in ("int", "bigint", "smallint", "tinyint") else base.agg(F.min("_t"), F.max("_t")).first()
    if top is None or top - low >= 1 << 62:  # no whole numbers, none at all, or too far apart to be counted from the first
        ranks = running(base.select("_t").distinct(), [], ["_t"], {"_rank": ("sum", F.lit(1))}, block_rows=block_rows)
        base = settle(base.join(ranks, "_t").withColumn("_t", F.col("_rank").cast("long")).drop("_rank"))
        low, top = 0, base.agg(F.max("_t")).first()[0] or 0
    base = base.withColumn("_t", F.col("_t").cast("long") - F.lit(low).cast("long"))
    bits = max(int(top - low).bit_length(), 1)

    levels = F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))
    split = base.withColumn("_level", levels).select(
        *by, "_level", F.expr("shiftright(_t, _level + 1)").alias("_prefix"),
        (F.expr("shiftright(_t, _level)").bitwiseAND(F.lit(1)) == 0).alias("_early"),
        "_e", "_r", "_n",
    ).where("_e OR NOT _early").drop("_e")
    same_time = base.select(
        *by, F.lit(-1).alias("_level"), F.col("_t").alias("_prefix"), F.col("_e").alias("_early"), "_r", "_n")
    cell = [*by, "_level", "_prefix"]
    sides = split.unionByName(same_time).groupBy(*cell, "_r").agg(
        F.sum(F.when(F.col("_early"), F.col("_n")).otherwise(0)).alias("_first"),
        F.sum(F.when(~F.col("_early"), F.col("_n")).otherwise(0)).alias("_later"))
    ranked = running(settle(sides), cell, ["_r"], {"_upto": ("sum", "_later")}, block_rows=block_rows)
    sums = ranked.groupBy(*cell).agg(
        F.sum(F.col("_first") * (F.col("_upto") - F.col("_later"))).alias("_conc"),
        F.sum(F.col("_first") * F.col("_later")).alias("_tied"),
        (F.sum("_first") * F.sum("_later")).alias("_pairs"))
    return sums.groupBy(*by).agg(
        F.sum("_pairs").alias("pairs"), F.sum("_conc").alias("concordant"), F.sum("_tied").alias("tied"))


# --- inverse-probability-of-censoring weights --------------------------------------------------------------------


def ipcw(scored: DataFrame, surv: DataFrame, taus: Sequence[float], strata: Sequence[str] = (), pid: str = "pid", tau: str = "tau") -> DataFrame:
    """Attach outcome and weights at each row's horizon: ``case`` / ``control`` flags and weight ``w``.

    Cases are weighted by the censoring curve just before their time, controls by the curve at the horizon;
    subjects censored before the horizon get no weight.
    """
    curve = censoring_curve(surv, strata)
    curve = settle(curve)  # read by two joins, whose planner then knows its size
    steps = curve.select(*strata, "time", "g_before")
    outcome = surv.join(steps, [*strata, "time"]).select(pid, *strata, "time", "event", "g_before")
    at_tau = step_at(curve, strata, taus, {"g": 1.0}).withColumnRenamed("tau", tau).withColumnRenamed("g", "g_tau")
    # rows by subject meet in a sort-merge join, as their size is unknown to the planner; at_tau has a row a stratum and horizon
    joined = scored.hint("merge").join(outcome, [pid, *[s for s in strata if s in scored.columns]]).join(F.broadcast(at_tau), [*strata, tau])
    case = F.col("event") & (F.col("time") <= F.col(tau))
    control = F.col("time") > F.col(tau)
    return joined.withColumns({
        "case": case, "control": control,
        "w": F.when(case, F.try_divide(F.lit(1.0), F.col("g_before"))).when(control, F.try_divide(F.lit(1.0), F.col("g_tau"))).otherwise(0.0),
    })


def score_table(weighted: DataFrame, by: Sequence[str], risk: str = "risk", weight: str | None = None) -> DataFrame:
    """Case and control weight per distinct score; equal scores are merged before anything is sorted."""
    w = F.col("w") if weight is None else F.col("w") * F.col(weight)
    return weighted.where(F.col(risk).isNotNull()).groupBy(*by, risk).agg(
        F.sum(F.when(F.col("case"), w).otherwise(0.0)).alias("cases"),
        F.sum(F.when(F.col("control"), w).otherwise(0.0)).alias("controls"))


def td_auc(weighted: DataFrame, by: Sequence[str], risk: str = "risk", weight: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Time-dependent AUC per group: weighted share of case-control pairs ranked correctly, ties one half."""
    table = settle(score_table(weighted, by, risk, weight))
    ranked = running(table, by, [risk], {"_below": ("sum", "controls")}, block_rows=block_rows)
    won = F.col("cases") * (F.col("_below") - F.col("controls") / 2)
    sums = ranked.groupBy(*by).agg(F.sum(won).alias("_won"), F.sum("cases").alias("_cases"), F.sum("controls").alias("_controls"))
    return sums.select(*by, F.try_divide(F.col("_won"), F.col("_cases") * F.col("_controls")).alias("auc"))


def td_roc(weighted: DataFrame, by: Sequence[str], risk: str = "risk", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ROC points: sensitivity and 1 - specificity when scores at or above each distinct score are positive."""
    table = settle(score_table(weighted, by, risk))
    ranked = running(table, by, [risk], {"_tp": ("sum", "cases"), "_fp": ("sum", "controls")}, descending=True, block_rows=block_rows)
    totals = settle(table.groupBy(*by).agg(F.sum("cases").alias("_cases"), F.sum("controls").alias("_controls")))
    return ranked.join(totals, list(by)).select(
        *by, risk, F.try_divide("_tp", "_cases").alias("tpr"), F.try_divide("_fp", "_controls").alias("fpr"))


def brier(weighted: DataFrame, by: Sequence[str], risk: str = "risk", weight: str | None = None) -> DataFrame:
    """Weighted mean squared error of the predicted risk at the horizon."""
    b = F.lit(1.0) if weight is None else F.col(weight)
    err = F.when(F.col("case"), F.pow(1 - F.col(risk), F.lit(2.0))).when(F.col("control"), F.pow(F.col(risk), F.lit(2.0))).otherwise(0.0)
    known = weighted.where(F.col(risk).isNotNull())
    return known.groupBy(*by).agg(F.try_divide(F.sum(err * F.col("w") * b), F.sum(b)).alias("brier"))


def null_risk(surv: DataFrame, taus: Sequence[float], strata: Sequence[str] = ()) -> DataFrame:
    """Risk of the model without covariates: one minus Kaplan-Meier at each horizon."""
    return km_at(kaplan_meier(surv, strata), strata, taus).select(*strata, "tau", (1 - F.col("surv")).alias("null_risk"))


def brier_ipa(weighted: DataFrame, surv: DataFrame, by: Sequence[str], taus: Sequence[float], risk: str = "risk",
              strata: Sequence[str] = (), tau: str = "tau") -> DataFrame:
    """Brier score, the null model's score, and the index of prediction accuracy ``1 - brier / null``.

    Both scores come from the same pass over the weighted rows.
    """
    nulls = null_risk(surv, taus, strata).withColumnRenamed("tau", tau)
    both = weighted.where(F.col(risk).isNotNull()).join(F.broadcast(nulls), [*strata, tau])  # a row a stratum and horizon
    def err(p: Column) -> Column:
        return F.when(F.col("case"), F.pow(1 - p, F.lit(2.0))).when(F.col("control"), F.pow(p, F.lit(2.0))).otherwise(0.0) * F.col("w")
    sums = both.groupBy(*by).agg(F.avg(err(F.col(risk))).alias("brier"), F.avg(err(F.col("null_risk"))).alias("null_brier"))
    return sums.withColumn("ipa", 1 - F.try_divide("brier", "null_brier"))


# --- calibration -----------------------------------------------------------------------------------------------


def quantile_strata(df: DataFrame, by: Sequence[str], value: str, n: int, out: str = "stratum", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Equal-count strata from exact value cut-points, so ties stay together; right-closed, lowest value included."""
    cuts = settle(quantiles(df, by, value, [i / n for i in range(1, n)], "_cuts", block_rows))  # one row a group
    joined = df.join(cuts, list(by)) if by else df.withColumn("_k", F.lit(0)).join(F.broadcast(cuts.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return joined.withColumn(out, F.size(F.filter("_cuts", lambda c: c < F.col(value))) + 1).drop("_cuts")


def calibration_quantile(scored: DataFrame, by: Sequence[str], n: int = 20, pred: str = "pred", tau: str = "tau") -> DataFrame:
    """Mean prediction against Kaplan-Meier survival at the horizon, per quantile stratum.

    ``scored`` has one row per patient and horizon with ``time`` and ``event``; ``by`` includes the horizon column.
    """
    rows = settle(quantile_strata(settle(scored.where(F.col(pred).isNotNull())), by, pred, n))
    group = [*by, "stratum"]
    means = rows.groupBy(*group).agg(F.avg(pred).alias("pred"), F.count("*").alias("n"))
    curve = kaplan_meier(rows, group)
    row = F.max_by(F.struct("surv", "lower", "upper"), F.when(F.col("time") <= F.col(tau), F.col("time")))
    at = curve.groupBy(*group).agg(row.alias("_r"), F.max("time").alias("_last"))
    one = F.struct(F.lit(1.0).alias("surv"), F.lit(1.0).alias("lower"), F.lit(1.0).alias("upper"))
    at = at.withColumn("_r", F.when(F.col("_last") >= F.col(tau), F.coalesce("_r", one)))
    return means.join(at, group).select(*group, "n", "pred", "_r.surv", "_r.lower", "_r.upper")


def calibration_curve(predictions: DataFrame, surv: DataFrame, by: Sequence[str], times: Sequence[float], value: str = "surv") -> DataFrame:
    """Mean predicted curve against Kaplan-Meier over the prediction grid, overall or by stratum (``by``)."""
    mean = predictions.groupBy(*by, F.col("time").alias("tau")).agg(F.avg(value).alias("predicted"))
    observed = km_at(kaplan_meier(surv, by), by, times).withColumnRenamed("surv", "observed")
    return mean.join(observed, [*by, "tau"])


def calibration_area(scored: DataFrame, by: Sequence[str], n: int = 20, risk: str = "risk", event: str = "event") -> DataFrame:
    """One minus the signed area between predicted risk and the binned event rate (trapezoid over bins)."""
    rows = quantile_strata(scored.where(F.col(risk).isNotNull()), by, risk, n)
    bins = rows.groupBy(*by, "stratum").agg(F.avg(risk).alias("x"), F.avg(F.col(event).cast("double")).alias("y"))
    return area_of_bins(bins, by)


def area_of_bins(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """One minus the signed area between mean risk ``x`` and event rate ``y`` of the bins (``stratum``), few per group."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("stratum")
    x1, gap, gap1 = F.lead("x").over(w), F.col("x") - F.col("y"), F.lead(F.col("x") - F.col("y")).over(w)
    area = bins.withColumn("_a", (x1 - F.col("x")) * (gap + gap1) / 2)
    return area.groupBy(*by).agg((1 - F.sum("_a")).alias("calibration"))


# --- likelihood and comparison -----------------------------------------------------------------------------------


def discrete_nll(periods: DataFrame, by: Sequence[str] = (), hazard: str = "hazard", pid: str = "pid", eps: float = 1e-7) -> DataFrame:
    """Mean negative log-likelihood per patient from person-period rows with ``died`` / ``survived`` flags."""
    h = F.col(hazard)
    term = F.when(F.col("died"), -F.log(h + eps)).otherwise(0.0) + F.when(F.col("survived"), -F.log(1 - h + eps)).otherwise(0.0)
    per = periods.groupBy(*by, pid).agg(F.sum(term).alias("_nll"))
    return per.groupBy(*by).agg(F.avg("_nll").alias("nll"))


def compare_predictions(scored: DataFrame, models: Sequence[str], tau: float, value: str = "risk", pid: str = "pid") -> DataFrame:
    """Models side by side at one horizon: one row per patient."""
    return to_wide(scored.where(F.col("tau") == F.lit(float(tau))), [pid], "model", value, models)


def comparison_density(scored: DataFrame, x: str, y: str, tau: float, width: float = 0.02, value: str = "risk") -> DataFrame:
    """Counts of patients per square cell of two models' predictions."""
    wide = compare_predictions(scored, [x, y], tau, value)
    return histogram_2d(wide.withColumnsRenamed({x: "_x", y: "_y"}), "_x", "_y", width)


def align_external(scores: DataFrame, value: str = "value", time: str = "time") -> DataFrame:
    """External percentages as risks on our horizons: 183 days mean 182.5, percent becomes a fraction."""
    t = F.col(time).cast("double")
    return scores.withColumns({
        "tau": F.when(t == 183, F.lit(182.5)).otherwise(t), "risk": F.col(value) / 100, "surv": 1 - F.col(value) / 100,
    })
