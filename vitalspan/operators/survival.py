"""Survival curves and tests. Everything works on the table of distinct times per stratum.

That table is written once, as each curve runs over it several times; its running sums go through
:func:`vitalspan.operators.ordered.running`, so any number of distinct times will do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.scalars import cut_breaks
from vitalspan.operators.ordered import running
from vitalspan.session import settle

Z95 = 1.959963984540054

# Two sets of risk-group breaks (5-year survival).
RISK_BREAKS = (0.0, 0.5, 0.75, 0.875, 0.95, 1.0)
RISK_BREAKS_COARSE = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def cumulate(df: DataFrame, by: Sequence[str], time: str, sums: dict[str, Column | str], descending: bool = False) -> DataFrame:
    """Running sums along distinct times of each stratum (current time included)."""
    return running(df, by, [time], {n: ("sum", v) for n, v in sums.items()}, descending=descending)


def event_table(df: DataFrame, by: Sequence[str] = (), time: str = "time", event: str = "event", weight: str | None = None) -> DataFrame:
    """Distinct times with subjects leaving (``n``), events (``d``) and subjects at risk (``n_risk``)."""
    w = F.lit(1) if weight is None else F.col(weight)
    known = df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
    counts = known.groupBy(*by, time).agg(F.sum(w).alias("n"), F.sum(F.when(F.col(event), w).otherwise(0)).alias("d"))
    return settle(cumulate(settle(counts), by, time, {"n_risk": "n"}, descending=True))


def _product_limit(table: DataFrame, by: Sequence[str], time: str, events: Column, at_risk: Column) -> DataFrame:
    """Add ``surv`` and ``surv_before`` for a running product of ``1 - events / at_risk``, and Greenwood's sum."""
    all_gone = events >= at_risk
    step = F.when(all_gone, F.lit(0.0)).otherwise(F.log1p(-events / at_risk))
    spread = F.when(all_gone, F.lit(0.0)).otherwise(events / (at_risk * (at_risk - events)))
    rows = table.withColumns({"_step": step, "_spread": spread, "_gone": all_gone & (events > 0)})
    rows = cumulate(rows, by, time, {"_log": "_step", "_var": "_spread"})
    return rows.withColumns({
        "surv": F.when(F.col("_gone"), F.lit(0.0)).otherwise(F.exp("_log")),
        "surv_before": F.exp(F.col("_log") - F.col("_step")),
        "var": F.when(~F.col("_gone"), F.col("_var")),
    }).drop("_step", "_spread", "_log", "_var", "_gone")


def kaplan_meier(
    df: DataFrame, by: Sequence[str] = (), time: str = "time", event: str = "event", weight: str | None = None,
    leading_row: bool = False,
) -> DataFrame:
    """Survival curve per stratum with a 95% interval on the log scale.

    ``leading_row`` adds ``(time 0, survival 1)`` to every stratum.
    """
    table = event_table(df, by, time, event, weight)
    rows = _product_limit(table, by, time, F.col("d").cast("double"), F.col("n_risk").cast("double"))
    half = F.lit(Z95) * F.sqrt("var")
    out = rows.withColumns({
        "lower": F.col("surv") * F.exp(-half),
        "upper": F.least(F.lit(1.0), F.when(F.col("var").isNotNull(), F.col("surv") * F.exp(half))),
    })
    out = out.withColumn("upper", F.when(F.col("var").isNotNull(), F.col("upper")))
    cols = [*by, time, "n_risk", F.col("d").alias("n_event"), "surv", "surv_before", "lower", "upper"]
    out = out.select(*cols)
    if leading_row:
        first = out.groupBy(*by).agg(
            F.lit(0).cast(dict(out.dtypes)[time]).alias(time), F.max("n_risk").alias("n_risk"),
            F.lit(0).cast(dict(out.dtypes)["n_event"]).alias("n_event"), F.lit(1.0).alias("surv"),
            F.lit(1.0).alias("surv_before"), F.lit(1.0).alias("lower"), F.lit(1.0).alias("upper"))
        out = first.unionByName(out)
    return out


def censoring_curve(df: DataFrame, by: Sequence[str] = (), time: str = "time", event: str = "event") -> DataFrame:
    """Probability of being uncensored per distinct time: ``g`` and its left limit ``g_before``.

    Events at a time leave the risk set before censorings at the same time.
    """
    table = event_table(df, by, time, event)
    censored = (F.col("n") - F.col("d")).cast("double")
    at_risk = (F.col("n_risk") - F.col("d")).cast("double")
    rows = _product_limit(table, by, time, censored, F.greatest(at_risk, F.lit(1.0)))
    return rows.select(*by, time, F.col("surv").alias("g"), F.col("surv_before").alias("g_before"))


def step_at(curve: DataFrame, by: Sequence[str], taus: Sequence[float], values: dict[str, float | None],
            time: str = "time", extend: bool = True) -> DataFrame:
    """Right-continuous step lookup: the row in force at each ``tau``; before the first row the given defaults.

    One aggregation of the curve, no join. With ``extend`` off, horizons beyond the last time give NULL.
    """
    def at(tau: float) -> Column:
        row = F.max_by(F.struct(*values), F.when(F.col(time) <= F.lit(tau), F.col(time)))
        reached = F.lit(True) if extend else F.max(time) >= F.lit(tau)
        cells = [
            F.when(reached, F.when(row.isNotNull(), row[v]).otherwise(F.lit(default))).alias(v)
            for v, default in values.items()
        ]
        return F.struct(F.lit(float(tau)).alias("tau"), *cells)
    return curve.groupBy(*by).agg(F.array(*[at(t) for t in taus]).alias("_at")).select(*by, F.inline("_at"))


def km_at(curve: DataFrame, by: Sequence[str], taus: Sequence[float], time: str = "time", extend: bool = True) -> DataFrame:
    """Survival and its interval at given horizons; 1 before the first time."""
    return step_at(curve, by, taus, {"surv": 1.0, "lower": 1.0, "upper": 1.0}, time, extend)


def rmst(curve: DataFrame, by: Sequence[str], tau: float, time: str = "time") -> DataFrame:
    """Restricted mean survival: area under the step curve up to ``tau``.

    Written as the sum of drops times their times plus the rest, so no neighbouring row is needed.
    """
    inside = F.col(time) <= F.lit(tau)
    drops = F.sum(F.when(inside, (F.col("surv_before") - F.col("surv")) * F.col(time)).otherwise(0.0))
    left = F.coalesce(F.max_by("surv", F.when(inside, F.col(time))), F.lit(1.0))
    return curve.groupBy(*by).agg((drops + left * F.lit(float(tau))).alias("rmst"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail probability of a standard normal (rational Chebyshev fit, relative error below 1.2e-7)."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the published complementary-error-function fit.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)


def logrank(df: DataFrame, group: str, groups: Sequence, by: Sequence[str] = (), time: str = "time", event: str = "event") -> DataFrame:
    """Two-sample log-rank test: observed and expected events of both groups, chi-square and p-value."""
    a = groups[0]
    known = df.where(F.col(group).isin(*groups) & F.col(time).isNotNull() & F.col(event).isNotNull())
    one = F.col(group) == F.lit(a)
    counts = known.groupBy(*by, time).agg(
        F.count("*").alias("n"), F.count_if(one).alias("n1"),
        F.count_if(F.col(event)).alias("d"), F.count_if(F.col(event) & one).alias("d1"))
    rows = cumulate(settle(counts), by, time, {"r": "n", "r1": "n1"}, descending=True)
    d, r, r1 = F.col("d").cast("double"), F.col("r").cast("double"), F.col("r1").cast("double")
    expected = d * r1 / r
    variance = F.when(r > 1, d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1)).otherwise(0.0)
    sums = rows.groupBy(*by).agg(
        F.sum("n1").alias("n_1"), (F.sum("n") - F.sum("n1")).alias("n_2"),
        F.sum("d1").alias("observed_1"), (F.sum("d") - F.sum("d1")).alias("observed_2"),
        F.sum(expected).alias("expected_1"), (F.sum("d") - F.sum(expected)).alias("expected_2"),
        F.sum(variance).alias("_v"))
    chisq = F.try_divide(F.pow(F.col("observed_1") - F.col("expected_1"), F.lit(2.0)), F.col("_v"))
    return sums.withColumn("chisq", chisq).withColumn("p", normal_two_sided(F.sqrt("chisq"))).drop("_v")


# --- predicted curves ------------------------------------------------------------------------------------------


def hazard_to_survival(hazards: Column) -> Column:
    """Array of conditional hazards to the array of survival probabilities at the interval ends."""
    start = F.struct(F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("out"))
    def step(acc, h):
        p = acc["p"] * (1.0 - h)
        return F.struct(p.alias("p"), F.concat(acc["out"], F.array(p)).alias("out"))
    return F.aggregate(hazards, start, step, lambda acc: acc["out"])


def interpolate_at(
    predictions: DataFrame, by: Sequence[str], taus: Sequence[float], time: str = "time", value: str = "surv",
    clamp: bool = False, out: str = "pred",
) -> DataFrame:
    """Piecewise-linear prediction at each horizon; outside the grid NULL, or the end value with ``clamp``.

    Every break is paired with the next one of its curve (tens of rows per window), and each pair keeps the horizons
    that fall into it, so each (curve, horizon) comes from exactly one row and nothing is gathered or regrouped.
    """
    w = Window.partitionBy(*by).orderBy("_t1")
    ready = predictions.where(F.col(value).isNotNull()).select(
        *by, F.col(time).cast("double").alias("_t1"), F.col(value).cast("double").alias("_s1"))
    pairs = ready.withColumns({
        "_t2": F.lead("_t1").over(w), "_s2": F.lead("_s1").over(w), "_first": F.lag("_t1").over(w).isNull()})
    tau, t1, t2 = F.col("tau"), F.col("_t1"), F.col("_t2")
    inside = lambda t: ((t >= t1) & (t < F.coalesce(t2, F.lit(float("inf"))))) | (F.col("_first") & (t < t1))
    rows = pairs.withColumn("tau", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in taus]), inside)))
    share = (tau - t1) / (t2 - t1)
    within = F.when(tau == t1, F.col("_s1")).when((tau > t1) & t2.isNotNull(), F.col("_s1") + (F.col("_s2") - F.col("_s1")) * share)
    return rows.select(*by, "tau", (F.coalesce(within, F.col("_s1")) if clamp else within).alias(out))


def curve_at(survival: Column, breaks: Sequence[float], tau: float, clamp: bool = False) -> Column:
    """Interpolated value of an array-valued curve on a common grid, without any shuffle."""
    for i, (a, b) in enumerate(zip(breaks, breaks[1:])):
        if a <= tau <= b:
            ya, yb = F.get(survival, F.lit(i)), F.get(survival, F.lit(i + 1))
            return ya if b == a else ya + (yb - ya) * F.lit((tau - a) / (b - a))
    if not clamp:
        return F.lit(None).cast("double")
    return F.get(survival, F.lit(0 if tau < breaks[0] else len(breaks) - 1))


def risk_strata(predictions: DataFrame, value: str = "pred", breaks: Sequence[float] = RISK_BREAKS, out: str = "risk_group") -> DataFrame:
    return predictions.withColumn(out, cut_breaks(value, breaks))


def strata_sizes(strata: DataFrame, by: Sequence[str], group: str = "risk_group") -> DataFrame:
    return strata.groupBy(*by, group).agg(F.count("*").alias("n"))
