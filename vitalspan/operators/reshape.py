"""Aggregation and reshaping: profiles, prevalence, masking, long and wide forms, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.aggregates import missing_share
from vitalspan.operators.joins import with_vocabulary
from vitalspan.session import settle


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, name: str = "name",
            value: str = "value") -> DataFrame:
    columns = list(columns or [c for c in df.columns if c not in keys])
    return df.unpivot(list(keys), [F.col(f"`{c}`") for c in columns], name, value)


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, columns: Sequence, agg=F.first) -> DataFrame:
    """Long to wide with a given column list, so no extra pass looks for it."""
    return df.groupBy(*keys).pivot(name, list(columns)).agg(agg(value))


def tagged_union(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union by column name with a column naming the source; missing columns are NULL."""
    parts = [df.withColumn(tag, F.lit(k)) for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def share_within(df: DataFrame, value: str, by: Sequence[str], out: str, scale: float = 1.0) -> DataFrame:
    """Value over the group total. The totals are aggregated and joined, so no group is gathered in one task.

    They are settled, so that the planner knows their size before it decides to move the long side.
    """
    if not by:
        total = df.agg(F.sum(value).alias("_total")).withColumn("_k", F.lit(0))
        joined = df.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").drop("_k")
    else:
        joined = df.join(settle(df.groupBy(*by).agg(F.sum(value).alias("_total"))), list(by))
    return joined.withColumn(out, F.try_divide(F.col(value) * F.lit(scale), F.col("_total"))).drop("_total")


def with_group_stats(df: DataFrame, by: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Repeat group aggregates on every row: aggregate, settle, and join by the true size of the small side."""
    if not by:
        one = df.agg(*[c.alias(n) for n, c in stats.items()]).withColumn("_k", F.lit(0))
        return df.withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k").drop("_k")
    return df.join(settle(df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])), list(by))


def distinct_keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def drop_rare_codes(events: DataFrame, cohort: DataFrame, min_share: float = 0.005, code: str = "code", pid: str = "pid") -> DataFrame:
    """Remove codes held by less than ``min_share`` of the cohort."""
    return events.join(_code_share(events, cohort, code, pid).where(F.col("share") < min_share), code, "left_anti")


def keep_common_codes(events: DataFrame, cohort: DataFrame, min_share: float, code: str = "code", pid: str = "pid") -> DataFrame:
    """Keep codes with strictly more than ``min_share`` of the cohort (rows are already one per patient and code)."""
    counts = events.groupBy(code).agg(F.count("*").alias("n"))
    size = cohort.agg(F.count("*").alias("size")).withColumn("_k", F.lit(0))
    common = counts.withColumn("_k", F.lit(0)).join(F.broadcast(size), "_k").where(F.col("n") > F.col("size") * F.lit(min_share))
    return events.join(common.select(code), code, "left_semi")


def _code_share(events: DataFrame, cohort: DataFrame, code: str, pid: str) -> DataFrame:
    """Distinct patients per code over cohort size. Two plain aggregations: pairs first, then codes."""
    counts = events.select(pid, code).distinct().groupBy(code).agg(F.count("*").alias("n"))
    size = cohort.agg(F.count("*").alias("size")).withColumn("_k", F.lit(0))
    joined = counts.withColumn("_k", F.lit(0)).join(F.broadcast(size), "_k")
    return joined.select(code, (F.col("n") / F.col("size")).alias("share"))


def numeric_profile(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, standard deviation, extremes and percentage missing per column and group, long form, one pass."""
    numeric = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    long = to_long(numeric, by, columns)
    return long.groupBy(*by, "name").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (missing_share("value") * 100).alias("missing"),
    )


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing values for each column, one pass over the table."""
    one = df.agg(*[missing_share(c).alias(c) for c in columns])
    return to_long(one, [], columns, "name", "missing")


def categorical_profile(df: DataFrame, by: Sequence[str], columns: Sequence[str], mask: int | None = None) -> DataFrame:
    """Count and within-group percentage of every level; missing is a level of its own."""
    text = df.select(*by, *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in columns])
    counts = to_long(text, by, columns).groupBy(*by, "name", "value").agg(F.count("*").alias("n"))
    if mask:
        counts = suppress_small_cells(counts, "n", mask)
    return share_within(counts, "n", [*by, "name"], "p", 100.0)


def suppress_small_cells(df: DataFrame, n: str = "n", least: int = 5) -> DataFrame:
    """Raise small counts to ``least``; compute shares afterwards."""
    return df.withColumn(n, F.greatest(F.col(n), F.lit(least).cast("long")))


def event_prevalence(events: DataFrame, cohort: DataFrame, by: str, code: str = "code", pid: str = "pid", least: int = 5) -> DataFrame:
    """Seen and unseen counts per code and cohort group, small cells masked, with percentages.

    The unseen count is the group size minus the seen count, so the patient-by-code grid is never built. A group in
    which a code was never seen still gets its rows; a count of zero has no row.
    """
    seen = (
        events.select(pid, code).distinct().join(cohort.select(pid, by), pid)
        .groupBy(code, by).agg(F.count("*").alias("seen"))
    )
    sizes = cohort.groupBy(by).agg(F.count("*").alias("size"))
    seen = settle(seen)  # read for its codes and for its counts
    grid = with_vocabulary(seen.select(code).distinct(), sizes)
    both = grid.join(seen, [code, by], "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long")))
    cells = both.select(
        by, code,
        F.inline(F.array(
            F.struct(F.lit(True).alias("seen"), F.col("seen").alias("n")),
            F.struct(F.lit(False).alias("seen"), (F.col("size") - F.col("seen")).alias("n")),
        )),
    ).where("n > 0")
    return share_within(suppress_small_cells(cells, "n", least), "n", [code, by], "p", 100.0)


def histogram(df: DataFrame, value: str, width: float, by: Sequence[str] = (), boundary: float = 0.0) -> DataFrame:
    """Counts and shares per equal-width bin, each bin closed on the right."""
    index = F.ceil((F.col(value) - F.lit(boundary)) / F.lit(width)) - 1
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"))
        .withColumn("lower", F.col("bin") * F.lit(width) + F.lit(boundary))
    )
    return share_within(counts, "n", by, "share")


def histogram_2d(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Counts per square cell, left-closed."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(
        F.floor(F.col(x) / F.lit(width)).alias("bin_x"), F.floor(F.col(y) / F.lit(width)).alias("bin_y")
    ).agg(F.count("*").alias("n"))


def complete_grid(df: DataFrame, nesting: Sequence[str], column: str, fill: dict) -> DataFrame:
    """Every combination of the observed ``nesting`` rows and ``column`` values, absent ones filled.

    A null is no value of the column. Values travel in blocks, whatever their number.
    """
    grid = with_vocabulary(df.select(*nesting).distinct(), df.select(column).where(F.col(column).isNotNull()))
    return grid.join(df, [*nesting, column], "left").fillna(fill)


def nest(df: DataFrame, by: Sequence[str], out: str = "data") -> DataFrame:
    """One row per key with its rows as an array of structs. Only for keys with few rows each."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(out))


def unnest(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], F.inline(column))


def value_kind(long: DataFrame, feature: Sequence[str], value: str, levels: Column | None = None) -> DataFrame:
    """Type of each feature: several one-hot columns -> categorical, more than two values -> continuous, else logical."""
    # distinct triples first, so that no reducer meets a raw hot feature
    base = long.select(*feature, F.col(value).alias("_v"), (levels if levels is not None else F.lit(0)).alias("_l")).distinct()
    per = base.groupBy(*feature).agg(
        F.count_distinct("_v").alias("n_values"), F.count_distinct(F.coalesce(F.col("_l").cast("string"), F.lit(""))).alias("n_columns")
    )
    kind = F.when(F.col("n_columns") > 1, "categorical").when(F.col("n_values") > 2, "continuous").otherwise("logical")
    return per.select(*feature, kind.alias("type"))


def signed_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Direction (sign of the sum) and magnitude (sum of absolute values)."""
    return df.groupBy(*by).agg(F.signum(F.round(F.sum(value), 12)).alias("direction"), F.sum(F.abs(value)).alias("magnitude"))


def dense_ranked(df: DataFrame, by: Sequence[str], value: str, out: str = "rank", scale: int = 9) -> DataFrame:
    """Dense rank by descending value. For aggregated tables: one row per feature and group.

    Values are compared at a fixed scale, so the last bits of a floating-point sum cannot split a tie.
    """
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*by).orderBy(F.round(value, scale).desc())))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str | None = None) -> DataFrame:
    """The first ``k`` rows per group. Spark keeps at most ``k`` rows per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return ranked.drop("_rn") if out is None else ranked.withColumnRenamed("_rn", out)
