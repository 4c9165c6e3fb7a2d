"""Analytics over feature attributions ``(pid, feature, shap, vals, timepoint)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.scalars import cut_breaks, feature_stem, from_min_max, recode, split_feature
from vitalspan.operators.joins import join_rounded
from vitalspan.operators.ordered import quantiles, random_rank
from vitalspan.operators.reshape import dense_ranked, share_within, top_k, with_group_stats
from vitalspan.session import settle

# Display names of horizons and feature groups.
TIMEPOINTS = {182.5: "6m", 183.0: "6m", 365.0: "1y", 1095.0: "3y", 1825.0: "5y"}
GROUP_ALIASES = {"diag-simple": "diag-1"}
GROUP_LABELS = {"bioc-1": "Biochemical", "diag-1": "Diagnoses", "clnc-1": "Clinical Characteristics 1",
                "clnc-2": "Clinical Characteristics 2", "proc-1": "Procedures"}
BASE_SURVIVAL = 0.821


def timepoint_label(t: Column) -> Column:
    out = F
    for days, name in TIMEPOINTS.items():
        out = out.when(t.cast("double") == days, F.lit(name))
    return out.otherwise(t.cast("string"))


def with_parts(df: DataFrame) -> DataFrame:
    """Add ``fgroup``, ``fname``, ``fvalue``; group aliases are unified."""
    parts = split_feature("feature")
    return df.withColumns({**parts, "fgroup": recode(parts["fgroup"], GROUP_ALIASES)})


def per_patient(df: DataFrame, by: Sequence[str] = ("timepoint",)) -> DataFrame:
    """Attribution of a whole feature per patient: the sum over its one-hot columns."""
    return df.groupBy(*by, feature_stem("feature").alias("stem"), "pid").agg(F.sum("shap").alias("shap"))


def global_importance(df: DataFrame, by: Sequence[str] = ("timepoint",)) -> DataFrame:
    """Share of the total absolute per-patient attribution, and dense rank, per feature."""
    return importance_of(per_patient(df, by), by)


def importance_of(sums: DataFrame, by: Sequence[str] = ("timepoint",)) -> DataFrame:
    """:func:`global_importance` from the rows of :func:`per_patient`."""
    sums = settle(sums.groupBy(*by, "stem").agg(F.sum(F.abs("shap")).alias("magnitude")))  # a row a feature, read for its total too
    ranked = dense_ranked(share_within(sums, "magnitude", by, "share"), by, "magnitude")
    named = with_parts(ranked.withColumnRenamed("stem", "feature"))
    return named.select(*by, "fgroup", "fname", F.col("share").alias("shap"), "rank")


def group_importance(importance: DataFrame, by: Sequence[str] = ("timepoint",)) -> DataFrame:
    """Share per feature group."""
    sums = importance.groupBy(*by, "fgroup").agg(F.sum("shap").alias("_s"))
    return share_within(sums, "_s", by, "shap").drop("_s")


def cumulative_importance(importance: DataFrame, by: Sequence[str] = ("timepoint",), mark: int = 25) -> DataFrame:
    """Running share in descending order of importance, one row per feature; the top ranks are marked."""
    w = Window.partitionBy(*by).orderBy(F.round("shap", 12).desc(), "fgroup", "fname").rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum("shap").over(w)
    return importance.withColumns({"start": top - F.col("shap"), "end": top, "marked": F.col("rank") <= mark})


def mean_abs_importance(df: DataFrame, by: Sequence[str] = ("timepoint",), k: int | None = None, ties: bool = True) -> DataFrame:
    """Mean absolute per-patient attribution; optionally the top ``k`` with or without ties."""
    means = per_patient(df, by).groupBy(*by, "stem").agg(F.avg(F.abs("shap")).alias("ave"))
    if k is None:
        return means
    if ties:
        w = Window.partitionBy(*by).orderBy(F.col("ave").desc())
        return means.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")
    return top_k(means, by, [F.col("ave").desc(), F.col("stem")], k)


def collapse_one_hot(df: DataFrame, by: Sequence[str] = ("pid", "timepoint"), empty: str = "missing") -> DataFrame:
    """Merge the one-hot columns of a feature: label(s) of the active level, its ordinal, summed attribution.

    Features with a single column keep their value and get no label. Pure aggregation: a feature has few levels.
    """
    rows = df if "fname" in df.columns else with_parts(df)
    level = F.coalesce("fvalue", F.lit(""))
    on = F.when(F.col("vals") == 1, level)
    per = rows.groupBy(*by, "fgroup", "fname").agg(
        F.count("*").alias("_n"), F.sum("shap").alias("shap"), F.max("vals").alias("_x"), F.collect_list(level).alias("_l"), F.collect_list(on).alias("_a"))
    several, active = F.col("_n") > 1, F.array_sort("_a")
    text = F.when(F.size("_a") > 0, F.array_join(F.filter(active, lambda v: v != ""), ";")).otherwise(F.lit(empty))
    place = lambda v: F.array_position(F.array_sort("_l"), v).cast("double")
    ordinal = F.when(F.size("_a") == 0, 0.0).when(F.size("_a") == 1, place(F.get("_a", F.lit(0)))).otherwise(
        F.aggregate("_a", F.lit(0.0), lambda acc, v: acc + place(v)))
    return per.select(
        *by, "fgroup", "fname", F.when(several, text).alias("text"), F.when(several, ordinal).otherwise(F.col("_x")).alias("value"), "shap")


def active_rows(df: DataFrame, by: Sequence[str] = ("pid",), empty: str = "normal", digits: int | None = 1) -> DataFrame:
    """Rows that describe a patient: non-zero levels of one-hot features (one ``empty`` row if there is none), and all
    single-column features, each with the feature's summed attribution."""
    rows = df if "fname" in df.columns else with_parts(df)
    x = F.col("vals") if digits is None else F.round("vals", digits)
    levels = F.array_sort(F.collect_list(F.struct(F.col("fvalue").alias("fvalue"), x.alias("value"))))
    per = rows.groupBy(*by, "fgroup", "fname").agg(F.sum("shap").alias("shap"), levels.alias("_l"))
    nonzero = F.filter("_l", lambda p: p["value"] != 0)
    none = F.array(F.struct(F.lit(empty).alias("fvalue"), F.lit(0.0).alias("value")))
    kept = F.when(F.size("_l") == 1, F.col("_l")).when(F.size(nonzero) > 0, nonzero).otherwise(none)
    return per.select(*by, "fgroup", "fname", "shap", F.inline(kept))


def cumulative_contribution(rows: DataFrame, k: int, base: float = BASE_SURVIVAL, order: str = "magnitude", by: Sequence[str] = ("pid",),
                            label: str = "label") -> DataFrame:
    """Per patient the ``k`` largest contributions and a ``rest`` row, with running start and end values.

    ``order`` is ``magnitude`` (largest first), ``smallest``, ``ascending``, ``descending``, or ``sign``: negative
    and positive parts are accumulated separately so that they meet at the prediction.
    """
    w = Window.partitionBy(*by).orderBy(F.abs("shap").desc(), label)
    ranked = rows.withColumn("_rn", F.row_number().over(w))
    named = ranked.withColumn("label", F.when(F.col("_rn") > k, "rest").otherwise(F.col(label)))
    # a fixed scale keeps signs and order independent of the order of summation
    short = named.groupBy(*by, "label").agg(F.round(F.sum("shap"), 12).alias("shap"))
    short = short.withColumn("dir", F.when(F.col("shap") < 0, "neg").otherwise("pos"))
    whole = Window.partitionBy(*by)
    short = short.withColumn("yhat", F.lit(base) + F.sum("shap").over(whole))
    if order == "sign":
        size = F.abs("shap")
        run = Window.partitionBy(*by).orderBy(F.col("dir").desc(), "shap", "label").rowsBetween(Window.unboundedPreceding, 0)
        positive = F.sum(F.when(F.col("dir") == "pos", F.col("shap")).otherwise(0.0)).over(whole)
        end = F.sum(size).over(run) + F.col("yhat") - positive
        start = end - size
        neg = F.col("dir") == "neg"
        return short.withColumns({"start": F.when(neg, end).otherwise(start), "end": F.when(neg, start).otherwise(end)})
    key = {"magnitude": -F.abs("shap"), "smallest": F.abs("shap"), "ascending": F.col("shap"), "descending": -F.col("shap")}[order]
    run = Window.partitionBy(*by).orderBy(key, "label").rowsBetween(Window.unboundedPreceding, 0)
    end = F.lit(base) + F.sum("shap").over(run)
    return short.withColumns({"start": end - F.col("shap"), "end": end})


def signed_stack(rows: DataFrame, yhat: str = "yhat", by: Sequence[str] = ("pid", "timepoint"), label: str = "fname") -> DataFrame:
    """Stack contributions away from the prediction, positive and negative ones separately, largest first."""
    signed = rows.withColumn("dir", F.when(F.col("shap") < 0, "neg").otherwise("pos"))
    run = Window.partitionBy(*by, "dir").orderBy(F.abs("shap").desc(), label).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col(yhat) + F.sum("shap").over(run)
    return signed.withColumns({"y0": end - F.col("shap"), "y1": end})


def attribution_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Change of attribution between two models: median difference per feature, ranked by its size."""
    left = a.select("pid", "feature", "timepoint", "vals", F.col("shap").alias("shap_a"))
    right = b.select("pid", "feature", "timepoint", "vals", F.col("shap").alias("shap_b"))
    joined = join_rounded(left, right, ["pid", "feature", "timepoint", "vals"])
    sums = joined.groupBy("pid", feature_stem("feature").alias("feature")).agg(
        F.sum("shap_a").alias("shap_a"), F.sum("shap_b").alias("shap_b"))
    deltas = with_parts(sums).withColumn("delta", F.col("shap_b") - F.col("shap_a"))
    medians = quantiles(deltas, ["fname"], "delta", [0.5], "_q").select("fname", F.col("_q")[0].alias("q50"))
    ranks = medians.withColumn("_abs", F.abs("q50")).withColumn("_k", F.lit(0))
    return dense_ranked(ranks, ["_k"], "_abs").drop("_abs", "_k")


# Levels that go first or last when levels are ordered.
FIRST_LEVELS, LAST_LEVELS = ("[0,10]",), ("missing", "nan")


def level_values(collapsed: DataFrame, feature: str = "fname", low: int = 3, high: int = 9) -> DataFrame:
    """Order the levels of each feature and scale values to [0, 1] per feature; missing levels have no value.

    Features with 3 to 9 distinct labels use the level number, the others their own value. The rows are read for their
    labels, for the range of values and for the result, so they are settled; so are the labels, which are few.
    """
    collapsed = settle(collapsed)
    place = F.when(F.col("text").isin(*FIRST_LEVELS), 0).when(F.col("text").isin(*LAST_LEVELS), 2).otherwise(1)
    texts = collapsed.select(feature, "text").distinct()
    w = Window.partitionBy(feature).orderBy("_p", "text")  # one row per label
    known = texts.withColumn("_p", place).where(F.col("text").isNotNull()).withColumn("_lvl", F.row_number().over(w))
    counts = known.groupBy(feature).agg(F.count("*").alias("_n"))
    levels = settle(known.join(counts, feature).select(
        feature, "text", F.when(F.col("_n").between(low, high), F.col("_lvl")).otherwise(1).alias("level"),
        F.col("_n").between(low, high).alias("_use")))
    rows = collapsed.join(levels, [feature, "text"], "left").withColumn("level", F.coalesce("level", F.lit(1)))
    value = F.when(F.coalesce("_use", F.lit(False)), F.col("level").cast("double")).otherwise(F.col("value"))
    value = F.when(F.coalesce(F.col("text").isin(*LAST_LEVELS), F.lit(False)), F.lit(None)).otherwise(value)
    rows = rows.withColumn("_v", value).drop("_use")
    return rescale_within(rows, [feature], "_v", "normalized").drop("_v")


def rescale_within(df: DataFrame, by: Sequence[str], value: str, out: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Group min-max rescale to [lo, hi]; constant groups give NULL."""
    stats = with_group_stats(df, by, {"_lo": F.min(value), "_hi": F.max(value)})
    unit = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return stats.withColumn(out, unit * F.lit(hi - lo) + F.lit(lo)).drop("_lo", "_hi")


def level_labels(levels: DataFrame, feature: str = "fname") -> DataFrame:
    """``name (a/b/c)`` with the labels in level order."""
    texts = levels.where(F.col("text").isNotNull()).select(feature, "level", "text").distinct()
    joined = texts.groupBy(feature).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "text"))), lambda p: p["text"]), "/").alias("levels"))
    return joined.withColumn("label", F.concat(F.col(feature), F.lit(" ("), F.col("levels"), F.lit(")")))


def feature_slice(df: DataFrame, fnames: Sequence[str], timepoint: float | None = None) -> DataFrame:
    """Attribution and active value of chosen features per patient. The filter reaches the scan as a name match."""
    rows = with_parts(df).where(F.col("fname").isin(*fnames))
    if timepoint is not None:
        rows = rows.where(F.col("timepoint") == F.lit(float(timepoint)))
    return collapse_one_hot(rows)


def median_by_level(collapsed: DataFrame, by: Sequence[str] = ("fname", "text")) -> DataFrame:
    """Exact median attribution per feature and level."""
    return quantiles(collapsed, list(by), "shap", [0.5], "_q").select(*by, F.col("_q")[0].alias("median"))


def predicted_bands(rows: DataFrame, base: float = BASE_SURVIVAL, breaks: Sequence[float] = (0, 0.25, 0.5, 0.75, 1.0), limit: float | None = 1.0) -> DataFrame:
    """Prediction rebuilt from attributions, ``base + sum``, and its band."""
    sums = rows.groupBy("pid").agg((F.lit(base) + F.sum("shap")).alias("yhat"))
    if limit is not None:
        sums = sums.where(F.col("yhat") <= limit)
    return sums.withColumn("category", cut_breaks("yhat", breaks))


def sample_cases(bands: DataFrame, k: int = 1, seed: int = 42, shuffle: Column | None = None) -> DataFrame:
    """``k`` random patients per prediction band, reproducible."""
    ranked = random_rank(bands.where(F.col("category").isNotNull()), "pid", ["category"], shuffle, seed=seed, out="_rank")
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def feature_distribution(df: DataFrame, k: int = 10, by: Sequence[str] = ("timepoint",)) -> DataFrame:
    """Direction and share of single feature columns with their rank, top ``k`` per time point."""
    sums = df.groupBy(*by, "feature").agg(F.round(F.sum("shap"), 12).alias("_s"), F.sum(F.abs("shap")).alias("_a"))
    shares = share_within(sums, "_a", by, "shap")
    direction = F.when(F.col("_s") < 0, "non-survival").when(F.col("_s") > 0, "survival").otherwise("0")
    return top_k(shares.withColumn("direction", direction), by, [F.col("shap").desc(), F.col("feature")], k, "rank").drop("_s", "_a")
