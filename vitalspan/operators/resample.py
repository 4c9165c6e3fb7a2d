"""Resampling intervals, paired contrasts and multiple-testing adjustment.

Replicates are Poisson-weighted copies of the data. The weight of a row in a replicate is a function of a hash of its key,
so all models see the same weights (paired contrasts) and lost tasks reproduce them. Weights are worked out once a key.
Means are sums of matrices, rows by replicates, and Brier scores and calibration explode replicates inside the map side of an
aggregation, so one row per group, replicate and batch or task is shuffled; for the AUC each row is shuffled once with its weights, and a score that many rows share is summed up by replicate before that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.operators.metrics import area_of_bins, brier, quantile_strata
from vitalspan.operators.ordered import running, with_blocks
from vitalspan.operators.survival import normal_two_sided
from vitalspan.session import settle

#: Rows of a block of the bootstrap of the AUC.
BOOTSTRAP_ROWS = 1 << 16
#: A score that more rows share is one row with its sums by replicate, which then are no larger than the rows.
SHARED_ROWS = 16
#: Rows whose weights are unfolded at once, and keys whose weights are worked out at once.
UNFOLDED_ROWS, HASHED_KEYS = 1 << 13, 1 << 10
#: Rows that a task adds up at once by replicate.
SUMMED_ROWS = 1 << 15


def poisson_steps() -> tuple[float, ...]:
    """Cumulative probabilities of a Poisson variable with mean 1, up to the last one below 1 in double precision."""
    steps, term, total, k = [], math.exp(-1.0), 0.0, 0
    while total + term > total and total + term < 1.0:
        total += term
        steps.append(total)
        k += 1
        term /= k
    return tuple(steps)


POISSON_CDF = poisson_steps()


def hashed_uniform(key: str, replicate: str) -> Column:
    """Uniform number in [0, 1): the first 48 bits of the MD5 of ``key:replicate``, the same in any SQL engine."""
    return _uniform(F.col(key), F.col(replicate))


def _uniform(key: Column, replicate: Column) -> Column:
    text = F.concat_ws(":", key.cast("string"), replicate.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def key_weights(df: DataFrame, key: str, n: int) -> DataFrame:
    """(_key, _weights) of each key of ``df``: its weights in replicates 0 to n, as one character each (character 48 is weight 0).

    Models and horizons share them. The MD5s of a key, n of them, are most of the work, so they are worked out once a key.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    # few bytes but much hashing: dealt before they are made different, as a later deal would be left out and the tasks merged
    keys = df.select(F.col(key).alias("_key")).repartition(tasks, "_key").distinct()
    suffixes = [str(r).encode() for r in range(1, n + 1)]
    steps = np.asarray(POISSON_CDF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HASHED_KEYS):
                part = batch.slice(at, HASHED_KEYS)
                heads = [b"" if t is None else t.encode() + b":" for t in part.column("_text").to_pylist()]
                raw = b"".join([hashlib.md5(h + s, usedforsecurity=False).digest()[:6] for h in heads for s in suffixes])
                numbers = np.zeros((len(heads), n, 8), dtype=np.uint8)
                numbers[:, :, 2:] = np.frombuffer(raw, dtype=np.uint8).reshape(len(heads), n, 6)
                uniform = numbers.view(">u8").reshape(len(heads), n) / float(1 << 48)
                texts = np.full((len(heads), n + 1), 49, dtype=np.uint8)
                texts[:, 1:] = 48 + np.searchsorted(steps, uniform, side="right")
                ends = np.arange(len(heads) + 1, dtype=np.int32) * (n + 1)
                weights = pa.StringArray.from_buffers(len(heads), pa.py_buffer(ends), pa.py_buffer(texts))
                yield pa.RecordBatch.from_arrays([part.column("_key"), weights], ["_key", "_weights"])

    kind = keys.schema["_key"].dataType.simpleString()
    return keys.withColumn("_text", F.col("_key").cast("string")).mapInArrow(run, f"_key {kind}, _weights string")


def with_weights(df: DataFrame, key: str, n: int, keys: DataFrame | None = None) -> DataFrame:
    """Rows with the text of their key's weights; they meet in a sort-merge join, as their number is unknown to the planner.

    ``keys`` is where the keys are read, ``df`` itself if it is not given.
    """
    weights = key_weights(df if keys is None else keys, key, n)
    return df.hint("merge").join(weights, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def with_replicates(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows for replicates 1..n with weight ``w_boot``; replicate 0 carries the original data with weight 1.

    Copies that would get weight 0 are dropped.
    """
    rows = with_weights(df, key, n).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n))))
    rows = rows.withColumn("w_boot", F.ascii(F.expr("substring(_weights, replicate + 1, 1)")) - 48)
    return rows.where("w_boot > 0").drop("_weights")


def weighted_sums(rows: DataFrame, by: Sequence[str], values: Sequence[str], n: int) -> DataFrame:
    """(by, replicate, values, _weight): sums of values times weights, and of weights, over rows with the text ``_weights``.

    A task adds up some ``SUMMED_ROWS`` rows at once, as matrices of rows by replicates, and returns one row a group of these;
    unknown values count nothing, and replicates in which a group has no weight have no row.
    """
    def add(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        group = table.select(list(by)).to_pandas().groupby(list(by), dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        begins = np.flatnonzero(np.diff(group[order], prepend=-1))
        text = table.column("_weights").take(pa.array(order)).to_pylist()
        weights = np.frombuffer("".join(text).encode(), dtype=np.uint8).reshape(len(order), n + 1).astype(np.float64) - 48
        out = [table.column(c).take(pa.array(order[begins])).combine_chunks() for c in by]
        for c in values:
            x = table.column(c).fill_null(0.0).to_numpy()[order][:, None]
            out.append(np.add.reduceat(weights * x if np.isfinite(x).all() else np.where(weights > 0, weights * x, 0), begins, axis=0))
        out.append(np.add.reduceat(weights, begins, axis=0))
        ends = pa.array(np.arange(len(begins) + 1) * (n + 1), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) if isinstance(x, np.ndarray) else x for x in out]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        return pa.RecordBatch.from_arrays(lists, [*by, *values, "_weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= SUMMED_ROWS:
                yield add(held)
                held, size = [], 0
        if held:
            yield add(held)

    cells = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in values], "_weights")
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    summed = cells.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"`{c}` array<double>" for c in [*values, "_weight"])]))
    each = summed.select(*by, F.posexplode(F.arrays_zip(*values, "_weight")).alias("replicate", "_at")).where("_at._weight > 0")
    return each.groupBy(*by, "replicate").agg(*[F.sum(f"_at.{c}").alias(c) for c in [*values, "_weight"]])


def interval_of(replicates: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Estimate from replicate 0 and percentile interval from the others. One row per replicate goes in."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    boot = F.when(F.col("replicate") > 0, F.col(value))
    return replicates.groupBy(*by).agg(
        F.max(F.when(F.col("replicate") == 0, F.col(value))).alias("estimate"),
        F.percentile(boot, F.lit(lo)).alias("lower"), F.percentile(boot, F.lit(hi)).alias("upper"),
        F.stddev_samp(boot).alias("se"))


def bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, key: str, n: int = 200, level: float = 0.95) -> DataFrame:
    """Mean with a percentile interval."""
    rows = settle(df.select(*by, key, F.col(value).alias("_x")))  # read for its keys and for its rows
    known = F.col("_x").isNotNull().cast("double").alias("_known")
    sums = weighted_sums(with_weights(rows, key, n).select(*by, "_x", known, "_weights"), by, ["_x", "_known"], n)
    means = sums.select(*by, "replicate", F.when(F.col("_known") > 0, F.col("_x") / F.col("_weight")).alias("_m"))
    return interval_of(means, by, "_m", level)


def bootstrap_auc(weighted: DataFrame, by: Sequence[str], n: int = 100, key: str = "pid", risk: str = "risk",
                  block_rows: int = BOOTSTRAP_ROWS) -> DataFrame:
    """AUC per group and replicate (0 is the original data), with each row sorted and sent once.

    Rows carry their weights as a short text. Where more than ``SHARED_ROWS`` rows have a score, they are added up by
    replicate on the map side and go on as one row, so that a score of a third of all rows is no task's burden. Rows
    are cut into blocks of the order of scores. A task returns, for its block and each replicate, the weight of cases,
    of controls, and of pairs won inside the block; what the cases win against earlier blocks follows from the running
    sum of the controls.
    """
    cases, controls = (F.sum(F.when(F.col(c), F.col("w")).otherwise(0.0)).alias(f"_{c}") for c in ("case", "control"))
    rows = weighted.where(F.col(risk).isNotNull()).groupBy(*by, key, F.col(risk).cast("double").alias("_risk")).agg(cases, controls)
    rows = settle(rows.where("_case > 0 OR _control > 0"))
    group = [*by, "_block"]
    scores = rows.groupBy(*by, "_risk").agg((F.count(F.lit(1)) > SHARED_ROWS).alias("_shared"))
    scores = settle(with_blocks(scores, by, ["_risk"], max(1, block_rows // SHARED_ROWS)).select(*group, "_risk", "_shared"))
    placed = settle(with_weights(rows.join(scores, [*by, "_risk"]), key, n, rows).select(*group, "_risk", "_shared", "_case", "_control", "_weights"))
    sums = weighted_sums(placed.where("_shared"), [*group, "_risk"], ["_case", "_control"], n)
    vector = F.collect_list(F.struct("replicate", "_case", "_control")).alias("_sums")  # one element a replicate
    merged = sums.groupBy(*group, "_risk").agg(vector)
    rest = placed.where("NOT _shared").drop("_shared")
    rows = rest.unionByName(merged, allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def unfold(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Weights of cases and of controls by row and replicate."""
        single = part["_weights"].notna().to_numpy()
        text = "".join(w if one else "0" * (n + 1) for w, one in zip(part["_weights"], single, strict=True))
        weights = np.frombuffer(text.encode(), dtype=np.uint8).reshape(len(part), n + 1).astype(np.float64) - 48
        cases, controls = (weights * part[c].fillna(0.0).to_numpy()[:, None] for c in ("_case", "_control"))
        for i in np.flatnonzero(~single):
            for x in part["_sums"].iloc[i]:
                cases[i, x["replicate"]], controls[i, x["replicate"]] = x["_case"], x["_control"]
        return cases, controls

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_risk", kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(pdf["_risk"].to_numpy()) != 0))
        ends = np.append(first[1:], len(pdf))
        parts, at = [], 0
        while at < len(first):  # whole scores, about UNFOLDED_ROWS rows at a time
            to = max(at + 1, int(np.searchsorted(ends, first[at] + UNFOLDED_ROWS, side="right")))
            own = unfold(pdf.iloc[first[at] : ends[to - 1]])
            parts.append([np.add.reduceat(x, first[at:to] - first[at]) for x in own])  # equal scores are one
            at = to
        cases, controls = (np.concatenate(x) for x in zip(*parts, strict=True))
        won = (cases * (np.cumsum(controls, axis=0) - controls / 2)).sum(axis=0)
        out = pd.DataFrame({"replicate": np.arange(n + 1), "_cases": cases.sum(axis=0), "_controls": controls.sum(axis=0), "_won": won})
        for c in reversed(group):
            out.insert(0, c, [pdf[c].iloc[0]] * (n + 1))
        return out

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in group), "replicate int, _cases double, _controls double, _won double"])
    parts = rows.select(*group, "_risk", "_case", "_control", "_weights", "_sums").groupBy(*group).applyInPandas(block, schema)
    earlier = Window.partitionBy(*by, "replicate").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_before", F.coalesce(F.sum("_controls").over(earlier), F.lit(0.0)))
    sums = placed.groupBy(*by, "replicate").agg(
        F.sum(F.col("_won") + F.col("_cases") * F.col("_before")).alias("_won"), F.sum("_cases").alias("_cases"), F.sum("_controls").alias("_controls"))
    return sums.select(*by, "replicate", F.try_divide(F.col("_won"), F.col("_cases") * F.col("_controls")).alias("auc"))


def bootstrap_calibration(scored: DataFrame, by: Sequence[str], n: int = 100, key: str = "pid", bins: int = 20, risk: str = "risk",
                          event: str = "event") -> DataFrame:
    """Calibration area per group and replicate. The bins are those of the original data; replicates weigh their rows."""
    rows = settle(quantile_strata(scored.where(F.col(risk).isNotNull()), by, risk, bins))
    return area_of_bins(
        with_replicates(rows, key, n).groupBy(*by, "replicate", "stratum").agg(
            (F.sum(F.col(risk) * F.col("w_boot")) / F.sum("w_boot")).alias("x"),
            (F.sum(F.when(F.col(event), F.col("w_boot")).otherwise(0)) / F.sum("w_boot")).alias("y")),
        [*by, "replicate"])


def bootstrap_metric(weighted: DataFrame, by: Sequence[str], metric: str, n: int = 100, key: str = "pid") -> DataFrame:
    """``auc``, ``brier`` or ``calibration`` per group and replicate (0 is the original data)."""
    if metric == "auc":
        return bootstrap_auc(weighted, by, n, key)
    if metric == "calibration":
        return bootstrap_calibration(weighted, by, n, key)
    return brier(with_replicates(settle(weighted), key, n), [*by, "replicate"], weight="w_boot")


def bootstrap_ci(weighted: DataFrame, by: Sequence[str], metric: str, n: int = 100, key: str = "pid", level: float = 0.95) -> DataFrame:
    return interval_of(bootstrap_metric(weighted, by, metric, n, key), by, metric, level)


def contrast(weighted: DataFrame, reference: str, metric: str, by: Sequence[str] = ("tau",), model: str = "model", n: int = 100,
             key: str = "pid", level: float = 0.95) -> DataFrame:
    """Difference of a metric between every model and the reference, paired by replicate, with interval and p-value."""
    values = bootstrap_metric(weighted, [model, *by], metric, n, key)
    base = values.where(F.col(model) == reference).select(*by, "replicate", F.col(metric).alias("_base"))
    delta = values.where(F.col(model) != reference).join(base, [*by, "replicate"]).withColumn("delta", F.col(metric) - F.col("_base"))
    out = interval_of(delta, [model, *by], "delta", level).withColumnRenamed("estimate", "delta")
    return out.withColumn("p", normal_two_sided(F.try_divide("delta", "se")))


def adjust_bh(df: DataFrame, p: str = "p", key: Sequence[str] = (), by: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """False-discovery-rate adjustment: the running minimum of ``p * m / rank`` from the largest p down."""
    ranked = running(df.where(F.col(p).isNotNull()), by, [p, *key], {"_rank": ("sum", F.lit(1))})
    sizes = df.where(F.col(p).isNotNull()).groupBy(*by).agg(F.count("*").alias("_m"))
    joined = ranked.join(sizes, list(by)) if by else ranked.withColumn("_k", F.lit(0)).join(F.broadcast(sizes.withColumn("_k", F.lit(0))), "_k").drop("_k")
    raw = joined.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    adjusted = running(raw, by, ["_rank"], {"_low": ("min", "_raw")}, descending=True)
    return adjusted.withColumn(out, F.least(F.lit(1.0), F.col("_low"))).drop("_rank", "_m", "_raw", "_low")

