"""What the features of a hazard model do: attribution against the whole training matrix, ablation of every feature.

Both work on sparse rows ``(pid, at, x)`` as :func:`hazard_search.sparse_rows` gives them: a feature that a patient lacks costs
nothing unless its training median differs from 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.hazard import ABLATION_TAUS, HazardModel, _interpolation
from vitalspan.operators.hazard_search import cells_of, slices_of, sparse_logits
from vitalspan.operators.ordered import quantiles, running
from vitalspan.operators.resample import hashed_uniform
from vitalspan.session import settle


def ranked_by_hash(rows: DataFrame, key: str = "pid") -> DataFrame:
    """Adds ``rank`` from 0 on in the order of the MD5 of the key, then the key."""
    hashed = rows.withColumn("_token", F.md5(F.col(key).cast("string").cast("binary")))
    placed = running(hashed, [], ["_token", key], {"_rank": ("sum", F.lit(1))})
    return placed.withColumn("rank", F.col("_rank") - 1).drop("_token", "_rank")


def _slopes(model: HazardModel, tau: float, steps: int):
    """The mean gradient of the survival at ``tau`` by each interval's logit, between two rows' logits."""
    times = np.asarray(model.breaks[1:])
    i = min(max(int(np.searchsorted(times, tau, side="right")) - 1, 0), len(times) - 2)
    share = (tau - times[i]) / (times[i + 1] - times[i])
    upto = [(np.arange(len(times)) <= k).astype(float) for k in (i, i + 1)]

    def slopes(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros_like(start)
        for a in (np.arange(steps) + 0.5) / steps:
            hazard = 1 / (1 + np.exp(-(start + a * (end - start))))
            survival = np.cumprod(1 - hazard, axis=1)
            total += hazard * ((1 - share) * survival[:, [i]] * upto[0] + share * survival[:, [i + 1]] * upto[1])
        return total / steps

    return slopes


def attribute_drawn(model: HazardModel, rows: DataFrame, training: DataFrame, tau: float, draws: int = 100, steps: int = 8) -> DataFrame:
    """Expected-gradient attributions ``pid, feature, shap, vals, timepoint`` with backgrounds from the whole training matrix.

    Each patient draws ``draws`` training rows: draw j takes the row whose rank by hash is the hashed uniform number of
    ``pid:j`` times the number of rows. Draws meet their rows in a join by rank, so any training row can be drawn and none
    is collected. A drawn row sends back what its own cells add and one slope an interval, summed by patient on
    the way. Features that neither the patient nor a drawn row has get no row; their attribution is 0.
    """
    spark = rows.sparkSession
    weights = spark.sparkContext.broadcast(np.ascontiguousarray(model.weights.T))
    slopes, intervals = _slopes(model, tau, steps), len(model.breaks) - 1
    ranked = settle(sparse_logits(model, ranked_by_hash(training.select("pid", "at", "x"))).select("rank", "at", "x", F.col("logit").alias("start")))
    total = ranked.count()
    own = settle(sparse_logits(model, rows.select("pid", "at", "x")))
    drawn = own.select("pid", F.col("logit").alias("end"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw"))
    drawn = drawn.withColumn("rank", F.floor(hashed_uniform("pid", "_draw") * F.lit(total)))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per draw: the slopes, and its cells times their weights."""
        for batch in batches:
            for part in slices_of(batch, intervals):
                at, x, starts = cells_of(part)
                start, end = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, intervals) for c in ("start", "end"))
                slope = slopes(start, end)
                row = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
                pid = np.asarray(part.column("pid"))
                effect = (slope[row] * weights.value[at]).sum(axis=1) * x
                places = np.concatenate([at, np.tile(-1 - np.arange(intervals), len(slope))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([pid[row], np.repeat(pid, intervals)])), pa.array(places, pa.int32()), pa.array(np.concatenate([effect, slope.ravel()]))],
                    ["pid", "place", "effect"])

    sums = drawn.join(ranked, "rank").select("pid", "end", "start", "at", "x").mapInArrow(back, "pid bigint, place int, effect double")
    sums = settle(sums.where("place <> 0").groupBy("pid", "place").agg(F.sum("effect").alias("effect")))
    by_interval = F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("k"), F.col("effect").alias("e"))))  # one an interval
    slope = sums.where("place < 0").groupBy("pid").agg(by_interval.alias("_s")).select("pid", F.col("_s.e").alias("slope"))

    def forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The patient's own cells times their weights, over all draws."""
        for batch in batches:
            for part in slices_of(batch, intervals):
                at, x, starts = cells_of(part)
                slope = part.column("slope").flatten().to_numpy(zero_copy_only=False).reshape(-1, intervals)
                row = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
                effect = -(slope[row] * weights.value[at]).sum(axis=1) * x
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(part.column("pid"))[row]), pa.array(at, pa.int32()), pa.array(effect), pa.array(x)], ["pid", "place", "effect", "vals"])

    mine = own.join(slope, "pid").select("pid", "at", "x", "slope").mapInArrow(forth, "pid bigint, place int, effect double, vals double")
    both = mine.where("place > 0").unionByName(sums.where("place > 0").withColumn("vals", F.lit(0.0)))
    names = F.array(*[F.lit(n) for n in model.features])
    return both.groupBy("pid", "place").agg(F.sum("effect").alias("_e"), F.sum("vals").alias("vals")).select(
        "pid", F.get(names, F.col("place") - 1).alias("feature"), (F.col("_e") / F.lit(float(draws))).alias("shap"), "vals", F.lit(float(tau)).alias("timepoint"))


def sparse_medians(rows: DataFrame, columns: int) -> np.ndarray:
    """The exact median of each place over all rows, absent cells as 0; place 0, the intercept, stays 1."""
    total = rows.count()
    cells = rows.select(F.inline(F.arrays_zip("at", "x"))).where("at > 0 AND x <> 0")
    counted = settle(cells.groupBy("at", "x").agg(F.count("*").alias("n")))
    # a median other than 0 needs cells in half of the rows at least
    often = settle(counted.groupBy("at").agg(F.sum("n").alias("_n")).where(F.col("_n") * 2 >= total).select("at", "_n"))
    zeros = often.select("at", F.lit(0.0).alias("x"), (F.lit(total) - F.col("_n")).alias("n")).where("n > 0")
    both = settle(counted.join(often.select("at"), "at").select("at", "x", "n").unionByName(zeros))
    out = np.zeros(columns)
    out[0] = 1
    for r in quantiles(both, ["at"], "x", [0.5], count="n").collect():  # at most a number a column
        out[r["at"]] = r["q"][0]
    return out


def ablation_summary(model: HazardModel, rows: DataFrame, medians: np.ndarray, groups: dict[str, Sequence[int]],
                     taus: Sequence[float] = ABLATION_TAUS, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, tau, n, mean_delta, mean_abs_delta): what survival changes by when a feature's columns are set to their medians.

    ``rows`` are sparse rows with the columns ``by``; ``groups`` are the places (from 1 on) of each feature, apart from each
    other. A task adds the changes up by feature, horizon and group, and nothing else leaves it: no row a patient and feature. A
    patient that has none of a feature's columns, all of them with median 0, changes by 0 and is only counted. Horizons
    outside the model's times have NULL.
    """
    by, names = list(by), list(groups)
    weights = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.weights.T))
    at_taus = _interpolation(model.breaks[1:], taus)
    feature_of = np.full(len(model.features) + 1, -1, dtype=np.int64)
    for g, places in enumerate(groups.values()):
        feature_of[list(places)] = g
    filled = np.flatnonzero((medians != 0) & (feature_of >= 0))
    constant = np.zeros((len(names), len(model.breaks) - 1))
    np.add.at(constant, feature_of[filled], medians[filled, None] * model.weights.T[filled])
    always = np.unique(feature_of[filled])  # features that change for every patient
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    survival = lambda z: np.cumprod(1 / (1 + np.exp(z)), axis=1) @ at_taus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        counts: dict[tuple, int] = {}
        for batch in batches:
            for part in slices_of(batch, len(taus) + weights.value.shape[1]):
                at, x, starts = cells_of(part)
                z = np.add.reduceat(weights.value[at] * x[:, None], starts, axis=0)
                row = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
                own = feature_of[at] >= 0
                key = np.concatenate([row[own] * len(names) + feature_of[at[own]], (np.arange(len(starts))[:, None] * len(names) + always).ravel()])
                shift = np.concatenate([-weights.value[at[own]] * x[own, None], np.zeros((len(starts) * len(always), z.shape[1]))])
                order = np.argsort(key, kind="stable")
                pairs, begins = np.unique(key[order], return_index=True)
                labels = list(zip(*(part.column(c).to_pylist() for c in by), strict=True)) if by else [()] * part.num_rows
                group = {label: i for i, label in enumerate(dict.fromkeys(labels))}
                of_row = np.array([group[label] for label in labels], dtype=np.int64)
                for label, i in group.items():
                    counts[label] = counts.get(label, 0) + int((of_row == i).sum())
                if not len(pairs):
                    continue
                rows_, features_ = pairs // len(names), pairs % len(names)
                change = np.add.reduceat(shift[order], begins, axis=0) + constant[features_]
                delta = survival(z[rows_] + change) - survival(z[rows_])
                for label, i in group.items():
                    mine = of_row[rows_] == i
                    sums = found.setdefault(label, np.zeros((len(names), 2 * len(taus))))
                    np.add.at(sums, features_[mine], np.concatenate([delta[mine], np.abs(delta[mine])], axis=1))
        for label, n in counts.items():
            sums = found.get(label, np.zeros((len(names), 2 * len(taus))))
            size = len(names) * len(taus)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * size, type=types[c]) for c, v in zip(by, label, strict=True)] + [
                    pa.array(np.repeat(names, len(taus))), pa.array(np.tile(np.asarray(taus, dtype=float), len(names))), pa.array([n] * size, pa.int64()),
                    pa.array(sums[:, : len(taus)].ravel()), pa.array(sums[:, len(taus) :].ravel())],
                [*by, "feature", "tau", "n", "total", "size"])

    types = {f.name: t for f, t in zip(rows.schema.fields, _arrow_types(rows), strict=True) if f.name in by}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "feature string, tau double, n bigint, total double, size double"])
    parts = rows.select(*by, "at", "x").mapInArrow(run, schema)
    sums = parts.groupBy(*by, "feature", "tau").agg(F.sum("n").alias("n"), F.sum("total").alias("_t"), F.sum("size").alias("_s"))
    mean = lambda c: F.when(F.col("tau").between(model.breaks[1], model.breaks[-1]), F.col(c) / F.col("n"))
    return sums.select(*by, "feature", "tau", "n", mean("_t").alias("mean_delta"), mean("_s").alias("mean_abs_delta"))


def _arrow_types(df: DataFrame) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    return [to_arrow_type(f.dataType) for f in df.schema.fields]
