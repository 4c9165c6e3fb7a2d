"""Hazard models of sparse features at a study's width, any number of folds and penalties at once.

The likelihood of the discrete-time model separates by interval, so a model of k intervals is k logistic problems over the
same rows, and models of other folds and penalties are more columns of the same weight matrix. Other settings of the
features (windows, code levels) are more rows of it, met by the patients' rows of that setting. A pass over all rows
gives the losses and gradients of all problems together: a task keeps the patients' known cells, one sum a
feature and problem leaves it. The optimiser (limited-memory quasi-Newton steps, each problem with its own step
length) sees these sums alone, whose size is that of the coefficients asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.features import kfold_assign, search_overrides, study_features, study_patients, study_vocabulary, survival_labels
from vitalspan.operators.hazard import HazardModel
from vitalspan.session import settle

#: Features whose sums travel in one row.
CHUNK = 256
#: Numbers that a task works out at once.
WORK = 1 << 22
#: Rows times problems that are worked out together.
BLOCK = 1 << 16
#: Rows are a dense matrix if this has at most so many numbers a known cell.
DENSE = 32
#: A coefficient is settled when the mean residual over the rows that have its feature is below this.
TOLERANCE = 1e-4
MEMORY = 10
EPS = 1e-7


@dataclass(frozen=True)
class Problems:
    """The models asked for: the fold each leaves out (-1: none) and its penalty, every one with ``intervals`` problems.

    They are fitted for every setting; a setting's columns, its intercept first, begin where ``settings`` says.
    """

    held: np.ndarray
    penalty: np.ndarray
    intervals: int
    columns: int
    settings: tuple[int, ...] = (0,)

    @property
    def size(self) -> int:
        return len(self.held) * self.intervals


def sparse_cells(long: DataFrame, vocabulary: DataFrame, patients: DataFrame, first: int = 0) -> DataFrame:
    """The patients' rows with ``at`` and ``x``: places and values of their known cells other than 0, in order.

    ``long`` has ``pid, feature, value``, ``vocabulary`` has ``feature, column_index``; place ``first`` is the intercept, of value 1.
    """
    cell = F.struct((F.col("column_index") + first + 1).cast("int").alias("i"), F.col("value").cast("double").alias("x"))
    cells = long.join(vocabulary, "feature").where("value <> 0").groupBy("pid").agg(F.array_sort(F.collect_list(cell)).alias("_m"))
    intercept = F.array(F.struct(F.lit(first).alias("i"), F.lit(1.0).alias("x")))
    joined = patients.join(cells, "pid", "left").withColumn("_m", F.concat(intercept, F.coalesce("_m", F.array())))
    return joined.select(*patients.columns, F.col("_m.i").alias("at"), F.col("_m.x").alias("x"))


def sparse_rows(long: DataFrame, vocabulary: DataFrame, labels: DataFrame, setting: int = 0, first: int = 0) -> DataFrame:
    """(pid, setting, at, x, died, survived, fold) a patient of ``labels``, which may bring a ``fold``, else it is 0."""
    fold = F.col("fold") if "fold" in labels.columns else F.lit(0)
    known = labels.select("pid", F.lit(setting).alias("setting"), "died", "survived", fold.cast("int").alias("fold"))
    return sparse_cells(long, vocabulary, known, first).select("pid", "setting", "at", "x", "died", "survived", "fold")


def cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of all cells of a batch, and where each row's begin."""
    starts = np.concatenate([[0], np.cumsum(batch.column("at").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    at, x = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "x"))
    return at.astype(np.int64), x, starts[:-1]


def slices_of(batch: pa.RecordBatch, problems: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``WORK`` numbers, cells times problems, or one row."""
    ends = np.cumsum(batch.column("at").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    row = 0
    while row < batch.num_rows:
        before = ends[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(ends, before + WORK // max(1, problems), side="right")))
        yield batch.slice(row, to - row)
        row = to


def _batches(batches: Iterator[pa.RecordBatch], problems: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Slices of rows: places, values, row starts, labels, folds, settings, numbers of patients."""
    for batch in batches:
        for part in slices_of(batch, problems):
            died, survived = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64) for c in ("died", "survived"))
            fold, setting = (part.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "setting"))
            n = part.column("n").to_numpy(zero_copy_only=False).astype(np.float64) if "n" in part.schema.names else np.ones(part.num_rows)
            yield (*cells_of(part), died, survived, fold, setting, n)


def merged(rows: DataFrame, intervals: int) -> DataFrame:
    """Patients with the same cells in a setting and fold as one row: ``died`` and ``survived`` count them, ``n`` is their number."""
    count = lambda c: F.array(*[F.sum(F.get(c, F.lit(i)).cast("long")) for i in range(intervals)]).alias(c)
    return rows.groupBy("setting", "fold", "at", "x").agg(count("died"), count("survived"), F.count("*").alias("n"))


def _logits(weights: np.ndarray, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[at] * x[:, None], starts, axis=0)  # no row is empty: each has its intercept


def _to_columns(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds values to the rows of ``total`` they belong to."""
    order = np.argsort(at, kind="stable")
    places, begins = np.unique(at[order], return_index=True)
    total[places] += np.add.reduceat(values[order], begins, axis=0)


class _Cells:
    """The cells of some rows over the columns they use: as a dense matrix, or as a list where that would be mostly zeros."""

    def __init__(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray, columns: int):
        used = np.zeros(columns, dtype=bool)
        used[at] = True
        self.used, self.x, self.starts = np.flatnonzero(used), x, starts
        self.at = (np.cumsum(used) - 1)[at]
        self.row = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
        width = len(self.used)
        self.dense = None
        if width * len(starts) <= DENSE * len(at):
            self.dense = np.bincount(self.row * width + self.at, weights=x, minlength=len(starts) * width).reshape(len(starts), width)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        return self.dense @ weights if self.dense is not None else _logits(weights, self.at, self.x, self.starts)

    def sums(self, values: np.ndarray, power: int = 1) -> np.ndarray:
        """Sums over the rows of their values times a column's cells, or the squares (2) or sizes (0) of these."""
        change = {0: np.abs, 1: lambda x: x, 2: np.square}[power]
        if self.dense is not None:
            return change(self.dense).T @ values
        out = np.zeros((len(self.used), values.shape[1]))
        _to_columns(out, self.at, values[self.row] * change(self.x)[:, None])
        return out


def _blocks(batches: Iterator[pa.RecordBatch], problems: Problems) -> Iterator[tuple]:
    """Rows of one setting and fold, few enough for what is worked out on them to stay in a core's cache."""
    for at, x, starts, died, survived, fold, setting, n in _batches(batches, problems.size):
        ends = np.append(starts[1:], len(at))
        turns = np.flatnonzero((np.diff(fold) != 0) | (np.diff(setting) != 0)) + 1
        for begin, end in zip([0, *turns], [*turns, len(starts)]):
            step = max(1, BLOCK // max(1, problems.size))
            for i in range(begin, end, step):
                j = min(i + step, end)
                own = slice(starts[i], ends[j - 1])
                yield _Cells(at[own], x[own], starts[i:j] - starts[i], problems.columns), died[i:j], survived[i:j], int(fold[i]), int(setting[i]), n[i:j].sum()


def _sums(problems: Problems, weights: Broadcast | None, salts: int, held_out: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: gradients and losses at the weights, or the held-out losses alone; without weights, curvatures, exposures and numbers of rows."""
    models, intervals = len(problems.held), problems.intervals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((problems.columns, 1 if weights else 2, models, intervals))
        extra = np.zeros((3, len(problems.settings), models, intervals))
        for cells, died, survived, fold, setting, n in _blocks(batches, problems):
            known = np.flatnonzero((problems.held == fold) if held_out else (problems.held != fold))
            rows = died + survived
            place = np.ix_(cells.used, [0], known)
            if weights is None:
                both = np.stack([cells.sums(rows, 2) / 4, cells.sums(rows, 0)], axis=1)
                total[np.ix_(cells.used, [0, 1], known)] += both[:, :, None, :]
                extra[0, setting, known] += rows.sum(axis=0)
                extra[2, setting, problems.held == fold] += n
                continue
            if not len(known):
                continue
            own = weights.value.reshape(problems.columns, models, intervals)[np.ix_(cells.used, known)]
            z = cells.logits(own.reshape(len(cells.used), -1)).reshape(len(rows), len(known), intervals)
            if held_out:
                hazard = 1 / (1 + np.exp(-z))
                extra[1, setting, known] += (-died[:, None, :] * np.log(hazard + EPS) - survived[:, None, :] * np.log(1 - hazard + EPS)).sum(axis=0)
                continue
            np.maximum(z, -700, out=z)  # no overflow below
            odds = np.exp(-z)
            odds += 1
            z += np.log(odds)  # log(1 + exp(z))
            dead = cells.sums(died)
            extra[0, setting, known] += np.einsum("ni,nmi->mi", rows, z) - np.einsum("ci,cmi->mi", dead, own)
            hazard = np.divide(rows[:, None, :], odds, out=odds)
            gradient = cells.sums(hazard.reshape(len(rows), -1)).reshape(len(cells.used), len(known), intervals) - dead[:, None, :]
            total[place] += gradient[:, None]
        keys, values = [-1], [extra.tobytes()]
        total = total.reshape(problems.columns, -1)
        for c in range(0, problems.columns, CHUNK):
            if (part := total[c : c + CHUNK]).any():
                keys.append(c)
                values.append(part.tobytes())
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([salt] * len(keys), pa.int32()), pa.array(values, pa.binary())], ["key", "salt", "sums"])

    return run


_PARTS = "key int, salt int, sums binary"


def _add(group: pa.Table) -> pa.Table:
    total = None
    for raw in group.column("sums"):
        own = np.frombuffer(raw.as_py())
        total = own if total is None else total + own
    return pa.table({"key": group.column("key").slice(0, 1), "salt": group.column("salt").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows over all cores: a pass costs far more than a row's bytes tell the planner, which would merge them into few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _pass(rows: DataFrame, problems: Problems, weights: np.ndarray | None, held_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all tasks, added in two steps so that no group has one from every task."""
    spark = rows.sparkSession
    salts = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    sent = None if weights is None else spark.sparkContext.broadcast(weights)
    parts = rows.drop("pid").mapInArrow(_sums(problems, sent, salts, held_out), _PARTS)
    if salts > 1:
        parts = parts.groupBy("key", "salt").applyInArrow(_add, _PARTS)
    width = problems.size * (1 if weights is not None else 2)
    total = np.zeros((problems.columns, width))
    extra = np.zeros((3, len(problems.settings), len(problems.held), problems.intervals))
    for r in parts.groupBy("key").applyInArrow(_add, _PARTS).toLocalIterator():
        own = np.frombuffer(r["sums"])
        if r["key"] < 0:
            extra = own.reshape(extra.shape)
        else:
            total[r["key"] : r["key"] + CHUNK] = own.reshape(-1, width)
    if sent is not None:
        sent.destroy()
    return total, extra


@dataclass(frozen=True)
class Fits:
    """Weights (column, model, interval); the mean held-out loss of each setting's models, their largest relative
    gradients (setting, model, interval), and the passes it took."""

    weights: np.ndarray
    loss: np.ndarray
    gradient: np.ndarray
    passes: int


class _Blocks:
    """Sums and largest values over the columns of each setting, and what a setting has given to all its columns."""

    def __init__(self, problems: Problems):
        self.begins = np.array(problems.settings)
        self.widths = np.diff(self.begins, append=problems.columns)

    def sum(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.begins, axis=0)

    def most(self, x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x, self.begins, axis=0)

    def spread(self, x: np.ndarray) -> np.ndarray:
        return np.repeat(x, self.widths, axis=0)


def fit_all(rows: DataFrame, problems: Problems, max_passes: int = 200, tolerance: float = TOLERANCE) -> Fits:
    """All problems fitted together.

    Minimises the mean logistic loss over a model's person-period rows plus half its penalty times the squared weights.
    The steps are preconditioned by an upper bound of each coefficient's curvature; a problem whose step does not lower its
    loss enough halves it while the others go on.
    """
    rows = settle(dealt(rows).sortWithinPartitions("setting", "fold"))
    blocks, settings, models = _Blocks(problems), len(problems.settings), len(problems.held)
    first, extra = _pass(rows, problems, None)
    # rows of each setting's model, for all its problems
    n = np.maximum(np.repeat(extra[0].sum(axis=2), problems.intervals, axis=1), 1)
    n_all = blocks.spread(n)
    held_out = extra[2][:, :, 0]
    penalty = np.repeat(problems.penalty, problems.intervals)
    curvature, exposure = first[:, : problems.size] / n_all + penalty, first[:, problems.size :] / n_all
    scale = np.where(curvature > 0, 1 / np.maximum(curvature, 1e-300), 0)

    def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, own = _pass(rows, problems, w)
        value = own[0].reshape(settings, -1) / n + penalty / 2 * blocks.sum(w * w)
        return value, total / n_all + penalty * w

    def off(g: np.ndarray) -> np.ndarray:
        return blocks.most(np.abs(g) / np.maximum(exposure, 1e-300) * (exposure > 0))

    w = np.zeros((problems.columns, problems.size))
    value, grad = evaluate(w)
    passes, pairs = 2, []
    step = np.ones_like(value)
    direction = -scale * grad
    while passes < max_passes:
        open_ = off(grad) > tolerance
        if not open_.any() or (step[open_] < 1e-10).all():
            break
        slope = blocks.sum(direction * grad)
        direction = np.where(blocks.spread(slope >= 0), -scale * grad, direction)
        slope = blocks.sum(direction * grad)
        trial = np.where(blocks.spread(open_), w + blocks.spread(step) * direction, w)
        new_value, new_grad = evaluate(trial)
        passes += 1
        good = open_ & (new_value <= value + 1e-4 * step * slope + 1e-15)
        taken = blocks.spread(good)
        moved, turned = np.where(taken, trial - w, 0), np.where(taken, new_grad - grad, 0)
        curved = blocks.sum(moved * turned)
        pairs = [*pairs[-MEMORY + 1 :], (moved, turned, np.where(curved > 1e-300, 1 / np.maximum(curved, 1e-300), 0))]
        w, grad, value = np.where(taken, trial, w), np.where(taken, new_grad, grad), np.where(good, new_value, value)
        step = np.where(good, 1.0, step / 2)
        direction = np.where(taken, _two_loops(grad, pairs, scale, blocks), direction)
    missed = _pass(rows, problems, w, held_out=True)[1][1].sum(axis=2)  # of the weights that are returned
    loss = np.where(held_out > 0, missed / np.maximum(held_out, 1), np.nan)
    return Fits(w.reshape(problems.columns, models, -1), loss, off(grad).reshape(settings, models, -1), passes + 1)


def _two_loops(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], scale: np.ndarray, blocks: _Blocks) -> np.ndarray:
    """The quasi-Newton direction of every problem from its last steps and changes of gradient."""
    q, kept = grad.copy(), []
    for moved, turned, rho in reversed(pairs):
        a = rho * blocks.sum(moved * q)
        q -= blocks.spread(a) * turned
        kept.append(a)
    gamma = np.ones_like(pairs[-1][2])
    for moved, turned, rho in pairs:  # the last pair of each problem sets the size
        size = blocks.sum(turned * scale * turned)
        gamma = np.where((rho > 0) & (size > 0), blocks.sum(moved * turned) / np.maximum(size, 1e-300), gamma)
    r = blocks.spread(gamma) * scale * q
    for (moved, turned, rho), a in zip(pairs, reversed(kept), strict=True):
        r += moved * blocks.spread(a - rho * blocks.sum(turned * r))
    return -r


def fit_sparse(long: DataFrame, vocabulary: DataFrame, labels: DataFrame, breaks: Sequence[float], names: Sequence[str], reg: float = 0.01,
               max_passes: int = 200, tolerance: float = TOLERANCE) -> HazardModel:
    """A hazard model of the long features ``(pid, feature, value)``; ``names`` in the order of ``vocabulary``'s indices."""
    return fit_rows(sparse_rows(long, vocabulary, labels), breaks, names, reg, max_passes, tolerance)


def fit_rows(rows: DataFrame, breaks: Sequence[float], names: Sequence[str], reg: float = 0.01, max_passes: int = 200,
             tolerance: float = TOLERANCE) -> HazardModel:
    """:func:`fit_sparse` of the rows that :func:`sparse_rows` gives."""
    problems = Problems(np.array([-1]), np.array([float(reg)]), len(breaks) - 1, len(names) + 1)
    found = fit_all(rows, problems, max_passes, tolerance)
    return HazardModel([float(b) for b in breaks], list(names), found.weights[:, 0, :].T.copy())


def _applied(model: HazardModel, rows: DataFrame, out: str, value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    weights = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.weights.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for part in slices_of(batch, weights.value.shape[1]):
                at, x, starts = cells_of(part)
                found.append(value(_logits(weights.value, at, x, starts)))
            numbers = np.concatenate(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1) * numbers.shape[1], pa.int32()), pa.array(numbers.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {out} array<double>")


def sparse_hazards(model: HazardModel, rows: DataFrame) -> DataFrame:
    """Rows with ``at`` and ``x`` as in :func:`sparse_rows`, with the array of interval ``hazard``."""
    return _applied(model, rows, "hazard", lambda z: 1 / (1 + np.exp(-z)))


def sparse_logits(model: HazardModel, rows: DataFrame) -> DataFrame:
    """Rows with ``at`` and ``x`` as in :func:`sparse_rows`, with the array of interval ``logit``."""
    return _applied(model, rows, "logit", lambda z: z)


def sparse_equations(model: HazardModel, rows: DataFrame, reg: float) -> DataFrame:
    """(interval, place, gradient, exposure) of the penalised mean loss, by sums alone.

    A patient's cells meet its errors of all intervals in one row, so none is sent anywhere before it is summed; ``exposure`` is the mean size of the feature over the
    person-period rows, the scale a gradient is compared with.
    """
    times = lambda p: p["died"].cast("int") + p["survived"].cast("int")
    labelled = F.arrays_zip("died", "survived", "hazard")
    scored = settle(sparse_hazards(model, rows).select(
        "at", "x", F.transform(labelled, times).alias("n"),
        F.transform(labelled, lambda p: F.when(times(p) > 0, times(p) * p["hazard"] - p["died"].cast("int")).otherwise(0.0)).alias("e")))
    total = F.broadcast(scored.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)).alias("_rows")))  # one number
    intervals = range(len(model.breaks) - 1)
    at = lambda name, i: F.get(name, F.lit(i))
    by_place = scored.select("n", "e", F.inline(F.arrays_zip("at", "x"))).groupBy(F.col("at").alias("place")).agg(
        *[F.sum(at("e", i) * F.col("x")).alias(f"_g{i}") for i in intervals], *[F.sum(at("n", i) * F.abs("x")).alias(f"_e{i}") for i in intervals])
    sums = by_place.select("place", F.inline(F.array(*[
        F.struct(F.lit(i).alias("interval"), F.col(f"_g{i}").alias("_g"), F.col(f"_e{i}").alias("_e")) for i in intervals])))
    weights = model.coefficients(rows.sparkSession).withColumn(
        "place", F.when(F.col("feature") == "(intercept)", 0).otherwise(F.lit(None).cast("int")))
    known = rows.sparkSession.createDataFrame([(i + 1, f) for i, f in enumerate(model.features)], "_place int, feature string")
    placed = weights.join(known, "feature", "left").select("interval", F.coalesce("place", "_place").alias("place"), "weight")
    return placed.join(sums, ["interval", "place"], "left").crossJoin(total).select(
        "interval", "place", (F.coalesce("_g", F.lit(0.0)) / F.col("_rows") + F.lit(reg) * F.col("weight")).alias("gradient"),
        (F.coalesce("_e", F.lit(0.0)) / F.col("_rows")).alias("exposure"))


def search_study(tables: dict[str, DataFrame], surv: DataFrame, study: str, feature_grid: dict[str, Sequence], breaks: Sequence[float],
                 reg: Sequence[float], k: int = 5, seed: int = 42, max_passes: int = 200, tolerance: float = TOLERANCE) -> DataFrame:
    """Held-out loss of every combination of feature windows, code level, tail share and penalty, one row each.

    All settings of the features, folds and penalties are fitted in the same passes over the patients' rows.
    """
    spark, settings = surv.sparkSession, list(product(*feature_grid.values()))
    labels = survival_labels(study_patients(surv, tables, study), breaks).select("pid", "died", "survived")
    labels = settle(kfold_assign(labels, k, seed))
    begins, columns, parts = [], 0, []
    for i, values in enumerate(settings):
        overrides = search_overrides(dict(zip(feature_grid, values, strict=True)))
        long = settle(study_features(tables, surv, study, overrides))
        vocabulary = settle(study_vocabulary(tables, long, study, overrides))
        parts.append(sparse_rows(long, vocabulary, labels, i, columns))
        begins.append(columns)
        columns += vocabulary.count() + 1
    models = list(product(reg, range(k)))
    problems = Problems(np.array([f for _, f in models]), np.array([float(r) for r, _ in models]), len(breaks) - 1, columns, tuple(begins))
    found = fit_all(merged(reduce(DataFrame.unionByName, parts), len(breaks) - 1), problems, max_passes, tolerance)
    losses = found.loss.reshape(len(settings), len(reg), k).mean(axis=2)
    rows = [(*map(str, values), float(r), float(losses[i, j])) for i, values in enumerate(settings) for j, r in enumerate(reg)]
    return spark.createDataFrame(rows, ", ".join([*(f"{n} string" for n in feature_grid), "reg double, loss double"]))
