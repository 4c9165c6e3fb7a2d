"""Discrete-time hazard model: fit with MLlib, score, cross-validate, ablate, attribute.

One logistic layer per interval is the same as one logistic regression on person-period rows whose inputs are the
products of the interval indicator and the features, so MLlib's distributed optimiser fits it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Interaction, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.features import (
    feature_arrays, kfold_assign, person_periods, search_overrides, study_features, study_patients, study_vocabulary, survival_labels,
)
from vitalspan.operators.metrics import discrete_nll
from vitalspan.operators.ordered import quantiles
from vitalspan.operators.reshape import to_wide
from vitalspan.operators.survival import curve_at, hazard_to_survival
from vitalspan.session import settle


@dataclass
class HazardModel:
    """``weights[i]`` is the intercept and the feature weights of interval ``i``; its size is vocabulary times intervals."""

    breaks: list[float]
    features: list[str]
    weights: np.ndarray = field(repr=False)

    def coefficients(self, spark) -> DataFrame:
        rows = [
            (i, name, float(w)) for i, row in enumerate(self.weights) for name, w in zip(["(intercept)", *self.features], row)
        ]
        return spark.createDataFrame(rows, "interval INT, feature STRING, weight DOUBLE")


def training_rows(features: DataFrame, labels: DataFrame, n_intervals: int, width: int) -> DataFrame:
    """Person-period rows with label, interval indicator and feature vector. A time on a break gives two rows."""
    return rows_of_labelled(labels.select("pid", "died", "survived").join(features.select("pid", "features"), "pid"), n_intervals, width)


def rows_of_labelled(labelled: DataFrame, n_intervals: int, width: int) -> DataFrame:
    """:func:`training_rows` of patients that have ``features``, ``died`` and ``survived`` in one row, without a join."""
    periods = person_periods(labelled, ("pid", "features"))
    outcomes = F.filter(
        F.array(F.when(F.col("died"), F.lit(1.0)), F.when(F.col("survived"), F.lit(0.0))), lambda x: x.isNotNull())
    rows = periods.select("pid", "features", "interval", F.explode(outcomes).alias("label"))
    indicator = F.transform(F.sequence(F.lit(0), F.lit(n_intervals - 1)), lambda i: (i == F.col("interval")).cast("double"))
    return rows.select(
        "pid", "interval", "label", array_to_vector(indicator).alias("_i", metadata=_numeric(n_intervals)),
        array_to_vector(F.concat(F.array(F.lit(1.0)), F.col("features"))).alias("_x", metadata=_numeric(width + 1)))


def _numeric(n: int) -> dict:
    """Column metadata declaring a vector of ``n`` numeric attributes, needed to build interactions."""
    return {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": str(i)} for i in range(n)]}, "num_attrs": n}}


def fit_hazard(features: DataFrame, labels: DataFrame, breaks: Sequence[float], names: Sequence[str], reg: float = 0.0,
               elastic: float = 0.0, max_iter: int = 100) -> HazardModel:
    """Fit on ``features (pid, features ARRAY<DOUBLE>)`` and ``labels (pid, died, survived)``."""
    labelled = labels.select("pid", "died", "survived").join(features.select("pid", "features"), "pid")
    return fit_labelled(labelled, breaks, names, reg, elastic, max_iter)


def fit_labelled(labelled: DataFrame, breaks: Sequence[float], names: Sequence[str], reg: float = 0.0, elastic: float = 0.0,
                 max_iter: int = 100) -> HazardModel:
    """:func:`fit_hazard` on rows ``(pid, features, died, survived)``."""
    n = len(breaks) - 1
    rows = Interaction(inputCols=["_i", "_x"], outputCol="_f").transform(rows_of_labelled(labelled, n, len(names)))
    estimator = LogisticRegression(
        featuresCol="_f", labelCol="label", fitIntercept=False, standardization=False, regParam=reg, elasticNetParam=elastic, maxIter=max_iter)
    model = estimator.fit(rows.select("label", "_f"))
    weights = np.asarray(model.coefficients.toArray()).reshape(n, len(names) + 1)
    return HazardModel([float(b) for b in breaks], list(names), weights)


def score_equations(model: HazardModel, features: DataFrame, labels: DataFrame, reg: float = 0.0) -> DataFrame:
    """Gradient of the penalised mean loss at the model's weights, by interval and feature; zero at the optimum."""
    n, width = len(model.breaks) - 1, len(model.features)
    rows = training_rows(features, labels, n, width)
    scored = with_hazards(model, rows.join(features, "pid"))
    total = rows.count()
    names = F.array(*[F.lit(name) for name in ["(intercept)", *model.features]])
    inputs = F.concat(F.array(F.lit(1.0)), F.col("features"))
    cells = scored.select("interval", (F.element_at("hazard", F.col("interval") + 1) - F.col("label")).alias("e"), F.posexplode(inputs).alias("j", "x"))
    sums = cells.groupBy("interval", F.get(names, F.col("j")).alias("feature")).agg((F.sum(F.col("e") * F.col("x")) / F.lit(total)).alias("g"))
    weights = model.coefficients(features.sparkSession)
    return weights.join(sums, ["interval", "feature"], "left").select(
        "interval", "feature", (F.coalesce("g", F.lit(0.0)) + F.col("weight") * F.lit(reg)).alias("gradient"))


def with_hazards(model: HazardModel, features: DataFrame) -> DataFrame:
    """Add the array of interval hazards: one Arrow-batched matrix product, no shuffle."""
    weights = model.weights

    @F.pandas_udf("array<double>")
    def hazards(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        logits = np.vstack(x.to_numpy()) @ weights[:, 1:].T + weights[:, 0]
        return pd.Series(list(1.0 / (1.0 + np.exp(-logits))))

    return features.withColumn("hazard", hazards("features"))


def score(model: HazardModel, features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Long predictions ``pid, time, surv`` at the interval ends."""
    curves = with_hazards(model, features).withColumn("_s", hazard_to_survival(F.col("hazard")))
    ends = F.array(*[F.lit(b) for b in model.breaks[1:]])
    pairs = F.zip_with(ends, F.col("_s"), lambda t, s: F.struct(t.alias("time"), s.alias("surv")))
    return curves.select("pid", *keep, F.inline(pairs))


def score_at(model: HazardModel, features: DataFrame, taus: Sequence[float], clamp: bool = False) -> DataFrame:
    """Predicted survival at given horizons, without exploding to the grid first."""
    curves = with_hazards(model, features).withColumn("_s", hazard_to_survival(F.col("hazard")))
    cells = [F.struct(F.lit(float(t)).alias("tau"), curve_at(F.col("_s"), model.breaks[1:], t, clamp).alias("surv")) for t in taus]
    return curves.select("pid", F.inline(F.array(*cells)))


def model_loss(model: HazardModel, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean negative log-likelihood of held-out patients."""
    return labelled_loss(model, features.select("pid", "features").join(labels.select("pid", "died", "survived"), "pid"))


def labelled_loss(model: HazardModel, labelled: DataFrame) -> DataFrame:
    """:func:`model_loss` of rows ``(pid, features, died, survived)``."""
    scored = with_hazards(model, labelled)
    cells = F.transform(F.arrays_zip("died", "survived", "hazard"), lambda p: F.struct(p["died"].alias("died"), p["survived"].alias("survived"), p["hazard"].alias("hazard")))
    return discrete_nll(scored.select("pid", F.inline(cells)))


def cross_validate(features: DataFrame, labels: DataFrame, breaks: Sequence[float], names: Sequence[str], grid: dict[str, Sequence],
                   k: int = 5, seed: int = 42, max_iter: int = 50) -> DataFrame:
    """Mean held-out loss per parameter combination, folds by patient. One row per combination comes back.

    Labels and features meet once, in a sort-merge join; fits and losses read their rows together, so no fold is sent anywhere.
    """
    assigned = kfold_assign(labels.select("pid", "died", "survived"), k, seed)
    folds = settle(assigned.hint("merge").join(features.select("pid", "features"), "pid"))
    results = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        losses = []
        for fold in range(k):
            train, held = folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold)
            model = fit_labelled(train, breaks, names, max_iter=max_iter, **params)
            losses.append(labelled_loss(model, held).first()["nll"])
        results.append((*[float(v) for v in values], float(np.mean(losses))))
    schema = ", ".join(f"{name} DOUBLE" for name in grid) + ", loss DOUBLE"
    return features.sparkSession.createDataFrame(results, schema)


def study_matrix(tables: dict[str, DataFrame], patients: DataFrame, study: str, params: dict | None = None,
                 max_width: int = 100_000) -> tuple[DataFrame, list[str]]:
    """Feature arrays of a study's patients and the column names, under the given search parameters.

    The names reach the driver, as the model's coefficients do; ``max_width`` bounds them.
    """
    members = study_patients(patients, tables, study)
    overrides = search_overrides(params or {})
    long = settle(study_features(tables, patients, study, overrides))
    vocabulary = settle(study_vocabulary(tables, long, study, overrides))
    if vocabulary.count() > max_width:
        raise ValueError(f"the matrix would have more than {max_width} columns; raise max_width or take a coarser code level")
    names = [r["feature"] for r in vocabulary.orderBy("column_index").collect()]
    return feature_arrays(long, vocabulary, len(names), patients=members), names


def cross_validate_study(tables: dict[str, DataFrame], surv: DataFrame, study: str, feature_grid: dict[str, Sequence], breaks: Sequence[float],
                         reg: Sequence[float] = (0.0,), k: int = 5, seed: int = 42, max_iter: int = 50) -> DataFrame:
    """Held-out loss for every combination of feature windows, code level, tail share and regularisation."""
    labels = settle(survival_labels(surv, breaks))
    parts = []
    for values in product(*feature_grid.values()):
        params = dict(zip(feature_grid, values))
        features, names = study_matrix(tables, surv, study, params)
        losses = cross_validate(features, labels, breaks, names, {"reg": reg}, k, seed, max_iter)
        parts.append(losses.select(*[F.lit(str(v)).alias(n) for n, v in params.items()], "reg", "loss"))
    return reduce(DataFrame.unionByName, parts)


def training_medians(features: DataFrame, names: Sequence[str]) -> list[float]:
    """Exact median of every feature column; one number per feature reaches the driver.

    Only cells other than 0 are shuffled; the zeros of a column are what is left of the patients.
    """
    rows = settle(features.select("features"))
    total = rows.count()
    cells = rows.select(F.explode(F.filter(F.transform("features", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: c["x"] != 0)).alias("c"))
    counted = cells.groupBy("c.i", "c.x").agg(F.count("*").alias("n"))
    known = counted.groupBy("i").agg(F.sum("n").alias("n"))
    columns = features.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("i"))
    zeros = columns.join(known, "i", "left").select("i", F.lit(0.0).alias("x"), (F.lit(total) - F.coalesce("n", F.lit(0))).alias("n"))
    both = settle(counted.unionByName(zeros.where("n > 0")))
    found = {r["i"]: r["q"][0] for r in quantiles(both, ["i"], "x", [0.5], count="n").collect()}
    return [float(found.get(i, 0.0)) for i in range(len(names))]


ABLATION_TAUS = (168.0, 364.0, 730.0, 1095.0, 1460.0, 1825.0)


def _interpolation(times: Sequence[float], taus: Sequence[float]) -> np.ndarray:
    """Matrix that turns curves on a grid into their linear interpolation at each horizon; outside the grid NaN."""
    out = np.zeros((len(times), len(taus)))
    for j, tau in enumerate(taus):
        if not times[0] <= tau <= times[-1]:
            out[:, j] = np.nan
            continue
        i = min(int(np.searchsorted(times, tau, side="right")) - 1, len(times) - 2)
        share = (tau - times[i]) / (times[i + 1] - times[i])
        out[i, j], out[i + 1, j] = 1.0 - share, share
    return out


def ablate_features(model: HazardModel, features: DataFrame, medians: Sequence[float], groups: dict[str, Sequence[int]],
                    taus: Sequence[float] = ABLATION_TAUS) -> DataFrame:
    """Survival at each horizon with one feature's columns set to their training medians, for every feature and "full".

    Replacing columns only shifts the logits, so the base logits are computed once per patient and each feature adds
    its own small correction.
    """
    weights, med = model.weights, np.asarray(medians, dtype=float)
    at = _interpolation(model.breaks[1:], taus)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.vstack(batch["features"].to_numpy())
            base = x @ weights[:, 1:].T + weights[:, 0]
            for name, idx in [("full", []), *groups.items()]:
                cols = list(idx)
                logits = base + (med[cols] - x[:, cols]) @ weights[:, [c + 1 for c in cols]].T if cols else base
                values = np.cumprod(1.0 - 1.0 / (1.0 + np.exp(-logits)), axis=1) @ at
                yield pd.DataFrame({
                    "pid": np.repeat(batch["pid"].to_numpy(), len(taus)), "feature": name,
                    "tau": np.tile(np.asarray(taus, dtype=float), len(batch)), "surv": values.reshape(-1),
                })

    out = features.select("pid", "features").mapInPandas(run, "pid BIGINT, feature STRING, tau DOUBLE, surv DOUBLE")
    return out.withColumn("surv", F.when(~F.isnan("surv"), F.col("surv")))


def sample_background(features: DataFrame, n: int = 100) -> np.ndarray:
    """``n`` reproducibly chosen rows (smallest MD5 of the patient key) as a matrix; ``n`` bounds what reaches the driver."""
    rows = features.orderBy(F.md5(F.col("pid").cast("string").cast("binary")), "pid").limit(n).select("features").collect()
    return np.asarray([r["features"] for r in rows], dtype=float)


def attribute(model: HazardModel, features: DataFrame, background: np.ndarray, tau: float, steps: int = 8) -> DataFrame:
    """Expected-gradient attributions on the survival scale: ``pid, feature, shap, vals, timepoint``.

    The gradient of the survival product is known in closed form; it is averaged over the background rows and
    over points on the line between each of them and the patient.
    """
    weights, names = model.weights, model.features
    times = np.asarray(model.breaks[1:])
    i = min(max(int(np.searchsorted(times, tau, side="right")) - 1, 0), len(times) - 2)
    share = (tau - times[i]) / (times[i + 1] - times[i])
    alphas = (np.arange(steps) + 0.5) / steps

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.vstack(batch["features"].to_numpy())
            total = np.zeros_like(x)
            for b in background:
                gap = x - b
                for a in alphas:
                    h = 1.0 / (1.0 + np.exp(-((b + a * gap) @ weights[:, 1:].T + weights[:, 0])))
                    surv = np.cumprod(1.0 - h, axis=1)
                    lo = (h[:, : i + 1] @ weights[: i + 1, 1:]) * surv[:, [i]]
                    hi = (h[:, : i + 2] @ weights[: i + 2, 1:]) * surv[:, [i + 1]]
                    total -= gap * ((1.0 - share) * lo + share * hi)
            shap = total / (len(background) * len(alphas))
            yield pd.DataFrame({
                "pid": np.repeat(batch["pid"].to_numpy(), len(names)), "feature": np.tile(np.asarray(names, dtype=object), len(batch)),
                "shap": shap.reshape(-1), "vals": x.reshape(-1), "timepoint": float(tau),
            })

    return features.select("pid", "features").mapInPandas(
        run, "pid BIGINT, feature STRING, shap DOUBLE, vals DOUBLE, timepoint DOUBLE")


def cluster_matrix(medians: DataFrame, levels: Sequence[str], feature: str = "fname") -> DataFrame:
    """What is clustered: one row a feature, the median attribution of each level, 0 where it has none."""
    return to_wide(medians, [feature], "text", "median", levels).fillna(0.0)


def cluster_features(medians: DataFrame, levels: Sequence[str], k: int = 6, seed: int = 2022, feature: str = "fname") -> DataFrame:
    """Cluster features by their median attribution per level."""
    wide = settle(cluster_matrix(medians, levels, feature))
    names = {c: f"_c{i}" for i, c in enumerate(levels)}
    ready = VectorAssembler(inputCols=list(names.values()), outputCol="_x").transform(wide.withColumnsRenamed(names))
    model = KMeans(k=k, seed=seed, maxIter=1000, featuresCol="_x", predictionCol="cluster").fit(ready)
    back = {v: n for n, v in names.items()}
    return model.transform(ready).drop("_x").withColumnsRenamed(back)
