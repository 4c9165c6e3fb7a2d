"""Clinical risk score for whole cohorts, imputation, and completeness reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.session import settle
from vitalspan.sources import lookups as L

INPUTS = {"age": "age", "pulse": "pulse", "sbp": "sys_bp", "creatinine": "crea", "killip": "killip", "arrest": "arrest",
          "enzymes": "enzymes", "stemi": "stemi"}
# Plausible input ranges of the score, and micromol/L per mg/dL of creatinine.
INPUT_RANGES = {"age": (18, 110), "pulse": (10, 300), "sbp": (10, 300), "creatinine": (0, 10), "killip": (1, 4),
                "arrest": (0, 1), "enzymes": (0, 1), "stemi": (0, 1)}
CREATININE_UNIT = 88.42
HORIZON_DAYS = {"6m": 183.0, "1y": 365.0, "3y": 1095.0}


def _nearest(x: Column, at: Sequence[float]) -> Column:
    """0-based position of the nearest of the sorted values ``at``, the lower one on a tie.

    Evenly spaced values are found by arithmetic, short lists by a chain of comparisons.
    """
    gaps = {round(b - a, 9) for a, b in zip(at, at[1:])}
    if len(gaps) == 1:
        step = F.ceil((x - F.lit(at[0])) / F.lit(gaps.pop()) - F.lit(0.5))
        return F.when(x.isNotNull(), F.least(F.greatest(step, F.lit(0)), F.lit(len(at) - 1)).cast("int"))
    out = F
    for i, (a, b) in enumerate(zip(at, at[1:])):
        out = out.when(x - F.lit(a) <= F.lit(b) - x, F.lit(i))
    return F.when(x.isNotNull(), out.otherwise(F.lit(len(at) - 1)))


def six_month_probability(score: Column, bands: Sequence[tuple] = L.BANDS) -> Column:
    """Percent probability of a point sum: band lookup, scaling, cap. NULL below the first band."""
    rows = F.array(*[
        F.struct(F.lit(float(lo)).alias("lo"), F.lit(float("inf") if hi is None else float(hi)).alias("hi"), F.lit(float(p)).alias("p"))
        for lo, hi, p in bands
    ])
    p = F.get(F.filter(rows, lambda b: (score > b["lo"]) & (score <= b["hi"])), F.lit(0))["p"]
    scaled = p * 100 * F.lit(L.SIX_MONTH_FACTOR)
    return F.when(scaled > L.SIX_MONTH_LIMIT, F.lit(float(L.SIX_MONTH_CAP))).otherwise(scaled)


def horizon_probability(model: str, score: Column) -> Column:
    if model == "6m":
        return six_month_probability(score)
    return (1 - F.pow(F.lit(L.BASELINE_SURVIVAL[model]), F.exp(score))) * 100


def risk_score(df: DataFrame, points: Sequence[tuple[float, float, str, str]] | None = None, pid: str = "pid",
               inputs: dict[str, str] = INPUTS, keep: Sequence[str] = ()) -> DataFrame:
    """Point sum and percent probability per patient and model: ``pid, model, score, prob``.

    The lookup is a few hundred numbers, so each term is an expression: no explode, no join, no shuffle.
    ``points`` are ``(value, score, term, model)`` rows; the default is the built-in table. Creatinine in mg/dL.
    """
    rows = L.points_rows() if points is None else points
    table: dict[str, dict[str, list]] = {}
    for value, score, term, model in rows:
        table.setdefault(model, {}).setdefault(term, []).append((value, score))
    # one position per term and set of tabulated values, shared by the models
    values = {(t, tuple(sorted(v for v, _ in pts))) for terms in table.values() for t, pts in terms.items()}
    names = {key: f"_i_{n}" for n, key in enumerate(sorted(values))}
    placed = df.select(pid, *keep, *[_nearest(F.col(inputs[t]).cast("double"), at).alias(n) for (t, at), n in names.items()])
    def points(term, pts):
        ordered = sorted(pts)
        return F.get(F.lit([float(s) for _, s in ordered]), F.col(names[term, tuple(v for v, _ in ordered)]))
    sums = {m: reduce(lambda a, b: a + b, [points(t, pts) for t, pts in terms.items()]) for m, terms in table.items()}
    # tabulated points have at most seven decimals; rounding keeps sums exactly on the edges of the bands
    scored = placed.select(pid, *keep, *[F.round(c, 7).alias(f"_score_{m}") for m, c in sums.items()])
    cells = [
        F.struct(F.lit(m).alias("model"), F.col(f"_score_{m}").alias("score"), horizon_probability(m, F.col(f"_score_{m}")).alias("prob"))
        for m in table
    ]
    return scored.select(pid, *keep, F.inline(F.array(*cells)))


def in_score_range(inputs: dict[str, str] = INPUTS) -> Column:
    """Whether all known inputs are inside the plausible ranges of the score."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("double").between(*INPUT_RANGES[t]), F.lit(True)) for t, c in inputs.items()])


def mark_imputed(df: DataFrame, columns: Sequence[str], out: str = "imputed") -> DataFrame:
    """True when any of the columns is missing, i.e. would have to be imputed."""
    return df.withColumn(out, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def risk_scores_table(df: DataFrame, imputed: DataFrame | None = None, score_type: str = "GRACE2.0") -> DataFrame:
    """``pid, time, type, imputed, value`` for the three horizons, from baseline rows (Killip class 1 if missing)."""
    flagged = mark_imputed(df.fillna({"killip": 1}), list(INPUTS.values())).select("pid", "imputed")
    filled = (df if imputed is None else imputed).fillna({"killip": 1}).withColumn("crea", F.col("crea").cast("double") / CREATININE_UNIT)
    scores = risk_score(filled).join(flagged, "pid")
    time = reduce(lambda acc, kv: acc.when(F.col("model") == kv[0], F.lit(kv[1])), HORIZON_DAYS.items(), F)
    return scores.select("pid", time.alias("time"), F.lit(score_type).alias("type"), "imputed", F.col("prob").alias("value"))


def impute_forest(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str] = (), iterations: int = 15,
                  trees: int = 75, depth: int = 5, seed: int = 42) -> DataFrame:
    """Iterative random-forest imputation of numeric and text columns; see :func:`impute_rounds`."""
    return impute_rounds(df, key, numeric, categorical, iterations, trees, depth, seed)[0]


def _start_values(base: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict:
    """Median or most frequent level of each column that has a value."""
    found = base.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in numeric], *[F.mode(c, True).alias(c) for c in categorical])
    return {c: v for c, v in found.first().asDict().items() if v is not None}


def _change(before: DataFrame, after: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[float | None, float | None]:
    """How far filled cells moved: squares of the differences over squares of the new values, and the share of levels changed."""
    old = before.select(key, *[F.col(c).alias(f"_o_{c}") for c in [*numeric, *categorical]])
    both = after.join(old, key)
    filled = lambda c, x: F.sum(F.when(F.col(f"_na_{c}"), x).otherwise(0.0))
    cells = [filled(c, F.pow(F.col(c) - F.col(f"_o_{c}"), F.lit(2.0))).alias(f"_d_{c}") for c in numeric]
    cells += [filled(c, F.pow(F.col(c), F.lit(2.0))).alias(f"_s_{c}") for c in numeric]
    cells += [filled(c, (F.col(c) != F.col(f"_o_{c}")).cast("double")).alias(f"_d_{c}") for c in categorical]
    cells += [filled(c, F.lit(1.0)).alias(f"_s_{c}") for c in categorical]
    r = both.agg(*cells).first() if cells else None
    def ratio(columns: Sequence[str]) -> float | None:
        size = sum(r[f"_s_{c}"] or 0.0 for c in columns)
        return sum(r[f"_d_{c}"] or 0.0 for c in columns) / size if size else None
    return ratio(numeric), ratio(categorical)


def impute_rounds(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str] = (), iterations: int = 15, trees: int = 75,
                  depth: int = 5, seed: int = 42) -> tuple[DataFrame, list[tuple[float | None, float | None]]]:
    """Imputed rows and the change that each round made, numeric and text columns apart.

    Missing cells start at the column median or most frequent level; then each column is predicted from all others,
    least-missing column first. Rounds end after ``iterations``, or as soon as neither kind of column changes less than in the
    round before, whose cells are then returned. Forests are trained by MLlib on the whole table; ``key`` is unique. A column
    without any value stays as it is and predicts nothing. The state is written to the shared folder after each column, dealt by key over all cores, so
    the plan stays short.
    """
    base = df.select(key, *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    start = _start_values(base, numeric, categorical)
    numeric_in, categorical_in = [c for c in numeric if c in start], [c for c in categorical if c in start]
    inputs = [*numeric_in, *categorical_in]
    rates = base.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in inputs]).first() if inputs else {}
    holes = sorted((c for c in inputs if rates[c] > 0), key=lambda c: (rates[c], c))
    state = base.withColumns({f"_na_{c}": F.col(c).isNull() for c in inputs}).fillna({c: start[c] for c in holes})
    codes = {c: StringIndexer(inputCol=c, outputCol=f"_i_{c}", stringOrderType="alphabetAsc", handleInvalid="keep").fit(state) for c in categorical_in}
    hot = {c: OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}", dropLast=False, handleInvalid="keep").fit(codes[c].transform(state)) for c in categorical_in}
    # the planner merges these few bytes into few partitions, but every pass over them works through all trees of a forest
    tasks = df.sparkSession.sparkContext.defaultParallelism
    dealt = lambda rows: settle(rows.repartition(tasks, key))
    state = dealt(state)
    changes: list[tuple[float | None, float | None]] = []
    for _ in range(iterations if holes and len(inputs) > 1 else 0):
        before = state
        for target in holes:
            others = [c for c in inputs if c != target]
            staged = state
            for c in categorical_in:
                staged = hot[c].transform(codes[c].transform(staged))
            assembler = VectorAssembler(inputCols=[f"_h_{c}" if c in hot else c for c in others], outputCol="_x")
            ready = assembler.transform(staged)
            known = ready.where(~F.col(f"_na_{target}"))
            if target in codes:
                model = RandomForestClassifier(featuresCol="_x", labelCol=f"_i_{target}", predictionCol="_p", probabilityCol="_pp", rawPredictionCol="_pr",
                                               numTrees=trees, maxDepth=depth, seed=seed).fit(known)
                guessed = IndexToString(inputCol="_p", outputCol="_g", labels=codes[target].labels).transform(model.transform(ready))
            else:
                model = RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="_g", numTrees=trees, maxDepth=depth, seed=seed).fit(known)
                guessed = model.transform(ready)
            filled = guessed.withColumn(target, F.when(F.col(f"_na_{target}"), F.col("_g")).otherwise(F.col(target)))
            state = dealt(filled.select(*state.columns))  # else the next forest's passes would work through this one again
        changes.append(_change(before, state, key, [c for c in numeric_in if c in holes], [c for c in categorical_in if c in holes]))
        if len(changes) > 1 and not any(b is not None and b < a for a, b in zip(*changes[-2:], strict=True)):
            state = before
            break
    return state.select(key, *numeric, *categorical), changes


def imputation_errors(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str] = (), share: int = 10, **options) -> DataFrame:
    """How well masked known cells come back: ``name, n_masked, error, start_error``.

    One known cell in ``share``, by the MD5 of ``key:name``, is hidden before the imputation. Numeric errors are root mean
    squares over the column's standard deviation, errors of text columns the share of wrong levels; ``start_error`` is that of
    the median or most frequent level of what is left.
    """
    columns = [*numeric, *categorical]
    token = lambda c: F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{c}")).cast("binary")), 1, 6), 16, 10).cast("long")
    typed = df.select(key, *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    marked = settle(typed.withColumns({f"_m_{c}": F.col(c).isNotNull() & (token(c) % share == 0) for c in columns}))
    masked = marked.select(key, *[F.when(~F.col(f"_m_{c}"), F.col(c)).alias(c) for c in columns])
    start = _start_values(masked, numeric, categorical)
    filled = impute_forest(masked, key, numeric, categorical, **options).select(key, *[F.col(c).alias(f"_g_{c}") for c in columns])
    both = marked.join(filled, key)
    def row(c: str) -> list:
        own, hidden = F.col(c), F.col(f"_m_{c}")
        guesses = {"error": F.col(f"_g_{c}"), "start_error": F.lit(start.get(c))}
        if c in numeric:
            errors = {n: F.sqrt(F.avg(F.when(hidden, F.pow(own - g, F.lit(2.0))))) / F.stddev_samp(own) for n, g in guesses.items()}
        else:
            errors = {n: F.avg(F.when(hidden, (own != g).cast("double"))) for n, g in guesses.items()}
        return [F.lit(c).alias("name"), F.count_if(hidden).alias("n_masked"), *[e.alias(n) for n, e in errors.items()]]
    return both.agg(F.array(*[F.struct(*row(c)) for c in columns]).alias("_r")).select(F.inline("_r"))
