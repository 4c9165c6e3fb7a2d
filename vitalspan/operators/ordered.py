"""Running totals, ranks and exact quantiles over orders of any length.

A window with ``orderBy`` sorts each of its partitions in one task, so a stratum with a third of all rows would
be one task's work. Here every long group is cut into blocks of about ``block_rows`` rows first. The cut points
are the order values whose hash is divisible by ``block_rows``: a fixed function of the data, so all branches of
a plan (and re-run tasks) agree on the blocks.

A row finds its block in two steps. Cut points whose hash is divisible by ``FAN`` times as much are the group's
marks; each row gets the marks of its group and picks the last one it has passed. The cut points between two
marks are one short list, found by group and mark. So a row meets some ``FAN`` values besides the marks, which
are few: 10**11 rows in one group give about 10**5 cut points and 800 marks. Both tables and the offsets have one
row per ``block_rows`` input rows at most, which bounds what is broadcast (10**12 rows: a million numbers).

Rows with equal order values always share a block, so aggregate to distinct order values first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20
FAN = 128

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def _key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def with_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block`` (the last cut point passed, NULL before the first one) and ``_cut`` (whether the group is cut)."""
    key = _key(order)
    base = df if by else df.withColumn("_all", F.lit(0))
    by = list(by) or ["_all"]
    names = [f"_b_{c}" for c in by]
    token = F.xxhash64(*order)
    cuts = (
        base.where((F.pmod(token, F.lit(block_rows)) == 0) & F.col(order[0]).isNotNull())
        .select(*[F.col(c).alias(n) for c, n in zip(by, names)], key.alias("_blk_key"),
                (F.pmod(token, F.lit(block_rows * FAN)) == 0).alias("_blk_is_mark"))
        .distinct()
    )
    passed = Window.partitionBy(*names).orderBy("_blk_key").rowsBetween(Window.unboundedPreceding, 0)
    lists = (
        cuts.withColumn("_blk_of", F.last(F.when(F.col("_blk_is_mark"), F.col("_blk_key")), True).over(passed))
        .groupBy(*names, "_blk_of").agg(F.collect_list("_blk_key").alias("_blk_cuts"))
    )
    marks = cuts.groupBy(*names).agg(F.collect_list(F.when(F.col("_blk_is_mark"), F.col("_blk_key"))).alias("_blk_marks"))
    last = lambda values: F.array_max(F.filter(values, lambda c: c <= key))
    rows = base.join(F.broadcast(marks), _same(base, marks, list(zip(by, names))), "left").drop(*names)
    rows = rows.withColumn("_blk_mark", last("_blk_marks"))
    found = rows.join(F.broadcast(lists), _same(rows, lists, [*zip(by, names), ("_blk_mark", "_blk_of")]), "left")
    return found.withColumns({"_block": last("_blk_cuts"), "_cut": F.col("_blk_marks").isNotNull()}).drop(
        *names, "_blk_marks", "_blk_mark", "_blk_of", "_blk_cuts")


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column | str]],
    descending: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running aggregates (current row included) along ``order`` within ``by``.

    ``aggs`` maps an output column to ``(kind, value)`` with kind ``sum``, ``min`` or ``max``. Running ``max`` or
    ``min`` over a struct ``(order, value)`` carries a value forward.
    """
    values = {f"_v_{name}": F.col(v) if isinstance(v, str) else v for name, (_, v) in aggs.items()}
    rows = with_blocks(df.withColumns(values), by, order, block_rows)
    by = list(by) or ["_all"]
    totals = (
        rows.where("_cut")
        .groupBy(*by, "_block")
        .agg(*[_AGG[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in aggs.items()])
    )
    blocks = F.col("_block").desc() if descending else F.col("_block").asc()  # the block before the first cut point is NULL
    earlier = Window.partitionBy(*by).orderBy(blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_b_{c}") for c in [*by, "_block"]],
        *[_AGG[kind](f"_t_{name}").over(earlier).alias(f"_o_{name}") for name, (kind, _) in aggs.items()],
    )
    joined = rows.join(F.broadcast(offsets), _same(rows, offsets, [(c, f"_b_{c}") for c in [*by, "_block"]]), "left")
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    window = Window.partitionBy(*by, "_block").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    merge = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    out = joined.withColumns(
        {
            name: merge[kind](_AGG[kind](f"_v_{name}").over(window), F.col(f"_o_{name}"))
            for name, (kind, _) in aggs.items()
        }
    )
    return out.select(*[c for c in df.columns if c not in aggs], *aggs)


def fill_downup(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill missing values with the last known one before, else the first known one after, within each group.

    One shuffle by group and block, and one sort in either direction: the next known value is the last one met on the
    way back, so each row is looked at once each way. Values crossing a block border come from the small offset table.
    """
    rows = with_blocks(df, by, order, block_rows)
    by = list(by) or ["_all"]
    at = F.struct(*order)
    totals = rows.where("_cut").groupBy(*by, "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_l_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_f_{c}") for c in columns])
    blocks = Window.partitionBy(*by).orderBy("_block")
    earlier, later = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
    offsets = totals.select(
        *[F.col(c).alias(f"_b_{c}") for c in [*by, "_block"]],
        *[F.last(f"_l_{c}", True).over(earlier).alias(f"_d_{c}") for c in columns],
        *[F.first(f"_f_{c}", True).over(later).alias(f"_u_{c}") for c in columns])
    joined = rows.join(F.broadcast(offsets), _same(rows, offsets, [(c, f"_b_{c}") for c in [*by, "_block"]]), "left")
    so_far = lambda c, *sort: F.last(c, True).over(
        Window.partitionBy(*by, "_block").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0))
    next_known = joined.withColumns({f"_n_{c}": so_far(c, *[F.col(o).desc() for o in order]) for c in columns})
    filled = next_known.withColumns({
        c: F.coalesce(so_far(c, *order), F.col(f"_d_{c}"), F.col(f"_n_{c}"), F.col(f"_u_{c}")) for c in columns
    })
    return filled.select(*df.columns)


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    out: str = "q",
    block_rows: int = BLOCK_ROWS,
    count: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, ``out`` is an array in the order of ``probs``.

    ``count`` is a column that tells how many equal rows a row stands for.
    """
    number = F.count("*") if count is None else F.sum(count)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(number.alias("_w"))
    ranked = running(distinct, by, [value], {"_cum": ("sum", "_w")}, block_rows=block_rows)
    sizes = distinct.groupBy(*[F.col(c).alias(f"_b_{c}") for c in by]).agg(F.sum("_w").alias("_n"))
    joined = (
        ranked.join(sizes, _same(ranked, sizes, [(c, f"_b_{c}") for c in by]))
        if by
        else ranked.withColumn("_k", F.lit(0)).join(sizes.withColumn("_k", F.lit(0)), "_k")
    )

    def at(p: float) -> list[Column]:
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        return [
            F.min(F.when(F.col("_cum") > lo, F.col(value))),
            F.min(F.when(F.col("_cum") > hi, F.col(value))),
            F.first(h - lo),
        ]

    parts = joined.groupBy(*by).agg(
        *[c.alias(f"_{i}_{j}") for i, p in enumerate(probs) for j, c in enumerate(at(p))]
    )
    cells = [
        F.col(f"_{i}_0") + F.col(f"_{i}_2") * (F.col(f"_{i}_1") - F.col(f"_{i}_0")) for i in range(len(probs))
    ]
    return parts.select(*by, F.array(*cells).alias(out))


def random_rank(
    df: DataFrame, key: str, by: Sequence[str] = (), shuffle: Column | None = None, out: str = "rank",
    seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Position of each row in a reproducible random order of ``key`` (unique per group)."""
    token = F.xxhash64(F.col(key), F.lit(seed)) if shuffle is None else shuffle
    ranked = running(
        df.withColumn("_token", token), by, ["_token", key], {out: ("sum", F.lit(1))}, block_rows=block_rows
    )
    return ranked.drop("_token")
