"""Joins with domain semantics: validity intervals, nearest events, lookups, fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.scalars import between_or_unknown
from vitalspan.operators.ordered import running
from vitalspan.session import arrow_batches, settle


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all common columns."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how)


def join_coalesced(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join where columns present on both sides are merged: the left value, else the right one."""
    shared = [c for c in right.columns if c in left.columns and c not in on]
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    joined = left.join(other, list(on), how)
    return joined.withColumns({c: F.coalesce(c, f"_r_{c}") for c in shared}).drop(*[f"_r_{c}" for c in shared])


def join_rounded(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", scale: int = 9) -> DataFrame:
    """Equi join in which floating-point keys are compared at a fixed scale."""
    def fixed(df):
        kinds = dict(df.dtypes)
        return df.withColumns({c: F.round(c, scale) for c in on if kinds[c] in ("double", "float")})
    return fixed(left).join(fixed(right), list(on), how)


def restrict_to(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``other``."""
    return df.join(other.select(*on), list(on), "left_semi")


def exclude(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    return df.join(other.select(*on), list(on), "left_anti")


def membership_flag(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Boolean column telling whether the key occurs in ``other``."""
    keys = other.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(keys, list(on), "left").fillna(False, subset=[name])


def keep_groups(df: DataFrame, by: Sequence[str], condition: Column) -> DataFrame:
    """All rows of the groups for which the aggregate ``condition`` is true."""
    good = df.groupBy(*by).agg(condition.alias("_keep")).where("_keep").select(*by)
    return df.join(good, list(by), "left_semi")


#: Cells of each grid are this many times as wide as those of the one before.
GRID_STEP = 16
#: An event whose value is unknown is valid for all rows of its key; these are dealt to so many cells.
UNKNOWN_CELLS = 16


def _position(c: Column, kind: str) -> Column:
    """A number that never falls as the value rises, for the types that ranges come in; NaN is above all others."""
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    number = (c.cast("timestamp") if kind == "timestamp_ntz" else c).cast("double")
    return F.nanvl(number, F.lit(float("inf")))


def _compared_as(kinds: Sequence[str]) -> str | None:
    """The type that values of these types are cast to when they are compared, where they are of different kinds."""
    if len({*kinds}) == 1:
        return None
    if any(k.startswith("timestamp") for k in kinds):
        return "timestamp"
    return next((k for k in kinds if k != "string"), None) if "string" in kinds else None


def _grid(lookup: DataFrame, on: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Per key ``_grid``: where its finite bounds begin and end, and the finest cell, the span divided by the number of rows."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    least = F.min(F.least(finite(low), finite(high)))
    most = F.max(F.greatest(finite(low), finite(high)))
    ends = lookup.dropna(subset=list(on)).groupBy(*on).agg(
        F.coalesce(least, F.lit(0.0)).alias("a"), F.coalesce(most, F.lit(0.0)).alias("b"), F.count(F.lit(1)).alias("n"))
    cell = F.greatest((F.col("b") - F.col("a")) / F.col("n"), F.lit(1e-6))
    return ends.select(*on, F.struct("a", "b", cell.alias("cell")).alias("_grid"))


def _held(position: Column) -> Column:
    """Positions beyond the key's finite bounds count as one cell before or after them."""
    held = F.greatest(F.least(position, F.col("_grid.b") + F.col("_grid.cell")), F.col("_grid.a") - F.col("_grid.cell"))
    return F.when(position.isNotNull(), held)


def _cell(position: Column, level: Column) -> Column:
    return F.floor((position - F.col("_grid.a")) / (F.col("_grid.cell") * F.pow(F.lit(float(GRID_STEP)), level)))


def interval_join(
    events: DataFrame, lookup: DataFrame, on: Sequence[str], ranges: Sequence[tuple[str, str, str]],
    unmatched: str = "no_key_only",
) -> DataFrame:
    """Attach lookup rows valid for an event: equal keys and every ``(value, low, high)`` range containing the value.

    NULL bounds are open and a NULL value is in every range. ``unmatched`` says which events survive without a valid
    lookup row: ``no_key_only`` keeps events whose key has no lookup row at all, ``drop`` none of them, ``keep`` all.

    The first range is indexed. Each key has grids of growing cells; an interval is listed in the first one whose cells
    are as wide as itself, so in three cells at most, and an event looks up one cell in each grid that its key
    uses. An event meets the rows of these cells only, and each of them once, however many intervals its key has.
    """
    if unmatched not in ("no_key_only", "drop", "keep"):
        raise ValueError(f"unmatched {unmatched!r}")
    on = list(on)
    value, lo, hi = ranges[0]
    valid = reduce(lambda a, b: a & b, [between_or_unknown(v, low, high) for v, low, high in ranges])
    kinds = {**dict(lookup.dtypes), **dict(events.dtypes)}
    kind = _compared_as([kinds[c] for c in (value, lo, hi)])
    at, low, high = (_position(F.col(c).cast(kind) if kind else F.col(c), kind or kinds[c]) for c in (value, lo, hi))
    out = [*on, *[c for c in events.columns if c not in on], *[c for c in lookup.columns if c not in on]]

    gridded = lookup.join(_grid(lookup, on, low, high), on)
    begin, end = F.coalesce(_held(low), F.col("_grid.a") - F.col("_grid.cell")), F.coalesce(_held(high), F.col("_grid.b") + F.col("_grid.cell"))
    level = F.greatest(F.ceil(F.log(F.greatest((end - begin) / F.col("_grid.cell"), F.lit(1.0))) / F.log(F.lit(float(GRID_STEP)))), F.lit(0)).cast("int")
    leveled = gridded.withColumns({"_begin": begin, "_end": end}).withColumn("_level", level)
    grids = leveled.where("_begin <= _end").groupBy(*on).agg(F.first("_grid").alias("_grid"), F.collect_set("_level").alias("_levels"))
    cells = F.when(F.col("_begin") <= F.col("_end"), F.transform(
        F.sequence(_cell(F.col("_begin"), F.col("_level")), _cell(F.col("_end"), F.col("_level"))),
        lambda c: F.struct(F.col("_level").alias("l"), c.alias("c")))).otherwise(F.array().cast("array<struct<l:int,c:bigint>>"))
    anywhere = F.struct(F.lit(-1).alias("l"), F.pmod(F.xxhash64(*lookup.columns), F.lit(UNKNOWN_CELLS)).alias("c"))
    listed = leveled.withColumn("_at", F.explode(F.concat(cells, F.array(anywhere))))
    listed = listed.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in lookup.columns if c not in on], F.col("_at.l").alias("_l"), F.col("_at.c").alias("_c"))

    if unmatched == "keep":  # an event that matches nothing has to be told from its equals
        events = settle(events.withColumn("_event", F.monotonically_increasing_id()))
    keyed = lookup.select(*on).dropna().distinct().join(grids, on, "left").withColumn("_known", F.lit(True))
    probed = events.join(keyed, on, "left" if unmatched == "no_key_only" else "inner")
    position = _held(at)
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(UNKNOWN_CELLS - 1)), lambda c: F.struct(F.lit(-1).alias("l"), c.cast("bigint").alias("c")))
    own = F.transform("_levels", lambda n: F.struct(n.alias("l"), _cell(position, n).alias("c")))
    probes = F.when(F.col("_known") & F.col(value).isNull(), everywhere).otherwise(own)
    spread = probed.withColumn("_probe", F.explode_outer(probes)).drop("_grid", "_levels")
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in on], (F.col("_probe.l") == F.col("_l")) & (F.col("_probe.c") == F.col("_c")))
    if unmatched == "no_key_only":
        return spread.join(listed, same, "left").where(F.col("_known").isNull() | (F.col("_l").isNotNull() & valid)).select(*out)
    matched = spread.join(listed, same).where(valid)
    if unmatched == "drop":
        return matched.select(*out)
    rest = events.join(matched.select("_event").distinct(), "_event", "left_anti")
    absent = {c: F.lit(None).cast(t) for c, t in lookup.dtypes if c not in on}
    return matched.select(*out).unionByName(rest.withColumns(absent).select(*out))


def nearest_before_else_after(
    events: DataFrame, by: Sequence[str], offset: str, lo: float, hi: float, keep: Sequence[str],
    tiebreak: Sequence[str] = (), grace: float = 1.0,
) -> DataFrame:
    """One row per key inside the window: the closest earlier event, else the closest later one.

    ``offset`` is days after the index; events up to ``grace`` days after it count as earlier. A ``min_by`` keeps
    one candidate per key and task, so a key with very many events is no burden. Of events that ``tiebreak`` leaves
    equal, a known and smaller value of ``keep`` counts, so the result does not depend on the order in which they arrive.
    """
    values = [x for c in keep for x in (F.col(c).isNull(), F.col(c))]
    order = F.struct(*[c.alias(f"_{i}") for i, c in enumerate([
        F.col(offset) - F.lit(grace) > 0, F.abs(F.col(offset)), *[F.col(t) for t in tiebreak], *values])])
    return (
        events.where(F.col(offset).between(lo, hi))
        .groupBy(*by)
        .agg(F.min_by(F.struct(*keep), order).alias("_row"))
        .select(*by, "_row.*")
    )


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    """The first row per key in an explicit order, by aggregation instead of a sort."""
    keep = list(keep or [c for c in df.columns if c not in by])
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_row"))
    return picked.select(*by, "_row.*")


def last_row(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    """The last row per key in an explicit order."""
    keep = list(keep or [c for c in df.columns if c not in by])
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_row"))
    return picked.select(*by, "_row.*")


def nearest_lookup_join(df: DataFrame, value: str, lookup: DataFrame, on: Sequence[str], at: str, out: str) -> DataFrame:
    """Take ``out`` from the lookup row of the same key whose ``at`` is nearest; on a tie the lower ``at``.

    Distinct values and points are merged in one order per key; a running maximum carries the last point up to each value,
    a running minimum from above the next one, and the rows meet their value again in an equi-join. So a key may have any
    number of points and rows. Of equal points the smallest ``out`` counts.
    """
    keys = list(on)
    values = settle(df.select(*keys, F.col(value).cast("double").alias("_at")).where("_at IS NOT NULL").distinct())
    points = lookup.groupBy(*keys, F.col(at).cast("double").alias("_at")).agg(F.min(out).alias("_o"))
    points = settle(points.select(*keys, "_at", F.struct(F.col("_at").alias("a"), F.col("_o").alias("o")).alias("_p")))
    def carried(kind: str, side: int, descending: bool) -> DataFrame:
        both = values.withColumn("_side", F.lit(side)).unionByName(points.withColumn("_side", F.lit(0)), allowMissingColumns=True)
        return running(both, keys, ["_at", "_side"], {"_near": (kind, F.col("_p"))}, descending=descending).where(F.col("_side") == side)
    below = carried("max", 1, False).select(*keys, "_at", F.col("_near").alias("_below"))
    above = carried("min", -1, True).select(*keys, "_at", F.col("_near").alias("_above"))
    met = [below[c].eqNullSafe(above[c]) for c in [*keys, "_at"]]
    pairs = below.join(above, reduce(lambda x, y: x & y, met)).select(*[below[c].alias(f"_k_{c}") for c in keys], below["_at"].alias("_x"), "_below", "_above")
    low, high = F.col("_x") - F.col("_below.a"), F.col("_above.a") - F.col("_x")
    nearest = F.when(F.col("_above").isNull() | (low <= high), F.col("_below.o")).otherwise(F.col("_above.o"))
    found = pairs.select(*[f"_k_{c}" for c in keys], "_x", nearest.alias("_found"))
    joined = df.withColumn("_v", F.col(value).cast("double"))
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_k_{c}") for c in keys], F.col("_v") == F.col("_x"))
    return joined.join(found, same, "left").withColumn(out, F.col("_found")).drop("_v", "_x", "_found", *[f"_k_{c}" for c in keys])


def bracket_join(df: DataFrame, value: str, brackets: DataFrame, out: str, lo: str = "from", hi: str = "to") -> DataFrame:
    """Take ``out`` from the bracket with ``lo < value <= hi``; NULL outside all brackets. Brackets do not overlap.

    NULL bounds are open. Distinct values and lower edges are merged in one order, a running maximum carries the last
    edge to each value, and the rows meet their value again in an equi-join: brackets may be as many as values, and
    nothing is collected.
    """
    infinity = F.lit(float("inf"))
    edge = F.struct(
        F.coalesce(F.col(lo).cast("double"), -infinity).alias("l"), F.coalesce(F.col(hi).cast("double"), infinity).alias("h"), F.col(out).alias("o"))
    values = df.select(F.col(value).cast("double").alias("_at")).where("_at IS NOT NULL").distinct().withColumn("_side", F.lit(0))
    edges = brackets.select(edge.alias("_edge")).select(F.col("_edge.l").alias("_at"), F.lit(1).alias("_side"), "_edge")
    merged = running(values.unionByName(edges, allowMissingColumns=True), [], ["_at", "_side"], {"_last": ("max", F.col("_edge"))})
    found = merged.where("_side = 0 AND _at <= _last.h").select("_at", F.col("_last.o").alias("_found"))
    joined = df.withColumn("_x", F.col(value).cast("double")).join(found, F.col("_x") == F.col("_at"), "left")
    return joined.withColumn(out, F.col("_found")).drop("_x", "_at", "_found")


def with_values(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Repeat every row for each value of a short literal list (horizons, time points)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


#: Values that a broadcast row or a block of them holds, and the copies of each block.
BLOCK_VALUES, COPIES = 1000, 64


def with_vocabulary(df: DataFrame, values: DataFrame, block_values: int = BLOCK_VALUES, copies: int = COPIES) -> DataFrame:
    """Every row of ``df`` with every different row of ``values``, a vocabulary of any size whose columns are added.

    A vocabulary of at most ``block_values`` rows travels as one broadcast row. A larger one is dealt over blocks of about
    so many, and a row meets each block in one of its copies, so neither side gathers in one task. Nulls are values.
    """
    listed = settle(values.distinct())
    n = listed.count()
    if n <= block_values:
        row = listed.agg(F.collect_list(F.struct(*listed.columns)).alias("_values")).withColumn("_one", F.lit(0))
        return df.withColumn("_one", F.lit(0)).join(F.broadcast(row), "_one").select(*df.columns, F.inline("_values"))
    blocks = -(-n // block_values)
    dealt = listed.groupBy(F.pmod(F.xxhash64(*listed.columns), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct(*listed.columns)).alias("_values"))
    copied = settle(dealt.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))))  # written, so its size is known
    rows = df.withColumn("_copy", F.pmod(F.xxhash64(*df.columns), F.lit(copies)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return rows.join(copied, ["_block", "_copy"]).select(*df.columns, F.inline("_values"))


def align_to(df: DataFrame, keys: DataFrame, on: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Exactly the rows of ``keys``; absent rows are filled with the given constants, else left NULL.

    Only absent rows are filled: a present row keeps its own NULLs. Either side may have any number of rows, and the planner
    does not count those that an explode makes, so nothing is broadcast.
    """
    marked = df.withColumn("_present", F.lit(True))
    joined = keys.select(*on).join(marked.hint("merge"), list(on), "left")
    for c, v in (fill or {}).items():
        joined = joined.withColumn(c, F.when(F.col("_present"), F.col(c)).otherwise(F.lit(v)))
    return joined.drop("_present")


#: Owners of a block of the fingerprint search, one bit each, and distinct sets of a part.
OWNERS_A_BLOCK, SETS_A_PART = 1 << 14, 1 << 15
#: Numbers of 64 bits that a task holds at once.
BIT_WORDS = 1 << 22
#: Rows of items that a task packs at once, items whose frequency orders the sets, and candidates looked at together.
PACKED_ROWS, RANKED_ITEMS, CANDIDATES = 1 << 20, 1000, 1 << 20
#: Tasks by blocks and by parts; each of the first sends the counts of its sets once.
BLOCK_TASKS, PART_TASKS = 16, 64


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for so many numbers, and so on."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 on in two bytes each where they fit, else in four."""
    return values.astype("<u2" if values.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


class _Holders:
    """Who holds what in a block of owners: item number ``item[i]`` is held by owner number ``at[i]``."""

    def __init__(self, item: np.ndarray, at: np.ndarray, items: int, owners: int):
        self.item, self.at, self.owners, self.rows = item, at, owners, items + 1  # the last row is that of items nobody has
        self.words = max(1, min((owners + 63) // 64, BIT_WORDS // self.rows + 1))
        self._whole = self._bits(0) if 64 * self.words >= owners else None

    def _bits(self, first: int) -> np.ndarray:
        here = (self.at >= first) & (self.at < first + 64 * self.words)
        bit = self.at[here] - first
        bits = np.zeros(self.rows * self.words, np.uint64)
        np.bitwise_or.at(bits, self.item[here] * self.words + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return bits.reshape(self.rows, self.words)

    def count(self, found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many owners hold each set; ``found`` has the item numbers of all sets one after the other."""
        counts = np.zeros(len(sizes), np.int64)
        starts = np.cumsum(sizes) - sizes
        for first in range(0, self.owners, 64 * self.words):
            bits = self._bits(first) if self._whole is None else self._whole
            held = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            for size in np.unique(sizes):
                of_size = np.flatnonzero(sizes == size)
                sets = found[starts[of_size][:, None] + np.arange(size)]
                if size == 1:
                    counts[of_size] += held[sets[:, 0]]
                    continue
                some = (held[sets] > 0).all(axis=1)
                counts[of_size[some]] += self._of_size(bits, sets[some])
        return counts

    def _of_size(self, bits: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """The bits that all items of a set have. Sets share the bits of their first two items, which few owners have."""
        counts = np.zeros(len(sets), np.int64)
        keys, pair = np.unique(sets[:, 0] * self.rows + sets[:, 1], return_inverse=True)
        order = np.argsort(pair, kind="stable")
        ends = np.searchsorted(pair[order], np.arange(len(keys) + 1))
        for at in range(0, len(keys), 1024):
            own = keys[at : at + 1024]
            both = bits[own // self.rows] & bits[own % self.rows]
            n = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
            mine = order[ends[at] : ends[at + len(own)]]
            p = pair[mine] - at
            if sets.shape[1] == 2:
                counts[mine] = n[p]
                continue
            few = n <= 2 * self.words
            row, word = np.nonzero(np.where(few[:, None], both, 0))
            which, bit = np.nonzero(np.unpackbits(both[row, word].astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little"))
            holders = word[which] * 64 + bit  # those of the pairs that few have, pair after pair
            listed = np.where(few, n, 0)
            begins = np.cumsum(listed) - listed
            sparse = mine[few[p] & (n[p] > 0)]
            reach = np.cumsum(listed[pair[sparse] - at])
            for part in np.split(sparse, np.searchsorted(reach, np.arange(CANDIDATES, reach[-1], CANDIDATES))) if len(sparse) else ():
                counts[part] = self._listed(bits, sets[part], begins[pair[part] - at], listed[pair[part] - at], holders)
            dense = mine[~few[p]]
            for part in np.array_split(dense, len(dense) // 1024 + 1):
                all_of = both[pair[part] - at]
                for j in range(2, sets.shape[1]):
                    all_of &= bits[sets[part, j]]
                counts[part] = np.bitwise_count(all_of).sum(axis=1, dtype=np.int64)
        return counts

    def _listed(self, bits: np.ndarray, sets: np.ndarray, begins: np.ndarray, n: np.ndarray, holders: np.ndarray) -> np.ndarray:
        """Of the listed holders of the first two items, those that have the others too."""
        flat, one = bits.ravel(), np.uint64(1)
        which, owner = np.repeat(np.arange(len(sets)), n), holders[_spans(begins, n)]
        for j in range(2, sets.shape[1]):
            has = (flat[sets[which, j] * self.words + (owner >> 6)] >> (owner & 63).astype(np.uint64)) & one > 0
            which, owner = which[has], owner[has]
        return np.bincount(which, minlength=len(sets))


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The number of each value, and the distinct values."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _count_holders(held: pa.Table, sets: pa.Table) -> pa.Table:
    """How many owners of a block hold each set."""
    (item, items), (at, owners) = _numbered(held["_item"]), _numbered(held["_owner"])
    lists = sets["_set"].combine_chunks()
    found = pc.fill_null(pc.index_in(lists.flatten(), items), len(items)).to_numpy().astype(np.int64)
    counts = _Holders(item, at, len(items), len(owners)).count(found, pc.list_value_length(lists).to_numpy().astype(np.int64))
    return pa.table({"_id": sets["_id"], "_n": counts})


def _in_chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = rows - sum(b.num_rows for b in kept)
            kept.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in kept) == rows:
                yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def _packed(block: int, item: np.ndarray, codes: np.ndarray, at: np.ndarray, owners: pa.Array | None) -> dict:
    """Distinct pairs of an item and an owner, both as numbers, item by item."""
    pairs = np.unique((item << 32) | at)
    item, at = pairs >> 32, pairs & 0xFFFFFFFF
    own = {} if owners is None else {"_owners": owners.to_pylist()}
    return {"_block": block, "_codes": codes.astype("<i8").tobytes(), "_sizes": np.bincount(item, minlength=len(codes)).astype("<u4").tobytes(),
            "_n": len(at), "_at": _narrow(at), **own}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item numbers, their codes, and owner numbers."""
    codes = np.frombuffer(row["_codes"], "<i8")
    return np.repeat(np.arange(len(codes)), np.frombuffer(row["_sizes"], "<u4")), codes, _wide(row["_at"], row["_n"])


_PACKED = "_block int, _codes binary, _sizes binary, _n int, _at binary"


def _pack_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of a task's owners by block."""
    for table in _in_chunks(batches, PACKED_ROWS):
        schema = pa.schema([("_block", pa.int32()), ("_codes", pa.binary()), ("_sizes", pa.binary()), ("_n", pa.int32()), ("_at", pa.binary()),
                            ("_owners", pa.list_(table.schema.field("_owner").type))])
        block = table["_block"].to_numpy()
        order = np.argsort(block, kind="stable")
        table = table.take(pa.array(order))
        ends = np.flatnonzero(np.diff(block[order], append=-1)) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            at, owners = _numbered(table["_owner"].slice(a, b - a))
            codes, item = np.unique(table["_code"].slice(a, b - a).to_numpy(), return_inverse=True)
            yield pa.RecordBatch.from_pylist([_packed(int(block[order[a]]), item, codes, at, owners)], schema=schema)


def _pack_block(group: pa.Table) -> pa.Table:
    """All owners of a block, whichever task met them."""
    owners = pa.chunked_array([pc.list_flatten(c) for c in group["_owners"].chunks])
    number, _ = _numbered(owners)
    first, codes, items, ats = 0, [], [], []
    for row in group.drop_columns("_owners").to_pylist():
        item, own, at = _unpacked(row)
        codes.append(own[item])
        ats.append(at)
    for length, at in zip(pc.list_value_length(group["_owners"]).to_pylist(), ats, strict=True):
        items.append(number[first + at])
        first += length
    distinct, item = np.unique(np.concatenate(codes), return_inverse=True)
    out = _packed(group["_block"][0].as_py(), item, distinct, np.concatenate(items), None)
    return pa.table({k: [v] for k, v in out.items()}, schema=pa.schema([group.schema.field(k) for k in out])).append_column("_owners_n", pa.array([int(number.max(initial=-1)) + 1], pa.int32()))


def _rarest_first(codes: np.ndarray, n: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets as bytes, the rarest items first, and their first two items; ``codes`` are the frequent ones, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_set")
            sizes, own = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy()
            place = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
            often = np.where(codes[place] == own, n[place], 0)
            starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            own = own[np.lexsort((own, often, row))]
            raw = own.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([raw[8 * a : 8 * (a + k)] for a, k in zip(starts, sizes, strict=True)], pa.binary()),
                 pa.array(own[starts]), pa.array(own[starts + np.minimum(1, sizes - 1)])], ["_id", "_items", "_a", "_b"])

    return run


def _pack_sets(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for table in _in_chunks(batches, most):
            sizes = pc.binary_length(table["_items"]).to_numpy() // 8
            codes, item = np.unique(np.frombuffer(b"".join(table["_items"].to_pylist()), "<i8"), return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "_part": pa.array([part], pa.int64()), "_ids": pa.array([b"".join(table["_id"].to_pylist())], pa.binary()),
                "_set_codes": pa.array([codes.tobytes()], pa.binary()), "_set_n": pa.array([len(item)], pa.int32()),
                "_set_items": pa.array([_narrow(item)], pa.binary()), "_set_sizes": pa.array([sizes.astype("<u4").tobytes()], pa.binary())})
            part += 1

    return run


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the holders of each part's sets in each block, summed over the task's blocks."""
    found: dict[int, np.ndarray] = {}
    block, holders, codes = None, None, np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            if row["_block"] != block:
                item, codes, at = _unpacked(row)
                block, holders = row["_block"], _Holders(item, at, len(codes), row["_owners_n"])
            wanted = np.frombuffer(row["_set_codes"], "<i8")
            place = np.searchsorted(codes, wanted)
            place[(place == len(codes)) | (codes[np.minimum(place, len(codes) - 1)] != wanted)] = len(codes)
            counts = holders.count(place[_wide(row["_set_items"], row["_set_n"])], np.frombuffer(row["_set_sizes"], "<u4").astype(np.int64))
            found[row["_part"]] = found[row["_part"]] + counts if row["_part"] in found else counts
    for part, counts in found.items():
        yield pa.RecordBatch.from_pydict({"_part": pa.array([part], pa.int64()), "_counts": pa.array([counts.astype("<i8").tobytes()], pa.binary())})


def _sum_counts(sets: pa.Table, counted: pa.Table) -> pa.Table:
    """The sets of a part with their counts of all tasks."""
    ids = sets["_ids"][0].as_py()
    total = np.zeros(len(ids) // 16, np.int64)
    for raw in counted["_counts"]:
        total += np.frombuffer(raw.as_buffer(), "<i8")
    return pa.table({"_id": pa.array([ids[i : i + 16] for i in range(0, len(ids), 16)], pa.binary()), "n_matches": total})


def fingerprint_matches(items: DataFrame, owner: str, fingerprints: DataFrame, item: Sequence[str]) -> DataFrame:
    """For each owner's item set, the number of ``items`` owners that hold the whole set.

    Equal sets are matched once. Owners are packed into blocks and distinct sets into parts, a row each; items are numbers there.
    Each block meets each part in a Cartesian product of these two settled tables, which writes neither of them
    again, so what lies on disk grows with the rows and not with their square. A task has the items of one block as rows
    of bits, one bit an owner, and no pair of owners and no pair of a set and its holder becomes a row. Sets come in the order of their
    rarest items: those with the same first two share these items' holders. An owner that is null holds and matches nothing.
    """
    spark = items.sparkSession
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in item])
    sets = settle(fingerprints.groupBy(owner).agg(F.array_sort(F.collect_set(text)).alias("_set")))
    needed = settle(sets.where(F.col(owner).isNotNull()).select(F.explode("_set").alias("_item")).groupBy("_item").agg(F.count(F.lit(1)).alias("_n")))
    seed, code = 0, lambda x: F.xxhash64(F.lit(seed), x)
    while len(set(needed.agg(F.countDistinct(code(F.col("_item"))), F.count("_item")).first())) > 1:
        seed += 1  # two items had one number
    id = F.unhex(F.md5(F.array_join("_set", "\u0002").cast("binary"))).alias("_id")
    often = sorted((r["_code"], r["_n"]) for r in needed.orderBy(F.desc("_n"), "_item").limit(RANKED_ITEMS).select(code(F.col("_item")).alias("_code"), "_n").collect())
    distinct = settle(sets.where(F.col(owner).isNotNull()).select(id, F.transform("_set", code).alias("_set")).distinct())
    empty = sets.select(owner, F.lit(0).cast("long").alias("n_matches"))
    if not often:
        return empty
    n_parts = distinct.count() // SETS_A_PART + 1
    ordered = distinct.mapInArrow(_rarest_first(*map(np.array, zip(*often, strict=True))), "_id binary, _items binary, _a bigint, _b bigint")
    ordered = ordered.repartitionByRange(n_parts, "_a", "_b", "_id").sortWithinPartitions("_a", "_b", "_id")
    parts = settle(ordered.mapInArrow(_pack_sets(2 * SETS_A_PART), "_part bigint, _ids binary, _set_codes binary, _set_n int, _set_items binary, _set_sizes binary"), group_rows=1)
    held = items.where(F.col(owner).isNotNull()).select(F.col(owner).alias("_owner"), text.alias("_item")).join(needed.select("_item"), "_item", "left_semi")
    n_blocks = items.agg(F.approx_count_distinct(owner)).first()[0] // OWNERS_A_BLOCK + 1
    coded = held.select(F.pmod(F.xxhash64("_owner"), F.lit(n_blocks)).cast("int").alias("_block"), "_owner", code(F.col("_item")).alias("_code"))
    packed = coded.mapInArrow(_pack_held, f"{_PACKED}, _owners array<{held.schema['_owner'].dataType.simpleString()}>")
    blocks = settle(packed.groupBy("_block").applyInArrow(_pack_block, f"{_PACKED}, _owners_n int"), group_rows=1)
    left = blocks.repartition(min(n_blocks, BLOCK_TASKS))
    right = parts.drop("_ids").repartition(min(n_parts, PART_TASKS))
    counted = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(_count_pairs, "_part bigint, _counts binary")
    with arrow_batches(spark, 1):
        matched = settle(parts.select("_part", "_ids").groupBy("_part").cogroup(counted.groupBy("_part")).applyInArrow(_sum_counts, "_id binary, n_matches bigint"))
    own = sets.select(owner, F.when(F.col(owner).isNotNull(), id).alias("_id"))
    return own.join(matched, "_id", "left").select(owner, F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"))


def rows_of_matched(items: DataFrame, owner: str, matches: DataFrame, at_least: int) -> DataFrame:
    """The rows of the owners whose set has ``at_least`` holders, with that number.

    These owners are settled, so that the items are not dealt by owner before it is known how few they may be.
    """
    return items.join(settle(matches.where(F.col("n_matches") >= at_least)), owner)
