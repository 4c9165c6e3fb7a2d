"""Lloyd's clustering with the dimensions dealt out: each shard holds a block of columns and a slice of every centroid.

Vectors become integers and are written once as rows of (chunk of vectors, block of columns). In a round, tasks over
these rows compute exact partial distances against their slice of the centroids; the partial distances of a chunk are added
up by key, where each vector takes its nearest centroid; and each shard sums its own columns by cluster, which gives its
slice of the next centroids. Only centroids and their sums, k times the number of components, ever meet in one place.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.session import settle

K, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, 2
#: Columns of a shard. A round sends shards x k numbers a vector.
BLOCK = 16
#: Vectors of a chunk: bounds what a task holds.
CHUNK = 4096
#: Integer components are held within this range.
REACH = 1 << 62
MAX_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Clusters:
    """``members``: (id, cluster, distance) a vector; ``centroids``: the final ones, in order."""

    members: DataFrame
    centroids: list[list[int]]

    @property
    def digests(self) -> list[str]:
        """The SHA-256 of each centroid's components, written as decimal integers joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held within ``REACH``."""
    scaled = np.floor(scale * values.astype(np.float64))
    inside = np.abs(scaled) < REACH
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), np.where(scaled > 0, REACH, -REACH))


def _pack(values: np.ndarray) -> tuple[int, bytes]:
    """Integers in the narrowest form that holds them: (bytes a number, data); 0 bytes mark numbers beyond 64 bits."""
    top = int(np.abs(values).max(initial=0))
    width = next((w for w in (2, 4, 8) if top < 1 << 8 * w - 1), 0)
    return width, (values.astype(f"<i{width}").tobytes() if width else pickle.dumps(values.tolist()))


def _unpack(width: int, raw: bytes, columns: int) -> np.ndarray:
    flat = np.frombuffer(raw, dtype=f"<i{width}") if width else np.array(pickle.loads(raw), dtype=object)
    return flat.reshape(-1, columns)


def squared_distances(cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows: in doubles while every sum stays below 2**53, else in wider integers."""
    top = max(int(np.abs(cells).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    most = 4 * top * top * max(1, cells.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    a, b = cells.astype(kind), centroids.astype(kind)
    out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    return out.astype(np.int64) if kind is np.float64 else out


def _deal(block: int, scale: int, components: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                n, ids = part.num_rows, part.column("_id")
                values = part.column("_vector").flatten().to_numpy(zero_copy_only=False).reshape(n, components)
                cells = _integers(values, scale)
                packed = [_pack(cells[:, i : i + block]) for i in range(0, components, block)]
                b = len(packed)
                lists = pa.ListArray.from_arrays(pa.array([0, *[n] * b], pa.int32()), ids)  # the ids go with the first block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * b, pa.int64()), pa.array(range(b), pa.int32()), lists,
                     pa.array([w for w, _ in packed], pa.int32()), pa.array([r for _, r in packed], pa.binary())],
                    ["chunk", "block", "ids", "width", "cells"])
                chunk += 1

    return run


def _partial(centroids: Broadcast, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distances of each chunk in one block of columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = centroids.value
        for batch in batches:
            for row in batch.to_pylist():
                own = whole[:, row["block"] * block : (row["block"] + 1) * block]
                width, raw = _pack(squared_distances(_unpack(row["width"], row["cells"], own.shape[1]), own))
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([row["chunk"]], pa.int64()), "width": pa.array([width], pa.int32()), "sums": pa.array([raw], pa.binary())})

    return run


def _nearest(k: int) -> Callable[[pa.Table], pa.Table]:
    """Adds the blocks of a chunk and takes each vector's nearest centroid, the smaller number in ties."""
    def run(group: pa.Table) -> pa.Table:
        total = None
        for width, raw in zip(group.column("width").to_pylist(), group.column("sums").to_pylist(), strict=True):
            own = _unpack(width, raw, k)
            own = own if own.dtype == object else own.astype(np.int64)
            if total is not None and total.dtype != object and own.dtype != object and max(int(total.max(initial=0)), int(own.max(initial=0))) >= 1 << 62:
                own = own.astype(object)
            total = own if total is None else total + own
        cluster = np.argmin(total, axis=1)
        distance = np.minimum(total[np.arange(len(total)), cluster], MAX_LONG).astype(np.int64)
        return pa.table({
            "chunk": pa.array([group.column("chunk")[0].as_py()], pa.int64()),
            "clusters": pa.array([cluster.astype("<i4").tobytes()], pa.binary()),
            "distances": pa.array([distance.astype("<i8").tobytes()], pa.binary())})

    return run


def _sums(k: int, block: int, components: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of each shard's columns by cluster, added up within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                columns = min(block, components - row["block"] * block)
                cells = _unpack(row["width"], row["cells"], columns).astype(object if row["width"] == 8 else np.float64)
                cluster = np.frombuffer(row["clusters"], dtype="<i4")
                sums = np.zeros((k, columns), dtype=object)
                if row["width"] == 8:
                    np.add.at(sums, cluster, cells)
                else:  # at most CHUNK numbers below 2**31: exact in doubles
                    held = np.zeros((k, len(cluster)))
                    held[cluster, np.arange(len(cluster))] = 1
                    sums += (held @ cells).astype(np.int64)
                counts = np.bincount(cluster, minlength=k)
                before = found.get(row["block"])
                found[row["block"]] = (sums, counts) if before is None else (before[0] + sums, before[1] + counts)
        for b, (sums, counts) in found.items():
            c, i = (x.ravel() for x in np.nonzero(np.broadcast_to(counts[:, None] > 0, sums.shape)))
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(c, pa.int32()), "at": pa.array(b * block + i, pa.int32()), "n": pa.array(counts[c], pa.int64()),
                "total": pa.array([str(x) for x in sums[c, i]], pa.string())})

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            cluster = np.frombuffer(batch.column("clusters")[i].as_py(), dtype="<i4")
            distance = np.frombuffer(batch.column("distances")[i].as_py(), dtype="<i8")
            yield pa.RecordBatch.from_arrays(
                [pc.list_flatten(batch.column("ids").slice(i, 1)), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                ["_id", "cluster", "distance"])


def cluster(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
            components: int = COMPONENTS, block: int = BLOCK, scale: int = SCALE, seed: int = SEED) -> Clusters:
    """Clusters of the vectors with exactly ``components`` components, none null, NaN or infinite; others are left out.

    Component x counts as floor(scale * x), within plus or minus 2**62. The first centroids are the vectors whose
    ``seed:id`` have the smallest SHA-256, in this order (a null id counts as empty text, equal ids go by their
    components); there are fewer than ``k`` where fewer vectors are kept, and none for an empty table. Each of ``rounds``
    rounds assigns each vector to the nearest centroid, the smaller number in ties, and moves each centroid that has
    vectors to the floor of their mean. Distances and means are exact; a distance beyond a long is the largest long.
    Repeated rows and equal vectors count each. Columns other than these two are not looked at, and ``cluster`` and
    ``distance`` are the names of what is added, whatever the table calls its own columns.
    """
    spark = vectors.sparkSession
    usable = F.expr("size(_vector) = {0} AND forall(_vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))".format(components))
    kept = vectors.select(F.col(id).alias("_id"), F.col(vector).cast("array<double>").alias("_vector")).where(usable)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = kept.select(rank.alias("_rank"), "_vector").orderBy("_rank", "_vector").limit(k).collect()
    centroids = _integers(np.array([r["_vector"] for r in first], dtype=np.float64).reshape(len(first), components), scale).astype(object)
    id_type = kept.schema["_id"].dataType.simpleString()
    if not first:
        return Clusters(spark.createDataFrame([], f"`{id}` {id_type}, cluster int, distance bigint"), [])
    dealt = settle(kept.mapInArrow(_deal(block, scale, components), f"chunk bigint, block int, ids array<{id_type}>, width int, cells binary"))

    def assigned() -> DataFrame:
        partial = dealt.select("chunk", "block", "width", "cells").mapInArrow(
            _partial(spark.sparkContext.broadcast(centroids), block), "chunk bigint, width int, sums binary")
        return partial.groupBy("chunk").applyInArrow(_nearest(len(first)), "chunk bigint, clusters binary, distances binary")

    for _ in range(rounds):
        own = dealt.select("chunk", "block", "width", "cells").join(assigned().select("chunk", "clusters"), "chunk")
        sums = own.mapInArrow(_sums(len(first), block, components), "cluster int, at int, n bigint, total string")
        moved = sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        centroids = centroids.copy()
        for row in moved.collect():  # k x components rows
            centroids[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    placed = dealt.where("block = 0").select("chunk", "ids").join(assigned(), "chunk")
    members = placed.mapInArrow(_members, f"_id {id_type}, cluster int, distance bigint")
    return Clusters(settle(members.withColumnRenamed("_id", id)), [[int(x) for x in c] for c in centroids])


def described(found: Clusters) -> DataFrame:
    """The members with the inertia of their cluster and of all, and their centroid's digest."""
    spark = found.members.sparkSession
    long = lambda c: F.least(c, F.lit(MAX_LONG).cast("decimal(38,0)")).cast("bigint")
    own = found.members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum")).collect()  # a row a cluster
    total = sum(r["_sum"] for r in own)
    rows = [(r["cluster"], r["_sum"], total, found.digests[r["cluster"]]) for r in own]
    table = spark.createDataFrame(rows, "_cluster int, _sum decimal(38,0), _total decimal(38,0), centroid_sha256 string")
    joined = found.members.join(F.broadcast(table), F.col("cluster") == F.col("_cluster"))
    return joined.drop("_cluster").withColumns({"cluster_inertia": long(F.col("_sum")), "inertia": long(F.col("_total"))}).drop("_sum", "_total")
