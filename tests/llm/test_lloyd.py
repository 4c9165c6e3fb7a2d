"""Sharded Lloyd against the plain algorithm in Python integers."""

from __future__ import annotations

import hashlib
import math

import pytest

from vitalspan.llm import lloyd


def _plain(rows, k, rounds, components, scale=256, seed=2):
    held = [(i, [max(-lloyd.REACH, min(lloyd.REACH, math.floor(scale * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(held, key=lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centroids = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in held]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(held, near, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, c, min(d, lloyd.MAX_LONG)) for (i, _), (d, c) in zip(held, assign(), strict=True)), key=repr), centroids


def _rows(found):
    return sorted(((r[0], r[1], r[2]) for r in found.members.collect()), key=repr)


@pytest.mark.parametrize("block", [2, 3, 16])
def test_against_plain(spark, block):
    rows = [(i, [math.sin(i * j + 1) * (1 + i % 3) for j in range(5)]) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(120)] + [(rows[3][0], rows[3][1])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    exact = [(r.vec_id, r.embedding) for r in vectors.collect()]
    found = lloyd.cluster(vectors, k=7, rounds=3, components=5, block=block)
    assert (_rows(found), found.centroids) == _plain(exact, 7, 3, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (None, [0.5, -0.001]), (8, [1e200, -1e200]), (9, [3e7, -4e9]), (10, [1.0, 2.0]), (10, [1.0, 2.0])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, cluster string, distance int")
    found = lloyd.cluster(vectors, k=3, rounds=2, components=2, block=1)
    assert (_rows(found), found.centroids) == _plain(rows, 3, 2, 2)
    own = lloyd.described(found).collect()
    assert len(own) == 6 and all(r.centroid_sha256 == found.digests[r.cluster] for r in own)
    few = lloyd.cluster(vectors.where("vec_id = 0"), k=3, rounds=2, components=2)
    assert _rows(few) == [(0, 0, 0)] and len(few.centroids) == 1


def test_empty(spark):
    none = lloyd.cluster(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert none.members.count() == 0 and none.centroids == [] and lloyd.described(none).count() == 0


def test_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = lloyd.cluster(vectors)
    assert (_rows(found), found.centroids) == _plain([(r.vec_id, r.embedding) for r in vectors.collect()], 40, 5, 64)
