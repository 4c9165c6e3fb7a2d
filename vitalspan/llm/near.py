"""N-gram Jaccard join by MinHash labels in several trees.

Each text has one label a tree: the minima of several hash functions over its shingles. Texts that share a prefix of a
tree's labels are candidates. All trees use one prefix length, fixed by the parameters: the longest with which two texts of
just the wanted similarity share a prefix in some tree with the target recall, by the formula. There are no tries, and
nothing is shortened by the data. Candidates are then verified: the Jaccard similarity of their shingles is computed
exactly, so no wrong link is reported.

Copies of a text are one node. Candidate groups that hold the same nodes in several trees are kept once. A large group is
cut into blocks, and each pair of blocks is verified by itself, so no task holds a whole group and no pair is written: a
task returns each node's number of links and the node its local component hangs on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.texts import mix, sliced, split_words, window_hashes, window_positions, word_hashes
from vitalspan.session import settle

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TREES = 24
LABEL_HASHES = 10
TARGET_RECALL = 0.999
#: Nodes of a block; two blocks are verified together.
BLOCK_NODES = 256
NODE = "binary"


def recall(similarity: float, trees: int, depth: int) -> float:
    """The probability that two texts of this similarity share a prefix of ``depth`` hashes in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float = SIMILARITY, trees: int = TREES, longest: int = LABEL_HASHES, target: float = TARGET_RECALL) -> int:
    """Shortens the matched prefixes from whole labels until the target recall is reached."""
    depth = longest
    while depth > 1 and recall(similarity, trees, depth) < target:
        depth -= 1
    return depth


def node_of(text: Column) -> Column:
    """The node of a text: equal texts are one; null and empty texts are equal."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts and where each text's begin; shorter texts have their words as one shingle."""
    words = split_words(texts)
    hashes = word_hashes(words)
    counts = np.diff(words.starts)
    at = window_positions(words.starts, size)
    long = window_hashes(hashes, size)[at] if len(at) else np.zeros(0, np.uint64)
    begins = np.concatenate([[0], np.cumsum(np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)))])
    out = np.empty(begins[-1], dtype=np.uint64)
    whole = np.repeat(counts >= size, np.diff(begins))
    out[whole] = long
    for row in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        own = hashes[words.starts[row] : words.starts[row + 1]]
        out[begins[row]] = window_hashes(own, len(own))[0] ^ np.uint64(len(own))
    return out, begins


def _labels(size: int, trees: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The prefix of each tree's label, hashed together with the tree's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in sliced(batches, "_text"):
            own, begins = shingles(batch.column("_text"), size)
            full = np.flatnonzero(np.diff(begins))
            labels = np.zeros((len(full), trees), dtype=np.uint64)
            for t in range(trees):
                label = np.full(len(full), t + 1, dtype=np.uint64)
                for k in range(depth):
                    salt = salts[t * depth + k]
                    least = np.minimum.reduceat((own ^ salt) * (salt | np.uint64(1)), begins[full]) if len(full) else label
                    label = mix(label * np.uint64(0x9E3779B97F4A7C15) + least)
                labels[:, t] = label
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(np.diff(begins) > 0, trees, 0))]), pa.int32()),
                pa.array(labels.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_node"), lists], ["id", "node", "labels"])

    return run


def _payloads(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each block pair that a node takes part in, with its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", 1 << 20):
            own, begins = shingles(batch.column("_text"), size)
            rows: list[tuple] = []
            for i, (node, copies, groups) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "copies", "groups")), strict=True)):
                distinct = np.unique(own[begins[i] : begins[i + 1]]).tobytes()
                buckets = sorted(g["bucket"] for g in groups)
                for g in groups:
                    blocks = -(-g["n"] // BLOCK_NODES)
                    block = int.from_bytes(node[:8], "little") % blocks
                    for other in range(blocks):
                        rows.append((g["bucket"], min(block, other), max(block, other), block, node, copies, buckets, distinct))
                    if len(rows) * len(distinct) > 1 << 24:
                        yield _table(rows, PAYLOAD)
                        rows = []
            yield _table(rows, PAYLOAD)

    return run


PAYLOAD = {"bucket": pa.int64(), "a": pa.int64(), "b": pa.int64(), "block": pa.int64(), "node": pa.binary(), "copies": pa.int64(),
           "buckets": pa.list_(pa.int64()), "shingles": pa.binary()}
LINKED = {"node": pa.binary(), "links": pa.int64(), "root": pa.binary()}


def _table(rows: list[tuple], schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], list(schema))


def _verify(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by block pair; each block pair is verified when its last row has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in PAYLOAD), strict=True):
                if row[:3] != key:
                    out += _links(key, held, similarity)
                    key, held = row[:3], []
                held.append(row[3:])
            if out:
                yield _table(out, LINKED)
        out = _links(key, held, similarity)
        if out:
            yield _table(out, LINKED)

    return run


def _links(key: tuple[int, int, int] | None, rows: list[tuple], similarity: float) -> list[tuple[bytes, int, bytes]]:
    """(node, linked documents, smallest node of its component) of the nodes that have links in this block pair.

    A pair of nodes is looked at in the smallest of the groups that both are in.
    """
    if len(rows) < 2:
        return []
    bucket, a, b = key
    nodes = [r[1] for r in rows]
    copies = np.array([r[2] for r in rows])
    block = np.array([r[0] for r in rows])
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    earlier = [{x for x in r[3] if x < bucket} for r in rows]
    x, y = np.triu_indices(len(rows), 1) if a == b else (v.ravel() for v in np.meshgrid(
        np.flatnonzero(block == a), np.flatnonzero(block == b), indexing="ij"))
    low, high = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
    near = low >= similarity * high
    x, y = x[near], y[near]
    if any(earlier):
        known = {v: i for i, v in enumerate(sorted(set().union(*earlier)))}
        bits = np.zeros((len(rows), len(known)), dtype=bool)
        for i, own in enumerate(earlier):
            bits[i, [known[v] for v in own]] = True
        first = _common(np.packbits(bits, axis=1), x, y) == 0
        x, y = x[first], y[first]
    if not len(x):
        return []
    member = np.repeat(np.arange(len(rows)), sizes)
    values, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[code] > 1
    place = (np.cumsum(often > 1) - 1)[code[shared]]
    member, width = member[shared], int((often > 1).sum())
    same = np.zeros(len(x), dtype=np.int64)
    for begin in range(0, width, 1 << 14):
        here = (place >= begin) & (place < begin + (1 << 14))
        bits = np.zeros((len(rows), min(1 << 14, width - begin)), dtype=bool)
        bits[member[here], place[here] - begin] = True
        same += _common(np.packbits(bits, axis=1), x, y)
    linked = same >= similarity * (sizes[x] + sizes[y] - same) - 1e-9
    x, y = x[linked & (same > 0)], y[linked & (same > 0)]
    links = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
    root = _local_roots(len(rows), x, y, nodes)
    return [(nodes[i], int(links[i]), nodes[root[i]]) for i in np.flatnonzero(links).tolist()]


def _common(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of bits that both rows of each pair have."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : bits.shape[1]] = bits
    wide = wide.view(np.uint64)
    out = np.empty(len(x), dtype=np.int64)
    step = max(1, (1 << 21) // max(1, wide.shape[1]))
    for i in range(0, len(x), step):
        out[i : i + step] = np.bitwise_count(wide[x[i : i + step]] & wide[y[i : i + step]]).sum(axis=1, dtype=np.int64)
    return out


def _local_roots(n: int, x: np.ndarray, y: np.ndarray, nodes: list[bytes]) -> np.ndarray:
    """For each row the row of the smallest node of its component."""
    order = sorted(range(n), key=nodes.__getitem__)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[np.array(order)[new]]
        if (new == label).all():
            return np.array(order)[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (u, v) that are not the smallest of their component, with that one as root.

    In each round every node hangs on its smallest neighbour if that is smaller, the trees are flattened by doubling steps,
    and edges are drawn between the roots that are left. Only the question whether edges are left reaches the driver.
    """
    tidy = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, labels = settle(tidy(edges)), None
    while not edges.isEmpty():
        hung = settle(edges.groupBy("u").agg(F.min("v").alias("v")))
        while True:
            up = hung.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
            step = settle(hung.join(up, F.col("v") == F.col("_u"), "left").select(
                "u", F.coalesce("_v", "v").alias("v"), F.col("_v").isNotNull().alias("moved")))
            hung = step.select("u", "v")
            if step.where("moved").isEmpty():
                break
        up = hung.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
        raised = lambda df, c, up=up: df.join(up, F.col(c) == F.col("_u"), "left").withColumn(c, F.coalesce("_v", c)).drop("_u", "_v")
        labels = hung if labels is None else settle(raised(labels, "v").unionByName(hung))
        edges = settle(tidy(raised(raised(edges, "u"), "v")))
    return (edges if labels is None else labels).select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("_id"), node_of(F.col(text)).alias("_node"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def join_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = SHINGLE_WORDS,
                 trees: int = TREES, longest: int = LABEL_HASHES, target: float = TARGET_RECALL) -> DataFrame:
    """One row a document: the id, ``node`` (its text's), ``class_id``, ``copy_id`` and ``n_links``.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is ``similarity`` or more, or if
    their texts are equal. ``class_id`` is the smallest id of the documents that links lead to, ``copy_id`` the smallest of
    equal texts, ``n_links`` the number of rows linked to this one. Words are unchanged; a text of fewer words has all of
    them as one shingle; null and empty texts have none and are copies of each other. Null ids are passed over when the
    smallest is looked for; repeated rows are copies; an empty table gives an empty one; other columns are not used.
    """
    depth = prefix_depth(similarity, trees, longest, target)
    source = _rows(docs, doc_id, text)
    signed = settle(source.mapInArrow(_labels(words, trees, depth), f"id bigint, node {NODE}, labels array<bigint>"))
    nodes = settle(signed.groupBy("node").agg(
        F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels")))
    leaves = nodes.select("node", "copies", F.explode("labels").alias("bucket"))
    groups = leaves.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = settle(groups.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    own = leaves.join(kept, "bucket").groupBy("node", "copies").agg(F.collect_list(F.struct("bucket", "n")).alias("groups"))
    texts = source.groupBy(F.col("_node").alias("node")).agg(F.first("_text").alias("_text"))
    types = ("bucket bigint, a bigint, b bigint, block bigint, node binary, copies bigint, buckets array<bigint>, shingles binary")
    sent = texts.join(own, "node").mapInArrow(_payloads(words), types)
    by_pair = sent.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    linked = settle(by_pair.mapInArrow(_verify(similarity), "node binary, links bigint, root binary"))
    roots = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.select("node", "copy_id", "copies").join(links, "node", "left").join(roots, "node", "left").select(
        "node", "copy_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    placed = settle(placed)
    classes = placed.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    wide = settle(placed.join(classes, "root").select(
        "node", "copy_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    return signed.select("id", "node").join(wide, "node").select(F.col("id").alias(doc_id), "node", "class_id", "copy_id", "n_links")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """One row of each class of ``join_classes``: that of the smallest id, and of these that of the smallest text hash.

    Of rows that repeat it one stays. A class of null ids alone keeps one of them. Columns of any name stay as they are.
    """
    classes = join_classes(docs, doc_id, text, **options)
    chosen = classes.groupBy("class_id").agg(F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id).alias("id"), "node")).alias("first"))
    chosen = chosen.select(F.col("first.id").alias("_id"), F.col("first.node").alias("_first"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    own = own.withColumns({"_key": own[names[docs.columns.index(doc_id)]].cast("long"), "_node": node_of(own[names[docs.columns.index(text)]])})
    met = own.join(chosen, (F.col("_node") == F.col("_first")) & F.col("_key").eqNullSafe(F.col("_id")), "left_semi")
    one = met.dropDuplicates(["_node", "_key"])
    return one.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
