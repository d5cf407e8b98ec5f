"""Operator 8: SimHash near-duplicates through a hierarchical index over Gray-ordered fingerprints.

Fingerprints within ``distance`` bits agree in at least one of ``distance + 1`` blocks of bits. For every block the
distinct fingerprints are range-sorted by (block value, Gray rank), so fingerprints of one block value lie together
in an order where neighbours differ in few bits; a value shared by many is simply spread over several ranges. Each
range is cut into nodes. A node keeps the bits that all its fingerprints share (a mask and the masked pattern), and
within a node the same is factored out for groups of 512, 64 and 8. Two nodes, or two groups, are compared by the
shared bits in which they differ: bits decided at upper levels are never looked at again for a pruned group, and a
pair of groups that already differs in more than ``distance`` of them is dropped whole. What is left is compared
fingerprint by fingerprint. A comparison of two nodes reports a spanning forest of its links, never all pairs, and
components of these forests are found by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, free_name, materialise, row_key, text_or_empty

NODE = 4096
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(data: bytes, width: int = 3) -> int:
    """The SimHash of one UTF-8 text: a bit is 1 if over half of the shingles' XXH64 (seed 42) have it."""
    import xxhash

    words = data.lower().split()  # bytes: lower-cases A-Z only and cuts at the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """All columns of ``docs`` and ``fp``, the fingerprint as a signed long. Null text counts as empty."""
    columns = [c for c in docs.columns if c != "fp"]
    where = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*columns, "fp"])

    schema = docs.select(*columns).schema.add("fp", "long")
    return docs.select(*columns).mapInArrow(run, schema)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the reflected Gray order: the inverse of x ^ (x >> 1)."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _gray_column(fp: Column) -> Column:
    """The same as an expression; the sign bit is flipped so that signed longs sort as unsigned ones."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shared(fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``size``: the bits set in all members, and those set in any."""
    at = np.arange(0, len(fps), size)
    return np.bitwise_and.reduceat(fps, at, axis=0), np.bitwise_or.reduceat(fps, at, axis=0)


def pairs_within(a: np.ndarray, b: np.ndarray, distance: int, sizes: tuple[int, ...] = (512, 64, 8, 1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i, j) with at most ``distance`` differing bits, found top-down through the groups."""
    a, b = (x.reshape(len(x), -1) for x in (a, b))  # fingerprints of one word or several
    levels = [(_shared(a, s), _shared(b, s)) for s in sizes]

    def near(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differences in shared bits accumulate word by word; a pair of groups goes once they are too many."""
        (all_a, any_a), (all_b, any_b) = levels[level]
        apart = np.zeros(len(i), dtype=np.int64)
        for w in range(a.shape[1]):
            apart = apart + _popcount((all_a[i, w] & ~any_b[j, w]) | (all_b[j, w] & ~any_a[i, w]))
            kept = apart <= distance
            i, j, apart = i[kept], j[kept], apart[kept]
        return i, j

    def descend(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j = near(level, i, j)
        if level + 1 == len(sizes):
            if len(i):
                yield i, j
            return
        fan = sizes[level] // sizes[level + 1]
        n, m = len(levels[level + 1][0][0]), len(levels[level + 1][1][0])
        step = max(1, 500_000 // (fan * fan))
        for at in range(0, len(i), step):
            x = (i[at : at + step, None, None] * fan + np.arange(fan)[:, None]) + np.zeros((1, 1, fan), dtype=np.int64)
            y = (j[at : at + step, None, None] * fan + np.arange(fan)[None, :]) + np.zeros((1, fan, 1), dtype=np.int64)
            x, y = x.ravel(), y.ravel()
            there = (x < n) & (y < m)
            yield from descend(level + 1, x[there], y[there])

    n, m = len(levels[0][0][0]), len(levels[0][1][0])
    yield from descend(0, np.repeat(np.arange(n), m), np.tile(np.arange(m), n))


class Forest:
    """Union-find over the fingerprints of one comparison; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            x, y = self.label[i], self.label[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if not len(i):
                return
            low, high = np.minimum(x, y), np.maximum(x, y)
            # each tree hooks onto one lower tree at a time, so no circle can form
            roots, first = np.unique(high, return_index=True)
            self.links += zip(i[first].tolist(), j[first].tolist(), strict=True)
            parent = np.arange(len(self.label))
            parent[roots] = low[first]
            while not np.array_equal(parent, up := parent[parent]):
                parent = up
            self.label = parent[self.label]


def forest_links(a: np.ndarray, b: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs within ``a`` (b None) or between ``a`` and ``b`` connect."""
    both = a if b is None else np.concatenate((a, b))
    shift = 0 if b is None else len(a)
    forest = Forest(len(both))
    for i, j in pairs_within(a, a if b is None else b, distance):
        if b is None:
            upper = i < j
            i, j = i[upper], j[upper]
        forest.add(i, j + shift)
    if not forest.links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    links = np.array(forest.links)
    return both[links[:, 0]], both[links[:, 1]]


def _nodes(fps: DataFrame, distance: int) -> DataFrame:
    """Nodes of the index: (block, value, node, members, all_bits, any_bits); ``members`` are little-endian longs."""
    cuts = [64 * k // (distance + 1) for k in range(distance + 2)]
    values = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), v.alias("value")) for k, v in enumerate(values)])
    placed = fps.select("fp", F.explode(blocks).alias("x")).select("x.block", "x.value", "fp", _gray_column(F.col("fp")).alias("gray"))
    ordered = placed.repartitionByRange("block", "value", "gray").sortWithinPartitions("block", "value", "gray").select("block", "value", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        held: tuple[np.ndarray, ...] = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64))

        def cut(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            block, value, fp = rows
            if not len(fp):
                return
            new = np.flatnonzero((np.diff(block) != 0) | (np.diff(value) != 0)) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(fp)]))
            out = []
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                if b - a == 1 and 0 < k < len(starts) - 1:  # at the edges it may go on elsewhere
                    continue
                for at in range(a, b, NODE):
                    own = fp[at : min(b, at + NODE)]
                    out.append((int(block[a]), int(value[a]), (task << 32) + serial, own.astype("<i8").tobytes(), int(np.bitwise_and.reduce(own)), int(np.bitwise_or.reduce(own))))
                    serial += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["block", "value", "node", "members", "all_bits", "any_bits"])

        for batch in batches:
            got = tuple(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            rows = tuple(np.concatenate(x) for x in zip(held, got, strict=True))
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])) if len(rows[0]) else []
            # rows of the last value wait for the next batch, unless whole nodes of it are full
            stop = int(last[-1]) + 1 if len(last) else 0
            if len(rows[0]) - stop >= 64 * NODE:
                stop = len(rows[0]) - (len(rows[0]) - stop) % NODE
            yield from cut(tuple(x[:stop] for x in rows))
            held = tuple(x[stop:] for x in rows)
        yield from cut(held)

    return ordered.mapInArrow(run, "block int, value long, node long, members binary, all_bits long, any_bits long")


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links that connect every two of the distinct longs in ``fps.fp`` that ``distance`` or fewer bits part."""
    nodes = materialise(_nodes(fps, distance), "nodes")
    left = nodes.select("block", "value", F.col("node").alias("n1"), F.col("members").alias("m1"), F.col("all_bits").alias("all1"), F.col("any_bits").alias("any1"))
    right = nodes.select("block", "value", F.col("node").alias("n2"), F.col("members").alias("m2"), F.col("all_bits").alias("all2"), F.col("any_bits").alias("any2"))
    apart = F.bit_count(F.col("all1").bitwiseAND(F.bitwise_not("any2")).bitwiseOR(F.col("all2").bitwiseAND(F.bitwise_not("any1"))))
    between = left.join(right, ["block", "value"]).where((F.col("n1") < F.col("n2")) & (apart <= distance)).select("m1", "m2")
    within = left.where(F.length("m1") > 8).select("m1", F.lit(None).cast("binary").alias("m2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest_links(np.frombuffer(x, "<u8"), None if y is None else np.frombuffer(y, "<u8"), distance) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            sides = [np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, sides)), ["a", "b"])

    return within.union(between).mapInArrow(run, "a long, b long").distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every end of ``pairs`` (a, b): root is the least node that it is connected with.

    Large-star and small-star rounds: each round is two aggregations and joins over the links, which shrink to stars.
    """
    edges = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(edges)
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components have not settled")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def with_components(rows: DataFrame, distance: int = 3) -> DataFrame:
    """``rows`` (a stored table with doc_id and fp) with ``component_id``: the least doc_id among all rows whose
    fingerprints can be reached by links of ``distance`` or fewer differing bits. Null if none of them has an id."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fps")
    stars = components(links(distinct, distance))
    stars = materialise(stars, "stars")
    members = distinct.join(stars, distinct["fp"] == stars["node"]).select("fp", "root", "least_id")
    roots = members.groupBy("root").agg(F.min("least_id").alias("component"))
    linked = members.join(roots, "root").select("fp", "component")
    ids = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "least_id").alias("component_id"))
    return rows.join(ids, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Null or empty text has fingerprint zero and is linked like any other. Equal rows each get a row. A row with a
    null doc_id takes part and keeps its null; a component without any id has a null component_id. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    stored = materialise(fingerprints(rows, width).select("doc_id", "fp"), "rows")
    return with_components(stored, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id (then the least text).

    Of rows with equal id and text one stays. Rows without a doc_id stay where their component has no other row.
    """
    key, mine = free_name(docs, "row_key"), docs.columns
    keyed = docs.withColumn(key, row_key())
    slim = materialise(fingerprints(keyed.select("doc_id", text_or_empty().alias("text"), key), width).select("doc_id", key, "fp"), "rows")
    distinct = materialise(slim.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("best")), "fps")
    stars = materialise(components(links(distinct, distance)), "stars")
    grouped = distinct.join(stars, distinct["fp"] == stars["node"], "left").select(F.coalesce("root", "fp").alias("root"), "best")
    kept = grouped.groupBy("root").agg(F.min("best").alias("best")).select(F.col(f"best.{key}").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*mine)
