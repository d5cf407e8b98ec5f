"""Operator 8 at a lower similarity: near copies by SimHash with an exact check.

The contract of the query links 64-bit fingerprints of 3-word shingles within 3 bits. Here documents are linked whose
sets of 5-word shingles have a Jaccard similarity of ``percent`` or more, which parts up to a seventh of the bits. So
fingerprints are wider (``BITS``), and one order of them is not enough:

1. In each of several tables bits are dealt out anew, and fingerprints range-sorted by the Gray rank of the first 64.
   In that order all that share ``prefix`` bits, whose number grows with the logarithm of the table, are a node. No node
   is capped: one with over ``NODE`` fingerprints, or with rows in two tasks, is cut into blocks, and every two
   blocks of a node are joined.
2. Within a node groups of 64 and 8 share patterns again; groups, and then fingerprints, are compared word by word,
   and dropped once their accumulated differences exceed ``radius``.
3. Of what is left a node reports spanning forests, nearest pairs first, and as crowds the members of trees that have
   further pairs.
4. Reported pairs are checked on whole shingle sets. Then the pairs of crowds that those which passed have not
   connected are held against sketches of the sets (``sketch``), which bound the difference of two sets from below and
   so rule out nearly all that are not similar, and no other. Of what is left a crowd reports a spanning forest, and
   then all pairs that are still not connected; those are checked as well, and components of all that pass are the
   groups. So no pair that meets in a node is left out. Documents in one node that resemble each other without being
   copies cost a comparison of words of bits each two, but aren't rows, except those within a few hundredths of the
   threshold.

The number of tables is such that a pair at the threshold meets in at least one with 99 in 100, closer ones nearly
always.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, key_marks, materialise, row_key, text_or_empty
from .simhash import Forest, components, gray_rank, pairs_within

BITS, NODE, FORESTS = 256, 512, 2
HELD = 50_000  # rows that a task holds, and pairs that it looks at, at a time
PAIRS = 1_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of a text's runs of ``width`` words; a shorter text is one run."""
    import xxhash

    words = data.lower().split()  # as in ``simhash.fingerprint``
    n = max(1, len(words) - width + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), dtype=np.uint64, count=n))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` bits as four numbers: each bit as over half of the set's hashes have it, mixed four ways."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        own = hashes[at : at + 4096]
        mixed = np.empty((len(own), 4), dtype="<u8")
        for k, m in enumerate(_MIX):
            x = (own ^ (own >> np.uint64(29))) * m
            mixed[:, k] = x ^ (x >> np.uint64(32))
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls on each of four to eight bits for each hash, a power of two in all.
    The sketches of two sets differ in no more bits than the sets in hashes; folding them to a smaller size keeps that."""
    size = max(64, 1 << (4 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def sketches_apart(sketches: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of each pair differ, at the smaller one's size."""
    words = np.array([len(s) for s in sketches], dtype=np.int64)
    least, apart = np.minimum(words[i], words[j]), np.zeros(len(i), dtype=np.int64)
    for size in np.unique(least).tolist():
        own = np.flatnonzero(least == size)
        named, codes = np.unique(np.concatenate((i[own], j[own])), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(sketches[k].reshape(-1, size), axis=0) for k in named.tolist()])
        a, b, step = codes[: len(own)], codes[len(own) :], max(1, PAIRS // size)
        for at in range(0, len(own), step):
            part = slice(at, at + step)
            apart[own[part]] = np.bitwise_count(folded[a[part]] ^ folded[b[part]]).sum(axis=1)
    return apart


def plan_tables(n: int, percent: int) -> tuple[int, int, int]:
    """(prefix, tables, radius) for ``n`` fingerprints."""
    j = percent / 100
    part = math.acos(2 * j / (1 + j)) / math.pi  # of the bits that sets of equal size and similarity j differ in
    prefix = max(6, math.ceil(math.log2(max(n, 2))) - 4)
    tables = math.ceil(math.log(100) / (1 - part) ** prefix)
    spread = math.sqrt(BITS * part * (1 - part))
    return min(prefix, 48), tables, math.ceil(BITS * part + 4 * spread)


def _dealt(table: int) -> np.ndarray:
    return np.random.default_rng(table + 1).permutation(BITS)[:64]


def segments(rank: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in sorted Gray ranks, as begins and ends: whatever shares its first ``prefix`` bits, however much that is."""
    cuts = np.flatnonzero((rank[1:] ^ rank[:-1]) >> np.uint64(64 - prefix)) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rank)]))


def reported(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of pairs of rows of ``fps``: ``FORESTS`` spanning forests (i, j), nearest pairs first, and for each tree that has
    more pairs the rows that these are made of."""
    apart = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1)
    order = np.argsort(apart, kind="stable")
    a, b, apart = a[order], b[order], apart[order]
    names, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = codes[: len(a)], codes[len(a) :]
    left, right, trees = [], [], None
    for _ in range(FORESTS):
        forest = Forest(len(names))
        for level in np.unique(apart):
            same = np.flatnonzero(apart == level)
            forest.add(i[same], j[same])
        trees = forest.label if trees is None else trees
        if not forest.links:
            break
        u, v = np.array(forest.links).T
        left.append(names[u])
        right.append(names[v])
        rest = ~np.isin(i * len(names) + j, u * len(names) + v)
        i, j, apart = i[rest], j[rest], apart[rest]
    ends = np.unique(np.concatenate((i, j)))
    ends = ends[np.argsort(trees[ends], kind="stable")]
    crowds = np.split(names[ends], np.flatnonzero(np.diff(trees[ends])) + 1) if len(ends) else []
    return np.concatenate(left), np.concatenate(right), crowds


def node_links(fps: np.ndarray, spans: list[tuple[int, int]], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """What ``reported`` gives for the pairs of rows of ``fps`` (n x 4) within ``radius`` in the same span."""
    spans, at = sorted(spans), 0
    while at < len(spans):
        # spans of up to PAIRS pairs together
        end, total = at, 0
        while end < len(spans) and (total == 0 or total + (spans[end][1] - spans[end][0]) ** 2 <= PAIRS):
            total += (spans[end][1] - spans[end][0]) ** 2
            end += 1
        left, right = [], []
        small = np.array([s for s in spans[at:end] if s[1] - s[0] <= 64], dtype=np.int64).reshape(-1, 2)
        for a, b in spans[at:end]:
            if b - a > 64:
                for i, j in pairs_within(fps[a:b], fps[a:b], radius, (64, 8, 1)):
                    left.append((i + a)[i < j])
                    right.append((j + a)[i < j])
        at = end
        sizes = small[:, 1] - small[:, 0]
        i = np.repeat(small[:, 0], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        stop = np.repeat(small[:, 1], sizes)
        for step in range(1, 64):
            inside = i + step < stop
            i, stop = i[inside], stop[inside]
            if not len(i):
                break
            x, apart = i, np.zeros(len(i), dtype=np.int64)
            for k in range(fps.shape[1]):  # differences accumulate word by word
                apart = apart + np.bitwise_count(fps[x, k] ^ fps[x + step, k])
                near = apart <= radius
                x, apart = x[near], apart[near]
            left.append(x)
            right.append(x + step)
        if sum(map(len, left)):
            yield reported(fps, np.concatenate(left), np.concatenate(right))


def block_links(one: np.ndarray, other: np.ndarray | None, radius: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]]:
    """The same for two blocks of a node, or one with itself (``other`` None), and the rows that the numbers mean."""
    both = one if other is None else np.concatenate((one, other))
    left, right = [], []
    for i, j in pairs_within(one, one if other is None else other, radius, (64, 8, 1)):
        upper = i < j if other is None else np.ones(len(i), dtype=bool)
        left.append(i[upper])
        right.append(j[upper] + (0 if other is None else len(one)))
    return both, [reported(both, np.concatenate(left), np.concatenate(right))] if sum(map(len, left)) else []


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints of a binary column (n x bytes), without a Python object for each."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = BITS // 8
    return np.frombuffer(whole.buffers()[2], np.uint8)[np.frombuffer(whole.buffers()[1], np.int32)[whole.offset] :][: len(whole) * size].reshape(-1, size) if len(whole) else np.zeros((0, size), np.uint8)


def _packed(fps: np.ndarray) -> pa.Array:
    offsets = np.arange(len(fps) + 1, dtype=np.int32) * (BITS // 8)
    return pa.Array.from_buffers(pa.binary(), len(fps), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(fps))])


def _words(members: bytes) -> np.ndarray:
    return np.frombuffer(members, "<u8").reshape(-1, BITS // 64)


_FOUND = "tbl int, value long, block long, members binary, a binary, b binary"


def _found(fps: np.ndarray, links: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Links and crowds as rows of ``_FOUND``."""
    for i, j, crowds in links:
        yield _rows(len(i), a=_packed(fps[i]), b=_packed(fps[j]))
        if crowds:  # in one order, so that the same crowd of another table is equal
            yield _rows(len(crowds), members=pa.array([fps[c][np.lexsort(fps[c].T)].tobytes() for c in crowds], pa.binary()))


def _rows(n: int, **given: pa.Array) -> pa.RecordBatch:
    kinds = {"tbl": pa.int32(), "value": pa.int64(), "block": pa.int64(), "members": pa.binary(), "a": pa.binary(), "b": pa.binary()}
    return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(n, t)) for k, t in kinds.items()], list(kinds))


def candidates(fps: DataFrame, n: int, percent: int, node: int = NODE, hold: int = HELD) -> tuple[DataFrame, DataFrame]:
    """What the index reports of the distinct ``fps.fp`` (``BITS`` / 8 bytes each): pairs (a, b), and crowds (members:
    fingerprints one after another). Every two fingerprints within the radius that share a node of any table are a
    pair or in one crowd."""
    prefix, tables, radius = plan_tables(n, percent)
    shift = np.uint64(64 - prefix)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [_dealt(t) for t in range(tables)]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                column = batch.column(0).slice(at, 2000)
                bits = np.unpackbits(_unpacked(column), axis=1, bitorder="little")
                for t, order in enumerate(orders):
                    codes = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").ravel().astype(np.uint64)
                    rank = gray_rank(codes) ^ np.uint64(1 << 63)  # so that signed numbers sort as unsigned ones
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), t, np.int32)), pa.array(rank.view(np.int64)), column], ["tbl", "gray", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size, edge = 0, None  # edge: a node that has rows elsewhere, maybe

        def opened(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Tables and nodes of rows, begins and ends of the runs that share both."""
            tbl = rows.column("tbl").to_numpy()
            rank = rows.column("gray").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            ends = np.flatnonzero(np.diff(tbl)) + 1
            runs = [(a, *segments(rank[a:b], prefix)) for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(tbl)], strict=True)]
            return tbl, (rank >> shift).astype(np.int64), np.concatenate([x + a for a, x, _ in runs]), np.concatenate([y + a for a, _, y in runs])

        def done(rows: pa.Table, ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            tbl, value, begins, ends = opened(rows)
            fps = np.ascontiguousarray(_unpacked(rows.column("fp"))).view("<u8")
            apart = ends - begins > node
            apart[0] |= (tbl[0], value[0]) == edge
            apart[-1] |= ended
            # nodes that are large, or go on in another task, are left to the join of their blocks
            for a, b in zip(begins[apart].tolist(), ends[apart].tolist(), strict=True):
                parts = [fps[k : min(b, k + node)].tobytes() for k in range(a, b, node)]
                m = len(parts)
                yield _rows(m, tbl=pa.array(np.full(m, tbl[a], np.int32)), value=pa.array(np.full(m, value[a])), block=pa.array(np.arange(m) + task + serial), members=pa.array(parts, pa.binary()))
                serial += m
            whole = ~apart & (ends - begins > 1)
            yield from _found(fps, node_links(fps, list(zip(begins[whole].tolist(), ends[whole].tolist(), strict=True)), radius))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < hold and edge is not None:
                continue
            rows = pa.Table.from_batches(held)
            tbl, value, begins, _ = opened(rows)
            edge = edge or (tbl[0], value[0])
            if size < hold:
                continue
            # the last node may go on in the next batch; one that fills all that is held is cut into blocks
            last = int(begins[-1]) or size
            edge = (tbl[0], value[0]) if last == size else edge
            yield from done(rows.slice(0, last), False)
            held, size = rows.slice(last).to_batches(), size - last
        if size:
            yield from done(pa.Table.from_batches(held), True)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                yield from _found(*block_links(_words(x.as_py()), None if not y.is_valid else _words(y.as_py()), radius))

    dealt = fps.select("fp").mapInArrow(deal, "tbl int, gray long, fp binary")
    ordered = dealt.repartitionByRange("tbl", "gray").sortWithinPartitions("tbl", "gray", "fp")
    found = materialise(ordered.mapInArrow(compare, _FOUND), "nodes")
    blocks = found.where("block is not null").select("tbl", "value", "block", "members")
    # every two blocks of a node meet in one of its shares, which hold 16 blocks on one side
    shares = blocks.groupBy("tbl", "value").agg(F.ceil(F.count("*") / 16).cast("int").alias("shares"))
    placed = blocks.join(shares, ["tbl", "value"])
    one = placed.select("tbl", "value", F.pmod(F.xxhash64("block"), "shares").cast("int").alias("share"), F.col("block").alias("k"), F.col("members").alias("x"))
    other = placed.select("tbl", "value", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("block").alias("l"), F.col("members").alias("y"))
    between = one.join(other, ["tbl", "value", "share"]).where("k < l").select("x", "y")
    within = blocks.where(F.length("members") > BITS // 8).select(F.col("members").alias("x"), F.lit(None).cast("binary").alias("y"))
    more = materialise(within.union(between).mapInArrow(join, _FOUND), "blocks")
    pairs = found.where("a is not null").union(more.where("a is not null"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    crowds = found.where("block is null and members is not null").union(more.where("members is not null")).select("members").distinct()
    return pairs, crowds


def crowd_pairs(crowds: DataFrame, labels: DataFrame, radius: int, percent: int = 0, every: bool = True) -> DataFrame:
    """(a, b): the pairs of a crowd within ``radius`` that ``labels`` (fp, root, mixed) doesn't have under one root; a
    mixed fingerprint stands for several. Where ``labels`` has the size and sketch of a set, pairs go whose sketches rule
    out a similarity of ``percent``. Of pairs of fingerprints that aren't mixed only a spanning forest of the roots is
    given, nearest first, unless ``every``."""
    size = BITS // 8
    if "sketch" not in labels.columns:
        labels = labels.withColumns({"size": F.lit(None).cast("long"), "sketch": F.lit(None).cast("binary")})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                names, members = batch.column(0).slice(at, 100), batch.column(1).slice(at, 100).to_pylist()
                fps = np.frombuffer(b"".join(members), np.uint8).reshape(-1, size)
                of = np.repeat(np.arange(len(members)), [len(m) // size for m in members])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), _packed(fps)], ["crowd", "fp"])

    def open_pairs(own: pa.StructArray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one crowd that nothing rules out; all of them, or a forest."""
        roots = own.field("root").dictionary_encode().indices.to_numpy()
        mixed = own.field("mixed").to_numpy(zero_copy_only=False)
        sizes = own.field("size").fill_null(-1).to_numpy(zero_copy_only=False)
        marks = [np.frombuffer(m or bytes(8), "<u8") for m in own.field("sketch").to_pylist()]
        left, right, apart = [], [], []
        for i, j in pairs_within(fps, fps, radius, (64, 8, 1)):
            new = (i < j) & ((roots[i] != roots[j]) | mixed[i] | mixed[j])
            i, j = i[new], j[new]
            known = (sizes[i] >= 0) & (sizes[j] >= 0)
            good = ~known | (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
            i, j, known = i[good], j[good], known[good]
            bits = np.zeros(len(i), dtype=np.int64)
            bits[known] = sketches_apart(marks, i[known], j[known])
            # sets a and b are similar if (100 + percent) * |a ^ b| <= (100 - percent) * (|a| + |b|)
            good = ~known | ((100 + percent) * bits <= (100 - percent) * (sizes[i] + sizes[j]))
            left.append(i[good])
            right.append(j[good])
            apart.append(bits[good])
        if not sum(map(len, left)):
            return
        i, j, apart = (np.concatenate(x) for x in (left, right, apart))
        if every:
            yield i, j
            return
        loose = mixed[i] | mixed[j]
        yield i[loose], j[loose]
        forest = Forest(len(fps))
        forest.label = np.unique(roots, return_index=True)[1][np.unique(roots, return_inverse=True)[1]]
        for level in np.unique(apart[~loose]):
            same = ~loose & (apart == level)
            forest.add(i[same], j[same])
        if forest.links:
            yield tuple(np.array(forest.links).T)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, held = [], [], 0
            for members in batch.column(0):
                own = members.values
                fps = _unpacked(own.field("fp")).view("<u8")
                for i, j in open_pairs(own, fps):
                    left.append(fps[i])
                    right.append(fps[j])
                    held += len(i)
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([_packed(np.concatenate(left)), _packed(np.concatenate(right))], ["a", "b"])
                    left, right, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([_packed(np.concatenate(left)), _packed(np.concatenate(right))], ["a", "b"])

    rows = crowds.select(F.md5("members").alias("crowd"), "members").mapInArrow(opened, "crowd string, fp binary").join(labels, "fp")
    order = F.array_sort(F.collect_list(F.struct("fp", "root", "mixed", "size", "sketch"))).alias("own")
    several = rows.groupBy("crowd").agg(order, F.min("root").alias("low"), F.max("root").alias("high"), F.max("mixed").alias("mixed")).where("low <> high or mixed")
    pairs = several.select("own").mapInArrow(compare, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def whole_sets(pairs: DataFrame, distinct: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(sig, own): the shingles of each signature in ``pairs`` (x, y). ``distinct`` has the key of a text for each
    signature, ``rows`` the texts by key."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("sig")).distinct()
    keys = materialise(distinct.join(wanted, "sig").select("sig", F.col("best.key").alias("key")), "wanted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t.as_py().encode("utf-8", "surrogatepass"), width).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["sig", "own"])

    texts = rows.select("key", "text").where(key_marks(keys)(F.col("key"))).join(keys, "key").dropDuplicates(["sig"]).select("sig", "text")
    return materialise(texts.mapInArrow(whole, "sig binary, own binary"), "shingles")


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): those ``pairs`` (x, y) of signatures whose whole ``sets`` are similar by ``percent`` or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("own_x"), batch.column("own_y"), strict=True):
                a, b = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(mask), batch.column("y").filter(mask)], ["a", "b"])

    sided = pairs
    for side in ("x", "y"):
        sided = sided.join(sets.select(F.col("sig").alias(side), F.col("own").alias(f"own_{side}")), side)
    return sided.select("x", "y", "own_x", "own_y").mapInArrow(check, "a binary, b binary")


def keep_one_similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of documents that links of ``percent`` or more similarity connect,
    the one with the least doc_id (then the least key of id and text).

    Null and empty texts are equal. Of rows with equal id and text one stays. Rows without a doc_id stay where their
    group has no other row. Other columns come along, whatever their names; an empty table gives no rows.
    """
    import xxhash

    key, mine = free_name(docs, "row_key"), docs.columns
    keyed = docs.withColumn(key, row_key())
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), text_or_empty().alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, fps = [], []
            for text in batch.column(2):
                own = shingles(text.as_py().encode("utf-8", "surrogatepass"), width)
                sigs.append(xxhash.xxh3_128_digest(own.tobytes()))
                fps.append(wide_fingerprint(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), pa.array(fps, pa.binary())], ["doc_id", "key", "sig", "fp"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), "<u8") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())], ["sig", "size", "sketch"])

    slim = materialise(rows.mapInArrow(measure, "doc_id long, key string, sig binary, fp binary"), "sets")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best")
    distinct = materialise(slim.groupBy("sig", "fp").agg(best), "distinct")
    firsts = materialise(distinct.groupBy("fp").agg(F.min("sig").alias("sig"), F.count("*").alias("n")), "fingerprints")
    n, shared = firsts.agg(F.count("*"), F.count(F.when(F.col("n") > 1, 1))).first()
    found, crowds = candidates(firsts, n, percent)
    found, crowds = materialise(found, "candidates"), materialise(crowds, "crowds")

    def one_order(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    # first, fingerprints stand for one set each; other sets with the same one are checked against it
    named = firsts.select("fp", "sig")
    pairs = found.join(named.select(F.col("fp").alias("a"), F.col("sig").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("sig").alias("y")), "b").select("x", "y")
    several = firsts.where("n > 1")
    if shared:
        twins = distinct.join(several.select("fp", F.col("sig").alias("x")), "fp").select("x", F.col("sig").alias("y")).where("x <> y")
        pairs = pairs.union(twins)
    pairs = materialise(one_order(pairs), "pairs")
    sets = whole_sets(pairs, distinct, rows, width)
    stars = materialise(components(checked(pairs, sets, percent)), "stars")
    # then what the index reports between sets that this has not connected; members of crowds are in pairs, too
    members = materialise(distinct.select("fp", "sig").join(sets.mapInArrow(sketched, "sig binary, size long, sketch binary"), "sig"), "members")
    for every in (False, True):
        rooted = materialise(members.join(stars, members["sig"] == stars["node"], "left").select("fp", "sig", "size", "sketch", F.coalesce("root", "sig").alias("root")), "rooted")
        labels = rooted.select("fp", "root", F.lit(False).alias("mixed"), "size", "sketch")
        if shared:
            alone = [F.when(F.count("*") == 1, F.min(c)).alias(c) for c in ("size", "sketch")]
            labels = materialise(rooted.groupBy("fp").agg(F.min("root").alias("root"), (F.min("root") != F.max("root")).alias("mixed"), *alone), "labels")
        between = crowd_pairs(crowds, labels, plan_tables(n, percent)[2], percent, every)
        if shared:
            for side in ("a", "b"):
                between = between.union(found.join(several.select(F.col("fp").alias(side)), side, "left_semi").select("a", "b"))
            between = between.distinct()
        for side, own in (("a", "x"), ("b", "y")):
            between = between.join(rooted.select(F.col("fp").alias(side), F.col("sig").alias(own), F.col("root").alias(f"root_{own}")), side)
        rest = between.select("x", "y", "root_x", "root_y")
        if shared:
            mixed = rooted.join(labels.where("mixed").select("fp"), "fp", "left_semi")
            twins = mixed.select("fp", F.col("sig").alias("x"), F.col("root").alias("root_x")).join(mixed.select("fp", F.col("sig").alias("y"), F.col("root").alias("root_y")), "fp").where("x < y")
            rest = rest.union(twins.select("x", "y", "root_x", "root_y"))
        rest = one_order(rest.where("root_x <> root_y"))
        rest = materialise((rest.distinct() if shared else rest).join(pairs, ["x", "y"], "left_anti"), "rest")
        if rest.isEmpty():  # a forest may be of pairs that have been checked, while others are open
            continue
        links = checked(rest, sets, percent)
        stars = materialise(components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)), "stars")
        pairs = pairs.union(rest)
    grouped = distinct.join(stars, distinct["sig"] == stars["node"], "left").select(F.coalesce("root", "sig").alias("root"), "best")
    kept = grouped.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias("key")).distinct()
    # few rows go or are repeated; those that surely are neither stay where they are, and only the others are dealt out
    keys = slim.groupBy("key").agg(F.count("*").alias("n"))
    gone = materialise(keys.join(kept, "key", "left_anti").select("key"), "gone")
    touched = key_marks(gone.union(keys.where("n > 1").select("key")))(F.col(key))
    once = keyed.where(~touched)
    again = keyed.where(touched).join(gone.select(F.col("key").alias(key)), key, "left_anti").dropDuplicates([key])
    return once.unionByName(again).select(*mine)
