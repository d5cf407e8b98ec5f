"""Operator 1: shortest-pack-first packing over the length histogram.

Every document becomes token ids with an end id. Whole runs of ``capacity`` ids are sequences of their own; what
remains of each document is a piece shorter than that. Only lengths decide the packing: their histogram (at most
``capacity`` rows) goes to the driver, lengths are placed longest first into the emptiest open pattern that has
room, and counts of patterns are split instead of handling pieces one by one. The patterns, at most one for each
length, then meet the pieces by rank: the n-th piece of a length takes the n-th slot of that length.

Lengths that never fit together (all over half of ``capacity``, say) would leave gaps. Where these exceed
``max_padding``, the emptiest packs are dissolved and their pieces cut to fill the gaps of the others: end to end,
the pieces to cut are one line, the gaps another, and where a piece lies on its line follows from its rank alone.

Ranks need no global sort: a piece's rank within its length is its running number in the task that made it, plus
what earlier tasks have of that length. No key, however frequent, is gathered into one task.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .wordcoder import coder

#: ``tail`` holds the ids of pieces under ``capacity``, four bytes each; it is read only where pieces are cut.
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank_in_task long, tail binary"
OWN = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PLACED = [*OWN, "sequence_id", "offset", "sequence_tokens", "padded_length"]

Packs = list[tuple[int, list[int]]]


def plan_packs(histogram: dict[int, int], capacity: int) -> Packs:
    """Patterns as (count, lengths in order). Each piece goes to the emptiest open pack that has room for it, else to
    a new one. Packs that are alike move together, so each length splits one group or opens two at most."""
    open_packs: list[Packs] = [[] for _ in range(capacity + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in range(capacity, length - 1, -1):
            while left and open_packs[room]:
                count, pack = open_packs[room].pop()
                taken = min(count, left)
                left -= taken
                open_packs[room - length].append((taken, [*pack, length]))
                if count > taken:
                    open_packs[room].append((count - taken, pack))
        each = capacity // length
        for count, n in ((left // each, each), (1, left % each)):
            if count and n:
                open_packs[capacity - length * n].append((count, [length] * n))
    return [x for groups in open_packs for x in groups]


def padding(packs: Packs, capacity: int) -> float:
    """The share of padding in what the patterns make; a fill that is a power of two has none."""
    filled = sum(n * sum(x) for n, x in packs)
    held = sum(n * (s if (s := sum(x)) & (s - 1) == 0 else capacity) for n, x in packs)
    return 1 - filled / held if held else 0.0


def dissolve(packs: Packs, capacity: int, least_gap: int) -> tuple[Packs, Packs]:
    """(packs that stay, packs whose pieces are cut): as many of the emptiest as fit into the gaps of the others.
    Gaps under ``least_gap`` stay, so that no piece is cut into crumbs."""
    room = lambda n, x: n * gap if (gap := capacity - sum(x)) >= least_gap else 0
    order = sorted(packs, key=lambda p: (sum(p[1]), p[1]))
    gaps = sum(room(n, x) for n, x in order)
    kept, cut = [], []
    for n, x in order:
        each = sum(x) + room(1, x)  # what one of them asks for and no longer offers
        taken = min(n, gaps // each) if room(1, x) else 0
        gaps -= taken * each
        kept += [(n - taken, x)] if taken < n else []
        cut += [(taken, x)] if taken else []
    return kept, cut


class Plan(NamedTuple):
    """Slots by length (first rank, sequence, offset), sequences (first, fill), pieces to cut and gaps on their lines."""

    slots: dict[int, dict[str, np.ndarray]]
    first: np.ndarray
    fill: np.ndarray
    cuts: dict[int, dict[str, np.ndarray]]  # by length: first rank and place on the line of each run of ranks
    gaps: dict[str, np.ndarray]  # place on the line, sequence, width and offset of each run of gaps


def slots(packs: Packs) -> tuple[dict[int, dict[str, np.ndarray]], Counter]:
    """By length: the first rank of each slot, the sequence that this rank goes to, and the offset there; and how many
    pieces of each length the patterns take."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            found[length].append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return {k: dict(zip(("rank", "sequence", "offset"), np.array(v, dtype=np.int64).T, strict=True)) for k, v in found.items()}, used


def make_plan(histogram: dict[int, int], capacity: int, max_padding: float) -> Plan:
    packs, cut = plan_packs(histogram, capacity), []
    least_gap = max(1, capacity // 128)
    if padding(packs, capacity) > max_padding:
        packs, cut = dissolve(packs, capacity, least_gap)
    table, used = slots(packs)
    first = np.cumsum([0, *(n for n, _ in packs)])[:-1].astype(np.int64)
    fill = np.array([sum(x) for _, x in packs], dtype=np.int64)
    cuts: dict[int, list[tuple[int, int]]] = defaultdict(list)
    at = 0
    for n, x in cut:
        for length in x:
            cuts[length].append((used[length], at))
            used[length] += n
            at += n * length
    rows, at, total = [], 0, at
    for (n, _), sequence, own in zip(packs, first.tolist(), fill.tolist(), strict=True):
        gap = capacity - own
        if at < total and gap >= least_gap:
            rows.append((at, sequence, gap, own))
            at += n * gap
    gaps = dict(zip(("place", "sequence", "width", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 4).T, strict=True))
    return Plan(table, first, fill, {k: dict(zip(("rank", "place"), np.array(v, dtype=np.int64).T, strict=True)) for k, v in cuts.items()} if total else {}, gaps | {"total": np.int64(total)})


def filled(plan: Plan, sequence: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and padded length of sequences, with what their gaps took."""
    full = plan.fill[np.searchsorted(plan.first, sequence, side="right") - 1].copy()
    if len(plan.gaps["place"]):
        run = np.searchsorted(plan.gaps["sequence"], sequence, side="right") - 1
        own = np.maximum(run, 0)
        width = plan.gaps["width"][own]
        place = plan.gaps["place"][own] + (sequence - plan.gaps["sequence"][own]) * width
        mine = (run >= 0) & (capacity - full == width) & (plan.gaps["offset"][own] == full)
        full += np.where(mine, np.clip(plan.gaps["total"] - place, 0, width), 0)
    return full, np.where(full & (full - 1), capacity, full)


def cut_pieces(docs: DataFrame, encode: Callable, end_id: int, capacity: int) -> DataFrame:
    """Pieces of each row of ``docs`` (doc_id, text); ``encode`` makes (ids, bounds) of a list of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                ids, bounds = encode(part.column(1).to_pylist())
                out = []
                for doc_id, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), capacity):
                        piece = own[start : start + capacity].tobytes()
                        n = len(piece) // 4
                        out.append((doc_id, start, n, zlib.crc32(piece), len(own), task, seen[n], piece if n < capacity else None))
                        seen[n] += 1
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()], strict=True)],
                    [*OWN, "task", "rank_in_task", "tail"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int, max_padding: float = 0.01) -> DataFrame:
    """``pieces`` (a table that is read twice) with sequence_id, offset, sequence_tokens and padded_length."""
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = make_plan(histogram, capacity, max_padding)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def rows(*columns: np.ndarray | pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], PLACED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length):
                chosen, own = np.flatnonzero(length == n), plan.slots[int(n)]
                slot = np.searchsorted(own["rank"], rank[chosen], side="right") - 1
                sequence[chosen] = own["sequence"][slot] + rank[chosen] - own["rank"][slot]
                offset[chosen] = own["offset"][slot]
            yield rows(*(batch.column(n) for n in OWN), sequence, offset, *filled(plan, sequence, capacity))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        gaps = plan.gaps
        for batch in batches:
            out = []
            names = ("doc_id", "start", "length", "doc_tokens", "rank", "tail")
            for doc_id, start, length, doc_tokens, rank, tail in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                own = plan.cuts[length]
                run = int(np.searchsorted(own["rank"], rank, side="right")) - 1
                at = int(own["place"][run]) + (rank - int(own["rank"][run])) * length
                done = 0
                while done < length:
                    gap = int(np.searchsorted(gaps["place"], at, side="right")) - 1
                    width = int(gaps["width"][gap])
                    number, inside = divmod(at - int(gaps["place"][gap]), width)
                    n = min(length - done, width - inside)
                    ids = tail[4 * done : 4 * (done + n)]
                    out.append((doc_id, start + done, n, zlib.crc32(ids), doc_tokens, int(gaps["sequence"][gap]) + number, int(gaps["offset"][gap]) + inside))
                    done, at = done + n, at + n
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield rows(*columns, *filled(plan, columns[5].to_numpy(), capacity))

    schema = ", ".join(f"{n} long" for n in PLACED)
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("rank_base") + F.col("rank_in_task"))
    if not plan.cuts:
        return ranked.select(*OWN, "rank").mapInArrow(place, schema)
    from_rank = {n: int(own["rank"][0]) for n, own in plan.cuts.items()}  # later ranks of a length are cut
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in from_rank.items() for x in pair]), F.col("length").cast("int"))
    kept = ranked.where(bound.isNull() | (F.col("rank") < bound)).select(*OWN, "rank").mapInArrow(place, schema)
    donors = ranked.where(F.col("length").isin(list(from_rank)) & (F.col("rank") >= bound))
    return kept.union(donors.select(*OWN, "rank", "tail").mapInArrow(cut, schema))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 1024, max_padding: float = 0.01) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens and
    padded_length (``capacity``, or the sequence's own length where that is a power of two).

    Null or empty text: one piece that holds the end id. Rows with equal doc_id or text are packed one by one.
    A null doc_id stays null. An empty table gives no rows. Other columns of ``docs`` are ignored.
    Pieces are cut to fill gaps only where whole ones leave more than ``max_padding``.
    """
    pieces = materialise(cut_pieces(docs, lambda texts: coder(vocabulary).encode(texts), end_id, capacity), "pieces")
    return pack(pieces, capacity, max_padding)
