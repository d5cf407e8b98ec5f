"""Operator 9: passages of whole lines that occur again are deleted, by winnowing over line hashes.

A line is what lies between newlines, trimmed; lines without a word don't count. From every line of a document runs
the least window of lines with ``min_words`` words or more, forwards and backwards.

1. Winnowing: of each window the line with the smallest hash (the last of equal ones) is selected. Only selected
   positions are rows. A run of lines with ``min_words`` words that stands in two places holds the same windows, hence
   selects the same lines, in both, so none is missed.
2. Positions meet on the hash of their line; those that meet no other are done with.
3. The others ask, for each window that selected them, for the earliest position (by doc_id, then row, then line)
   with the same window about it: the original. So a line that stands in thousands of documents, in many contexts, is
   compared with one position for each context, never with all.
4. Position and original are compared line by line, outwards in both directions, by 128-bit hashes. What agrees is
   a copied run, provided that it has ``min_words`` words. Each window finds its own original, so a passage is
   followed to its end even where its parts first stood in different documents.
5. Runs of a document are merged, and their lines deleted. In one document a copy that overlaps its original stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, free_name, materialise, row_key, text_or_empty

_SPACE = " \t\n\r\x0b\x0c"
#: A line near a selected one: its 128-bit hash, its number in the text, and its words.
LINE = np.dtype([("low", "<u8"), ("high", "<u8"), ("number", "<i4"), ("words", "<i4")])


def lines_of(text: str) -> np.ndarray:
    """The lines with words of a text, as ``LINE``."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    numbers, hashes, words = [], [], []
    for k, line in enumerate(text.split("\n")):
        if n := len(line.encode().split()):
            numbers.append(k)
            hashes.append(digest(line.strip(_SPACE).encode(), 9))
            words.append(n)
    out = np.empty(len(words), LINE)
    both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    out["low"], out["high"], out["number"], out["words"] = both[:, 0], both[:, 1], numbers, words
    return out


def least_windows(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(begin, end) of the least runs of lines with ``min_words`` words, forwards and backwards from each line."""
    ends = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    first = np.searchsorted(ends, ends[:-1] + min_words, side="left")  # a window from line i ends before first[i]
    last = np.searchsorted(ends, ends[1:] - min_words, side="right") - 1  # one to line j begins at last[j]
    spans = {(i, e) for i, e in enumerate(first.tolist()) if e <= len(words)} | {(b, j + 1) for j, b in enumerate(last.tolist()) if b >= 0}
    return sorted(spans)


def select(lines: np.ndarray, min_words: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Selected lines with the windows that selected them, in order of place. Begins and ends of windows both ascend,
    so the candidates for a minimum form a queue."""
    low = lines["low"].tolist()
    chosen: dict[int, list[tuple[int, int]]] = {}
    queue: list[int] = []
    head = done = 0
    for a, b in least_windows(lines["words"], min_words):
        for k in range(done, b):
            while len(queue) > head and low[queue[-1]] >= low[k]:
                queue.pop()
            queue.append(k)
        done = max(done, b)
        while queue[head] < a:
            head += 1
        chosen.setdefault(queue[head], []).append((a, b))
    return iter(chosen.items())


def positions(docs: DataFrame, key: str, min_words: int) -> DataFrame:
    """Selected positions: fingerprint, doc_id, ``key``, at (its line among those with words), lines (the ``LINE``
    rows its windows reach), before (how many of them precede it), spans (its windows among them, as pairs of ints)."""
    schema = f"fingerprint long, doc_id long, `{key}` string, at int, lines binary, before int, spans binary"
    names = ["fingerprint", "doc_id", key, "at", "lines", "before", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, own_key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lines = lines_of(text)
                low = lines["low"].view(np.int64)
                for at, windows in select(lines, min_words):
                    a, b = windows[0][0], windows[-1][1]
                    spans = np.array(windows, dtype="<i4") - np.int32(a)
                    out.append((int(low[at]), doc_id, own_key, at, lines[a:b].tobytes(), at - a, spans.tobytes()))
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, text_or_empty().alias("text"))
    return rows.mapInArrow(run, schema)


def _agree(own: np.ndarray, other: np.ndarray) -> int:
    """How many lines agree from the front."""
    n = min(len(own), len(other))
    same = (own["low"][:n] == other["low"][:n]) & (own["high"][:n] == other["high"][:n])
    return n if same.all() else int(same.argmin())


def copied_runs(docs: DataFrame, key: str, min_words: int) -> DataFrame:
    """(key, first, last): lines (as numbers in the text) of ``docs`` that are later copies, as disjoint runs."""
    import xxhash

    found = materialise(positions(docs, key, min_words), "positions")
    shared = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    met = materialise(found.join(shared, "fingerprint", "left_semi"), "met")
    drop_table(found)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, digests = [], []
            for k, (lines, spans) in enumerate(zip(batch.column("lines").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                own = np.frombuffer(lines, LINE)
                hashes = np.stack((own["low"], own["high"]), axis=1)
                for a, b in np.frombuffer(spans, "<i4").reshape(-1, 2).tolist():
                    row.append(k)
                    digests.append(xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), 9))
            taken = batch.take(pa.array(row, pa.int64()))
            # the window's number in its position
            bounds = np.flatnonzero(np.diff(np.array(row), prepend=-1))
            nth = np.arange(len(row)) - np.repeat(bounds, np.diff(np.append(bounds, len(row))))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array(nth.astype(np.int32))], [*batch.schema.names, "window", "nth"])

    names = ["fingerprint", "doc_id", key, "at", "lines", "before", "spans"]
    asked = met.select(*names).mapInArrow(windows, met.select(*names).schema.add("window", "long").add("nth", "integer"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("o_doc"), F.col(key).alias("o_key"), F.col("at").alias("o_at"), F.col("lines").alias("o_lines"), F.col("before").alias("o_before"))
    originals = asked.groupBy("fingerprint", "window").agg(F.min(place).alias("o"), F.count("*").alias("n")).where("n > 1").select("fingerprint", "window", "o.o_key", "o.o_at", "o.o_lines", "o.o_before")
    pairs = asked.join(originals, ["fingerprint", "window"]).where((F.col(key) != F.col("o_key")) | (F.col("at") > F.col("o_at")))
    # one comparison for each position and original; within one document each window goes by itself
    own_document = F.col(key) == F.col("o_key")
    pairs = pairs.select(key, "at", "lines", "before", "spans", "o_key", "o_at", "o_lines", "o_before", F.when(own_document, F.col("nth")).otherwise(-1).alias("nth"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            seen = None
            for r in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                own_key, at, lines, before, spans, o_key, o_at, o_lines, o_before, nth = (x.as_py() for x in r)
                if nth < 0 and seen == (own_key, at, o_key, o_at):
                    continue  # other windows of a position mostly have the same original
                seen = (own_key, at, o_key, o_at)
                own, other = np.frombuffer(lines, LINE), np.frombuffer(o_lines, LINE)
                left = _agree(own[: before + 1][::-1], other[: o_before + 1][::-1])
                right = _agree(own[before:], other[o_before:])
                a, b = before + 1 - left, before + right
                if nth >= 0:
                    c, d = np.frombuffer(spans, "<i4").reshape(-1, 2)[nth].tolist()
                    if c < a or d > b or d - c > at - o_at:
                        continue
                    a, b = c, d
                if left and own["words"][a:b].sum() >= min_words:
                    out.append((own_key, int(own["number"][a]), int(own["number"][b - 1])))
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)], [key, "first", "last"])

    runs = pairs.mapInArrow(extend, f"`{key}` string, first int, last int").distinct()
    ordered = Window.partitionBy(key).orderBy("first", "last")
    reach = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("fresh", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    numbered = fresh.withColumn("run", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def delete_copies(docs: DataFrame, min_words: int = 50, report: bool = False) -> DataFrame:
    """``docs`` with later copies of passages cut out of ``text``; rows whose whole text goes are kept, with "".

    With ``report``: doc_id, text, n_lines, n_deleted_lines and deleted_words instead. Texts without copies stay as
    they are, null texts null. Rows with equal doc_id and text count as one document: if it comes first in the order
    both keep their lines. A null doc_id comes after all others. Clashing column names are no matter.
    Very long texts cost in proportion to their lines. An empty table gives no rows.
    """
    key, runs, cut, lines = (free_name(docs, n) for n in ("row_key", "copied_runs", "cut_lines", "all_lines"))
    keyed = docs.withColumn(key, row_key())
    listed = copied_runs(keyed.select("doc_id", "text", key), key, min_words).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(runs))
    met = keyed.join(listed, key, "left")
    met = met.withColumn(lines, F.when(F.col(runs).isNotNull(), F.split(text_or_empty(), "\n", -1)))
    # what is kept lies between the runs, which are disjoint and in order
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    between = F.zip_with(begins, ends, lambda b, e: F.slice(F.col(lines), b + 1, e - b))
    kept = F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
    if not report:
        return met.select(*[kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    gone = F.flatten(F.transform(runs, lambda r: F.slice(F.col(lines), r["first"] + 1, r["last"] - r["first"] + 1)))
    met = met.withColumn(cut, F.transform(gone, lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))))
    return met.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        kept.alias("text"),
        F.size(F.split(text_or_empty(), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter(cut, lambda n: n > 0)), F.lit(0)).cast("long").alias("n_deleted_lines"),
        F.coalesce(F.aggregate(cut, F.lit(0), lambda n, x: n + x), F.lit(0)).cast("long").alias("deleted_words"),
    )
