"""Chunks: prose cut by sentences under a token budget, tables by rows, cells and groups of rows; order and links."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TOKENS, OVERLAP_TOKENS, TABLE_TOKENS, ROWS_IN_GROUP, LEAST_CHARS = 512, 64, 400, 30, 50
MICRO_LEAST, MICRO_MOST = 6, 8
FLUSH = 1 << 22
#: Pages that a form is taken to have, and tables whose rows become chunks.
FORM_PAGES = (("10-K", 80), ("10-Q", 40), ("8-K", 10), ("DEF14A", 60))
NOTE_TYPES = ("segment_table", "eps_table", "debt_table", "compensation_table")
DASHES = ("-", "—", "–", "N/A", "n/a", "NM", "nm")

Counter = Callable[[str], int]


def estimate(text: str) -> int:
    """Tokens of a text without a tokeniser."""
    return int(len(text) / 4.5)


def _greedy(parts: list[str], fits: Callable[[list[str]], bool], join: str = " ") -> list[str]:
    """Parts joined as long as the group fits."""
    groups: list[list[str]] = []
    for part in parts:
        if groups and fits([*groups[-1], part]):
            groups[-1].append(part)
        else:
            groups.append([part])
    return [join.join(g) for g in groups]


def by_words(text: str, most: int, count: Counter = estimate) -> list[str]:
    """Words packed under ``most`` tokens; a longer word is cut into slices."""
    out: list[str] = []
    run: list[str] = []
    size = max(1, int(most * 4.5))
    for word in [*text.split(), None]:
        if word is None or count(word) > most:
            out += _greedy(run, lambda g: count(" ".join(g)) <= most)
            run = []
            out += [word[i : i + size] for i in range(0, len(word), size)] if word else []
        else:
            run.append(word)
    return out


def by_clauses(text: str, most: int, count: Counter = estimate) -> list[str]:
    """An oversized sentence at its semicolons, else colons, else lines; what is still too long by words."""
    for cut in (r"(?<=;)\s+", r"(?<=:)\s+", r"\n+"):
        parts = [p.strip() for p in re.split(cut, text) if p.strip()]
        if len(parts) > 1:
            joined = _greedy(parts, lambda g: sum(map(count, g)) <= most)
            return [x for p in joined for x in (by_words(p, most, count) if count(p) > most else [p])]
    return by_words(text, most, count)


def split_prose(text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, count: Counter = estimate) -> list[str]:
    """Sentences packed under ``most`` tokens. A chunk repeats the end of the one before: its last sentence, and
    further ones up to one and a half times ``overlap`` tokens, less what would not fit. Chunks under 50 characters go."""
    size = lambda sentences: count(" ".join(sentences))
    sentences = [x for s in re.split(r"(?<=[.!?])\s+", text.strip()) for x in (by_clauses(s, most, count) if count(s) > most else [s])]
    chunks: list[str] = []
    current: list[str] = []
    for sentence in sentences:
        if current and size([*current, sentence]) > most:
            chunks.append(" ".join(current))
            keep, total = 0, 0
            while keep < len(current) and (total == 0 or total + count(current[-1 - keep]) <= int(overlap * 1.5)):
                total += count(current[-1 - keep])
                keep += 1
            current = current[len(current) - keep :]
            while current and size([*current, sentence]) > most:
                del current[0]
        current.append(sentence)
    chunks += [" ".join(current)] if current else []
    return [c for c in chunks if len(c) >= LEAST_CHARS]


def row_groups(lines: list[str], header: str, title: str, most: int = TABLE_TOKENS, count: Counter = estimate) -> list[list[str]]:
    """Table lines in groups of 30 at most, each within ``most`` tokens with the lines that head it."""
    overhead = count(f"{title}\n{header}\n" if header else f"{title}\n")
    groups: list[list[str]] = []
    total = 0
    for line in lines:
        own = count(line) + 1
        if not groups or total + own > most or len(groups[-1]) >= ROWS_IN_GROUP:
            groups.append([])
            total = overhead
        groups[-1].append(line)
        total += own
    return groups


def micro_blocks(cells: list[tuple[str, str, str]]) -> list[list[tuple[str, str, str]]]:
    """Cells of two to eight neighbouring row labels. A blank label or one with a colon begins a block once two are
    collected; tables with under six labels have none."""
    labels = [x[0] for i, x in enumerate(cells) if not i or cells[i - 1][0] != x[0]]
    if len(labels) < MICRO_LEAST:
        return []
    by_label: dict[str, list] = {}
    for cell in cells:
        by_label.setdefault(cell[0], []).append(cell)
    blocks: list[list[str]] = [[]]
    for label in labels:
        opens = not label or label.rstrip().endswith(":")
        if len(blocks[-1]) >= MICRO_MOST or opens and len(blocks[-1]) >= 2:
            blocks.append([])
        blocks[-1].append(label)
    found = [[c for label in b for c in by_label[label]] for i, b in enumerate(blocks) if len(b) >= 2 or i + 1 < len(blocks)]
    return [b for b in found if len(b) >= 2]


def prose_chunks(blocks: DataFrame, count: Counter | None = None, keep: list[str] | None = None) -> DataFrame:
    """``blocks`` with ``part`` and ``chunk_text``: whole if within the budget, else split. Texts under 50 characters
    give none. ``count`` replaces the token estimate. Of the columns those in ``keep`` stay, all by default; as each chunk
    repeats them, long texts are better left out. Workers give ``FLUSH`` characters at a time."""
    own = count or estimate
    kept = blocks.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, chunks, size = [], [], [], 0

            def made() -> pa.RecordBatch:
                columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in kept]  # noqa: B023
                return pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.int32()), pa.array(chunks, pa.string())], [*kept, "part", "chunk_text"])  # noqa: B023

            for i, text in enumerate(batch.column("text")):
                t = (text.as_py() or "").strip()
                for part, chunk in enumerate([] if len(t) < LEAST_CHARS else [t] if own(t) <= MAX_TOKENS else split_prose(t, count=own)):
                    rows.append(i)
                    parts.append(part)
                    chunks.append(chunk)
                    size += len(chunk) + (len(t) if "text" in kept else 0)
                    if size > FLUSH:
                        yield made()
                        rows, parts, chunks, size = [], [], [], 0
            if rows:
                yield made()

    schema = blocks.select(*kept).schema.add("part", T.IntegerType()).add("chunk_text", T.StringType())
    return blocks.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def is_numeric_cell(value: Column) -> Column:
    own = F.trim(F.coalesce(value, F.lit("")))
    return own.isin(*DASHES) | (own.rlike(r"\d") & (F.regexp_count(own, F.lit("[A-Za-z]")) <= 12))


def emits_rows(financial: Column, kind: Column, cells: Column, least: float = 0.4) -> Column:
    """Whether a table's rows become chunks: statements, notes, and tables of mostly numbers."""
    numeric = F.size(F.filter(cells, lambda c: is_numeric_cell(c["value"])))
    return F.coalesce(financial, F.lit(False)) | kind.isin(*NOTE_TYPES) | F.coalesce(numeric / F.nullif(F.size(cells), F.lit(0)) >= least, F.lit(False))


TABLE_CHUNK = "kind_order int, part int, chunk_type string, chunk_text string, row_label string, col_header string, value string"


def table_chunks(tables: DataFrame) -> DataFrame:
    """Chunks of described tables (table_head, retrieval_text, column_headers, cell_grid, row_chunks, row_context):
    groups of rows under the repeated header, a chunk for each distinct cell, and micro-blocks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables.schema.fields) + ", " + TABLE_CHUNK

    names = tables.columns

    def chunks(row: dict) -> Iterator[tuple]:
        head, lines = row["table_head"] or "", (row["retrieval_text"] or "").split("\n")
        has_header = any(row["column_headers"])
        header, data = (lines[0], lines[1:]) if has_header else ("", lines)
        for i, group in enumerate(row_groups(data, header, head)):
            text = "\n".join(x for x in [head, header, *group] if x)
            if len(text) >= LEAST_CHARS:
                yield 0, i, "table", text, None, None, None
        cells = [(c["row_label"] or "", c["col_header"] or "", c["value"] or "") for c in row["cell_grid"]]
        if row["row_chunks"]:
            for i, (label, column, value) in enumerate(dict.fromkeys(cells)):
                named = " | ".join(x for x in (row["row_context"] or "", label, f"{column}: {value}" if column else value) if x)
                yield 1, i, "row", named, label, column, value
            seen = set()
            for block in micro_blocks(cells):
                told = [f"{label} | {column}: {value}" if column else label for label, column, value in dict.fromkeys(block)]
                text = "\n".join(x for x in (head, header, *told) if x)
                if len(text) < LEAST_CHARS:
                    continue
                key = " ".join(text.lower().split())
                if key not in seen:
                    yield 2, len(seen), "micro_block", text, None, None, None
                    seen.add(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [[r[n] for n in names] + list(c) for r in frame.to_dict("records") for c in chunks(r)]
            yield pd.DataFrame(rows, columns=names + ["kind_order", "part", "chunk_type", "chunk_text", "row_label", "col_header", "value"])

    return tables.mapInPandas(run, schema)


def pages_for(form: Column) -> Column:
    found = F.lit(30)
    for prefix, pages in FORM_PAGES:
        found = F.when(F.upper(form).startswith(prefix), pages).otherwise(found)
    return found


def pseudo_pages(items: DataFrame, doc: str = "doc_id", order: str = "block_order", form: str = "form_type", surrogate: str = "page_is_surrogate") -> DataFrame:
    """Pages by place, for documents whose blocks all lack real ones: three blocks to a page, or as many as spread
    the document over the pages of its form."""
    whole, ordered = Window.partitionBy(doc), Window.partitionBy(doc).orderBy(order)
    per_page = F.greatest(F.lit(3), F.floor(F.count("*").over(whole) / pages_for(F.col(form))))
    pages = (1 + F.floor((F.row_number().over(ordered) - 1) / per_page)).cast("int")
    return items.withColumn("page", F.when(F.min(surrogate).over(whole), pages).otherwise(F.col("page")))


def carried_sections(items: DataFrame, section: str = "own_section", doc: str = "doc_id", order: str = "block_order", default: str = "General") -> DataFrame:
    """``section``: a block's own, else the last one before it in its document."""
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.coalesce(F.trim(F.col(section)), F.lit("")).isin("", default), None).otherwise(F.col(section))
    return items.withColumn("section", F.coalesce(F.last(own, ignorenulls=True).over(upto), F.lit(default)))


def partitions_for(rows: DataFrame, size: int = 8 << 20) -> int:
    """Partitions for ``rows``, the session's number at least: Spark's estimate of their bytes in parts of ``size``. What
    a task sorts then doesn't grow with the table, as it does where partitions are merged up to one for each core."""
    whole = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(-(-whole // size), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000)


def interleaved(prose: DataFrame, tables: DataFrame, doc: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Both in reading order, ``place`` from 0: by block_order, prose first on ties, those without at the end. With
    ``partitions`` dealt by ``doc`` to as many."""
    both = prose.withColumn("kind", F.lit(0)).unionByName(tables.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(partitions, doc) if partitions else both
    order = Window.partitionBy(doc).orderBy(F.col("block_order").asc_nulls_last(), "kind", "pos")
    return both.withColumn("place", F.row_number().over(order) - 1)


def numbered(chunks: DataFrame, order: list[str], doc: str = "doc_id") -> DataFrame:
    """chunk_index from 0 in each document, and chunk_id."""
    index = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    rows = chunks.withColumn("chunk_index", index)
    return rows.withColumn("chunk_id", F.concat(F.col(doc).cast("string"), F.lit("_chunk_"), F.lpad(F.col("chunk_index").cast("string"), F.greatest(F.lit(4), F.length(F.col("chunk_index").cast("string"))), F.lit("0"))))


def without_repeats(chunks: DataFrame, content: Column, doc: str = "doc_id") -> DataFrame:
    """The first chunk of equal ``content`` in each document; indexes of the others are not used again."""
    first = Window.partitionBy(doc, "content_key").orderBy("chunk_index")
    return chunks.withColumn("content_key", content).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "content_key")


def linked(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """prev_chunk_id and next_chunk_id along each document, rows and micro-blocks left out."""
    apart = F.col("chunk_type").isin("row", "micro_block")
    order = Window.partitionBy(doc, apart).orderBy("chunk_index")
    return chunks.withColumn("prev_chunk_id", F.when(~apart, F.lag("chunk_id").over(order))).withColumn("next_chunk_id", F.when(~apart, F.lead("chunk_id").over(order)))
