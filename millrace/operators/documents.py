"""Documents end to end: cover tables, heads of tables, chunks of prose and tables together, payloads, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filings as fl
from ..functions import text as tx
from . import chunking as ch

#: The fields of an index payload by kind.
TEXT_FIELDS = (
    "chunk_id", "doc_id", "ticker", "company", "form_type", "filing_date", "period_type", "period_end_date", "sector", "industry", "source_url",
    "chunk_type", "citation_key", "section", "text", "statement_type", "table_title", "row_label", "col_header", "value",
)
WHOLE_FIELDS = ("fiscal_year", "report_priority", "chunk_index", "page", "block_order")
FLAG_FIELDS = ("page_is_surrogate", "is_financial_statement", "is_cover_page")
LIST_FIELDS = ("period_signals", "periods", "units")
LINK_FIELDS = ("parent_chunk_id", "next_chunk_id", "prev_chunk_id")
NO_FIGURE = "[Figure present -- no caption or metadata available]"


def without_covers(tables: DataFrame) -> DataFrame:
    """Administrative cover tables go, and cover tables that are no statement. Unknown flags count as false."""
    cover = F.coalesce("is_cover_page", F.lit(False)) & ~F.coalesce("is_financial_statement", F.lit(False))
    return tables.where(~(cover | F.col("statement_type").eqNullSafe("cover_admin_table")))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _some(c: str) -> Column:
    return F.nullif(F.col(c).cast("string"), F.lit(""))


def _company() -> tuple[Column, Column]:
    return F.concat(_blank("company"), F.lit(" ("), _blank("ticker"), F.lit(")")), F.concat(_blank("form_type"), F.lit(" FY"), _blank("fiscal_year"))


def table_head() -> Column:
    """The line above a table's rows: company, form with year, section. Nulls are blank."""
    return F.concat_ws(" | ", *_company(), _blank("section"))


def row_context() -> Column:
    """What stands before a row of a table: company, form with year, kind, and its period and units where known."""
    quarter = F.when((F.col("period_type") == "quarterly") & _some("fiscal_quarter").isNotNull(), F.concat(F.lit("quarterly Q"), _some("fiscal_quarter")))
    ended = F.concat(F.lit("period ended "), _some("period_end_date"))
    units = F.nullif(F.array_join("units", ", "), F.lit(""))
    return F.concat_ws(" | ", *_company(), _some("statement_type"), F.coalesce(quarter, _some("period_type")), ended, units)


def figure_text(caption: Column, annotations: Column, uri: Column, width: Column, height: Column) -> Column:
    """Caption, further distinct annotations, and the address or else the size of a figure; a fixed text if it has none."""
    said = F.filter(F.array_distinct(F.concat(F.array(caption), F.coalesce(annotations, F.array().cast("array<string>")))), lambda x: F.coalesce(x, F.lit("")) != "")
    size = F.concat(F.lit("[Figure: "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("px]"))
    where = F.coalesce(F.concat(F.lit("[Figure URI: "), F.nullif(uri, F.lit("")), F.lit("]")), size)
    return F.coalesce(F.nullif(F.concat_ws(" | ", said, where), F.lit("")), F.lit(NO_FIGURE))


def document_chunks(prose: DataFrame, tables: DataFrame, meta: DataFrame, count: ch.Counter | None = None) -> DataFrame:
    """Chunks of whole documents: numbered, without repeats, linked, rows and micro-blocks under their table's first chunk.

    ``prose``: doc_id, block_order, pos, text, own_section, page, page_is_surrogate. ``tables``: described records with
    the same but text. ``meta``: one row per doc_id with company, ticker, form_type, fiscal_year, fiscal_quarter,
    period_end_date. Everything is dealt by doc_id, so order, pages, sections and numbers share that partitioning.
    """
    n = ch.partitions_for(prose)
    rows = ch.interleaved(prose, tables, partitions=n).join(meta, "doc_id")
    rows = ch.carried_sections(ch.pseudo_pages(rows, order="place"), order="place")
    shared = ["doc_id", "place", "block_order", "section", "page", "page_is_surrogate"]
    told = ch.prose_chunks(rows.where("kind = 0").select(*shared, "text"), count, shared).withColumn("kind_order", F.lit(0)).withColumn("chunk_type", F.when(tx.is_footnote(F.col("chunk_text")), "footnote").otherwise("prose"))
    emits = ch.emits_rows(F.col("is_financial_statement"), F.col("statement_type"), F.col("cell_grid"))
    kept = without_covers(rows.where("kind = 1")).select(*shared, "statement_type", table_head().alias("table_head"), "retrieval_text", "column_headers", "cell_grid", emits.alias("row_chunks"), row_context().alias("row_context"))
    cut = ch.table_chunks(kept).drop("table_head", "retrieval_text", "column_headers", "cell_grid", "row_chunks", "row_context")
    every = ch.numbered(told.unionByName(cut, allowMissingColumns=True).repartition(n, "doc_id"), ["place", "kind_order", "part"])
    first = F.first(F.when(F.col("chunk_type") == "table", F.col("chunk_id")), ignorenulls=True).over(Window.partitionBy("doc_id", "place").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    every = every.withColumn("parent_chunk_id", F.when(F.col("chunk_type").isin("row", "micro_block"), first))
    every = every.withColumn("citation_key", tx.citation_key(F.col("page"), F.col("section"), F.col("block_order"), F.col("page_is_surrogate")))
    once = ch.without_repeats(every, tx.content_hash(F.col("chunk_type"), F.col("citation_key"), F.col("chunk_text")))
    return ch.linked(once).drop("place", "kind_order", "part")


def payloads(chunks: DataFrame) -> DataFrame:
    """The 38 fields that an index keeps of a chunk. Columns that ``chunks`` lacks get a default ("" or an empty list);
    nulls of others stay, but for flags, which are false. Whole numbers that can't be read are null."""
    have = set(chunks.columns)

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit("")

    def whole(name: str) -> Column:
        return fl.safe_int(F.col(name).cast("string")) if name in have else F.lit(None).cast("long")

    fields = {n: text(n) for n in TEXT_FIELDS} | {n: whole(n) for n in WHOLE_FIELDS}
    fields |= {n: F.coalesce(F.col(n).cast("boolean"), F.lit(False)) if n in have else F.lit(False) for n in FLAG_FIELDS}
    fields |= {n: F.col(n) if n in have else F.array().cast("array<string>") for n in LIST_FIELDS}
    fields |= {n: F.col(n).cast("string") if n in have else F.lit(None).cast("string") for n in LINK_FIELDS}
    fields["fiscal_quarter"] = fl.quarter_text(F.col("fiscal_quarter")) if "fiscal_quarter" in have else F.lit(None).cast("string")
    fields["filing_date_ts"] = fl.filed_epoch(text("filing_date"))
    fields["source_class"] = fl.source_class(text("form_type"), text("period_type"), text("section"), text("text"))
    fields["table_json"] = F.to_json("table_json") if "table_json" in have else F.lit(None).cast("string")
    return chunks.select(*[c.alias(n) for n, c in fields.items()])


def context_used(context: DataFrame) -> DataFrame:
    """What an answer says of its context."""
    names = {"ticker": "ticker", "form_type": "form", "fiscal_year": "fy", "page": "page", "section": "section", "chunk_type": "type"}
    return context.select(*[F.col(old).alias(new) for old, new in names.items()])


def with_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Each test case with its result by query_id; a case without one counts as failed. The case's own fields win."""
    ours = [c for c in results.columns if c not in cases.columns]
    met = cases.join(results.select("query_id", *ours, F.lit(True).alias("_ran")), "query_id", "left")
    if "answer" in ours:
        met = met.withColumn("answer", F.when(F.col("_ran"), F.col("answer")).otherwise("Error"))
    return met.withColumn("failed", F.col("_ran").isNull()).drop("_ran")
