"""Queries: cover tables, heads of tables, chunks of whole documents, payloads, archive pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as dc
from ..operators import tables as tb
from ..sources.readers import with_archives
from .chunks import ledger_grids
from .registry import query
from .tables import FILINGS_SQL, filings, lines, read


@query("""SELECT o_orderkey AS table_id FROM orders WHERE NOT (o_orderkey % 7 = 0 OR (coalesce(CASE WHEN o_orderkey % 5 <> 4 THEN o_orderkey % 5 < 2 END, false) AND NOT coalesce(CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey % 3 = 0 END, false)))""")
def cover_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without covers; kinds and flags, null ones among them, go by the order's number."""
    key = F.col("o_orderkey")
    tables = read(spark, sf_dir, "orders").select(
        key.alias("table_id"), F.when(key % 7 == 0, "cover_admin_table").when(key % 2 == 0, "other_table").alias("statement_type"),
        F.when(key % 5 != 4, key % 5 < 2).alias("is_cover_page"), F.when(key % 3 != 2, key % 3 == 0).alias("is_financial_statement"),
    )
    return dc.without_covers(tables).select("table_id")


@query(f"""WITH f AS ({FILINGS_SQL}), x AS (SELECT *, 'Customer#' || o_custkey || ' (' || ticker || ')' AS who, form || ' FY' || filed[1:4] AS what FROM f)
  SELECT o_orderkey AS table_id, concat_ws(' | ', who, what, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Item 8' END) AS table_head,
  concat_ws(' | ', who, what, CASE WHEN o_orderkey % 2 = 0 THEN 'eps_table' END, CASE WHEN o_orderkey % 5 = 0 THEN 'quarterly' || CASE WHEN o_orderkey % 3 <> 0 THEN ' Q2' ELSE '' END ELSE 'annual' END, 'period ended ' || period_end, CASE WHEN o_orderkey % 6 = 0 THEN '$, %' END) AS row_context FROM x""")
def table_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that head tables and rows, of filings with and without section, period and units."""
    key = F.col("o_orderkey")
    rows = filings(spark, sf_dir).select(
        key.alias("table_id"), F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("company"), "ticker", F.col("form").alias("form_type"), F.substring("filed", 1, 4).cast("int").alias("fiscal_year"),
        F.when(key % 4 != 0, "Item 8").alias("section"), F.when(key % 2 == 0, "eps_table").otherwise("").alias("statement_type"), F.when(key % 5 == 0, "quarterly").otherwise("annual").alias("period_type"),
        F.when(key % 3 != 0, 2).alias("fiscal_quarter"), F.col("period_end").alias("period_end_date"), F.when(key % 6 == 0, F.array(F.lit("$"), F.lit("%"))).otherwise(F.array().cast("array<string>")).alias("units"),
    )
    return rows.select("table_id", dc.table_head().alias("table_head"), dc.row_context().alias("row_context"))


@query(f"""WITH f AS ({FILINGS_SQL}) SELECT accession AS chunk_id, ticker, form AS form_type, filed AS filing_date, CAST(epoch(CAST(filed AS TIMESTAMP)) AS BIGINT) AS filing_date_ts,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(filed[1:4] AS BIGINT) END AS fiscal_year, CASE WHEN o_orderkey % 3 = 0 THEN '3' WHEN o_orderkey % 3 = 1 THEN 'FY' END AS fiscal_quarter, o_orderkey % 5 AS page, o_orderkey % 2 = 0 AS page_is_surrogate,
  false AS is_cover_page, '' AS sector, CAST(NULL AS VARCHAR) AS parent_chunk_id, period_end AS period_end_date, CASE WHEN o_orderkey % 2 = 0 THEN '{{"ticker":"' || ticker || '"}}' END AS table_json,
  CASE WHEN contains(form, '10-K') THEN '10-K' WHEN contains(form, '10-Q') THEN '10-Q' WHEN contains(form, '8-K') THEN '8-K-earnings' WHEN contains(form, 'DEF') THEN 'proxy' ELSE upper(form) END AS source_class FROM f""")
def index_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of an index, of which fields that are computed or missing are shown."""
    key = F.col("o_orderkey")
    chunks = filings(spark, sf_dir).select(
        F.col("accession").alias("chunk_id"), "ticker", F.col("form").alias("form_type"), F.col("filed").alias("filing_date"), F.when(key % 4 == 0, "unknown").otherwise(F.substring("filed", 1, 4)).alias("fiscal_year"),
        F.when(key % 3 == 0, "q3").when(key % 3 == 1, " FY ").otherwise(" ").alias("fiscal_quarter"), (key % 5).alias("page"), F.when(key % 2 == 0, True).alias("page_is_surrogate"), F.col("period_end").alias("period_end_date"),
        F.lit("Quarterly results of the company").alias("text"), F.when(key % 2 == 0, F.struct("ticker")).alias("table_json"),
    )
    shown = "chunk_id ticker form_type filing_date filing_date_ts fiscal_year fiscal_quarter page page_is_surrogate is_cover_page sector parent_chunk_id period_end_date table_json source_class"
    return dc.payloads(chunks).select(*shown.split())


@query("""SELECT o_custkey AS cik, o_orderkey AS accession, CASE WHEN o_orderkey % 3 = 1 THEN 'archive' ELSE 'current' END AS page FROM orders""")
def archive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of current and archive pages, which share a third of the accessions, each once."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("accessionNumber"), F.col("o_orderkey").alias("position"))
    current, archives = rows.where("position % 3 <> 1").withColumn("page", F.lit("current")), rows.where("position % 3 <> 2").withColumn("page", F.lit("archive"))
    return with_archives(current, archives).select("cik", F.col("accessionNumber").alias("accession"), "page")


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, the first ten of which have a table at their end."""
    blocks = lines(spark, sf_dir).select("doc_id", "block_order", F.col("block_order").alias("pos"), "text", tx.section_of(F.col("text"), F.lit("10-K")).alias("own_section"), F.lit(0).alias("page"), F.lit(True).alias("page_is_surrogate"))
    place = {"doc_id": F.col("table_id").cast("long"), "block_order": F.lit(None).cast("int"), "pos": F.lit(0), "own_section": F.lit(None).cast("string"), "page": F.lit(0), "page_is_surrogate": F.lit(True)}
    grids = ledger_grids(spark, sf_dir).withColumn("table_title", F.lit("CONSOLIDATED STATEMENTS OF OPERATIONS"))
    tables = tb.described(tb.structured(grids)).withColumns(place)
    meta = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("company"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("ticker"), F.lit("10-K").alias("form_type"), F.lit(2024).alias("fiscal_year"), F.lit(None).cast("int").alias("fiscal_quarter"), F.lit("2024-12-31").alias("period_end_date"))
    chunks = dc.document_chunks(blocks, tables, meta)
    return chunks.select("chunk_id", "chunk_type", "section", "citation_key", "parent_chunk_id", "prev_chunk_id", "next_chunk_id", F.md5("chunk_text").alias("digest"))
