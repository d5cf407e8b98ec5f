"""Queries: text filters, sections, pages, chunks, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ch
from ..operators import tables as tb
from ..operators.planner import alias_matches
from ..sources.readers import html_blocks as blocks_of
from .registry import query
from .tables import FORM_SQL, LINES_SQL, filings, lines, read

#: Lines of filings that test documents lack, by a number from 0.
SAMPLES = (
    "(1,234.5)", "Form 10-K | 12", "chart_1.png", "(Zip Code)", "March 31,", "Fair Value", "See accompanying Notes to the statements", "(1) Includes amounts due after one year", "Item 1A. Risk Factors",
    "Item 7. Management's discussion and analysis", "Note 4 - Revenue", "PART II", "Item 2.02 Results of Operations", "us-gaap:Revenue http://x.example 0000320193 2024-09-28", "liquidity and capital resources", "CONSOLIDATED BALANCE SHEETS (Unaudited)",
)
SAMPLE_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SAMPLES) + "]"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, every third of them one of ``SAMPLES``."""
    rows = lines(spark, sf_dir)
    sample = F.element_at(F.array(*map(F.lit, SAMPLES)), ((F.col("doc_id") + F.col("block_order")) % len(SAMPLES) + 1).cast("int"))
    form = F.element_at(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (F.col("doc_id") % 3 + 1).cast("int"))
    return rows.withColumn("text", F.when(F.col("block_order") % 3 == 2, sample).otherwise(F.col("text"))).withColumn("form", form)


MIXED_SQL = f"""l AS ({LINES_SQL}), x AS (SELECT doc_id, source, block_order, CASE WHEN block_order % 3 = 2 THEN ({SAMPLE_SQL})[(doc_id + block_order) % {len(SAMPLES)} + 1] ELSE text END AS text, (['10-K', '10-Q', '8-K'])[doc_id % 3 + 1] AS form FROM l)"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ANY_SPILL = " OR ".join(f"regexp_matches(t, {_sql(p)})" for p in tx.SPILLS)
_MARKS = " + ".join(f"CAST(regexp_matches(t, {_sql(p)}) AS INTEGER)" for p in tx.XBRL_MARKS)
_NOISE = f"((length(t) > 300 AND (length(t) - length(replace(t, 'http', ''))) / 4 > 4) OR ({_MARKS}) >= 2 OR (length(t) > 500 AND len(regexp_extract_all(t, {_sql(tx.NAMESPACE)})) > 10))"
_FOOT = " OR ".join(f"(regexp_matches(t, {_sql(p)}) AND length(t) <= {n})" for p, n in tx.FOOTNOTES)


@query(f"""WITH {MIXED_SQL}, t AS (SELECT doc_id, trim(text) AS t FROM x)
  SELECT doc_id, sum(CAST({_NOISE} AS INTEGER))::BIGINT AS noise, sum(CAST(regexp_matches(t, {_sql(tx.IMAGE_NAME)}) AS INTEGER))::BIGINT AS images, sum(CAST(regexp_matches(t, {_sql(tx.BOILERPLATE)}) AS INTEGER))::BIGINT AS boilerplate,
  sum(CAST(regexp_matches(t, {_sql(tx.COVER_FRAGMENT)}) AS INTEGER))::BIGINT AS cover, sum(CAST({_ANY_SPILL} AS INTEGER))::BIGINT AS spills, sum(CAST({_FOOT} AS INTEGER))::BIGINT AS footnotes,
  sum(CAST(length(t) >= 8 AND NOT {_NOISE} AND NOT regexp_matches(t, {_sql(tx.IMAGE_NAME)}) AND NOT regexp_matches(t, {_sql(tx.BOILERPLATE)}) AND NOT regexp_matches(t, {_sql(tx.COVER_FRAGMENT)}) AND NOT ({_ANY_SPILL}) AS INTEGER))::BIGINT AS prose FROM t GROUP BY doc_id""")
def line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a document's blocks each filter takes, and how many are prose."""
    t = F.trim("text")
    kinds = {"noise": tx.is_xbrl_noise(t), "images": tx.is_image_name(t), "boilerplate": tx.is_boilerplate(t), "cover": tx.is_cover_fragment(t), "spills": tx.is_table_spill(t), "footnotes": tx.is_footnote(t), "prose": tx.is_prose(t)}
    return mixed(spark, sf_dir).groupBy("doc_id").agg(*[F.sum(c.cast("int")).alias(n) for n, c in kinds.items()])


@query(f"WITH {MIXED_SQL} SELECT source, CAST(sum(floor(length(text) / 4.5)) AS BIGINT) AS tokens, count(*) AS n FROM x GROUP BY source")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).groupBy("source").agg(F.sum(tx.n_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


def _cascade(kind: str) -> str:
    end = "" if kind == "8-K" else r"[\.\s]"
    return "CASE " + " ".join(f"WHEN regexp_matches(h, {_sql('^item' + chr(92) + 's+' + n.replace('.', chr(92) + '.') + end)}) THEN {_sql(label)}" for n, label in tx.SECTIONS[kind]) + " END"


_PHRASES = "CASE " + " ".join(f"WHEN regexp_matches(h, {_sql(p)}) THEN {_sql(label)}" for p, label in tx.PHRASES) + " END"


@query(f"""WITH {MIXED_SQL}, t AS (SELECT form, trim(text) AS t, lower(trim(text)[1:200]) AS h FROM x),
  s AS (SELECT coalesce(CASE WHEN length(t) <= 200 OR regexp_matches(t, {_sql(tx.HEADING_ANCHOR)}) THEN CASE form WHEN '10-Q' THEN {_cascade('10-Q')} WHEN '8-K' THEN {_cascade('8-K')} ELSE {_cascade('10-K')} END END, {_PHRASES}) AS section, form FROM t)
  SELECT form, coalesce(section, 'General') AS section, count(*) AS n FROM s GROUP BY ALL""")
def section_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(spark, sf_dir).withColumn("section", F.coalesce(tx.section_of(F.col("text"), F.col("form")), F.lit("General")))
    return rows.groupBy("form", "section").agg(F.count("*").alias("n"))


@query()
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that open a section or a statement, by their heading."""
    rows = mixed(spark, sf_dir).withColumn("heading", F.coalesce(tx.statement_title(F.col("text")), tx.short_heading(F.col("text")))).where("heading is not null")
    return rows.groupBy("heading").agg(F.count("*").alias("n"))


@query(f"""WITH {MIXED_SQL}, o AS (SELECT doc_id, block_order, text, CASE WHEN block_order % 5 = 1 THEN 'S' || block_order END AS own, count(*) OVER (PARTITION BY doc_id) AS n, form FROM x)
  SELECT doc_id, block_order, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_order), 'General') AS section,
  CAST(1 + block_order // greatest(3, n // CASE form WHEN '10-K' THEN 80 WHEN '10-Q' THEN 40 ELSE 10 END) AS INTEGER) AS page FROM o""")
def sections_and_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections carried forward, and pages by place."""
    rows = mixed(spark, sf_dir).withColumn("own_section", F.when(F.col("block_order") % 5 == 1, F.concat(F.lit("S"), F.col("block_order").cast("string"))))
    rows = rows.withColumn("page", F.lit(0)).withColumn("page_is_surrogate", F.lit(True)).withColumn("form_type", F.col("form"))
    return ch.pseudo_pages(ch.carried_sections(rows)).select("doc_id", "block_order", "section", "page")


@query(f"""WITH {MIXED_SQL}, c AS (SELECT doc_id, block_order, CASE WHEN block_order % 4 = 3 THEN 'row' ELSE 'prose' END AS kind, md5((CASE WHEN block_order % 4 = 3 THEN 'row' ELSE 'prose' END) || '|p.1|' || regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS h FROM x),
  i AS (SELECT *, doc_id || '_chunk_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_order) - 1 AS VARCHAR), 4, '0') AS chunk_id, row_number() OVER (PARTITION BY doc_id, h ORDER BY block_order) AS rn FROM c),
  k AS (SELECT * FROM i WHERE rn = 1)
  SELECT chunk_id, CASE WHEN kind = 'prose' THEN lag(chunk_id) OVER w END AS prev_chunk_id, CASE WHEN kind = 'prose' THEN lead(chunk_id) OVER w END AS next_chunk_id FROM k WINDOW w AS (PARTITION BY doc_id, kind ORDER BY block_order)""")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks numbered, repeats left out (with gaps in the numbers), and linked past row chunks."""
    rows = mixed(spark, sf_dir).withColumn("chunk_type", F.when(F.col("block_order") % 4 == 3, "row").otherwise("prose"))
    kept = ch.without_repeats(ch.numbered(rows, ["block_order"]), tx.content_hash(F.col("chunk_type"), F.lit("p.1"), F.col("text")))
    return ch.linked(kept).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@query(f"WITH {MIXED_SQL} SELECT doc_id, block_order, CASE WHEN doc_id % 2 = 0 THEN replace(source, '|', '-') || ' §' || block_order ELSE 'p.' || (block_order + 1) END AS citation_key FROM x")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("doc_id", "block_order", tx.citation_key(F.col("block_order") + 1, F.col("source"), F.col("block_order"), F.col("doc_id") % 2 == 0).alias("citation_key"))


@query("""WITH a AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END AS block_order, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS kind FROM lineitem)
  SELECT l_orderkey AS doc_id, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY block_order NULLS LAST, kind, l_linenumber) - 1 AS place FROM a""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of blocks merged in reading order, those without a place at the end."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("block_order"))
    return ch.interleaved(rows.where("pos % 2 = 1"), rows.where("pos % 2 = 0")).select("doc_id", "pos", "place")


@query(r"""SELECT doc_id, CAST(len(string_split_regex(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS BIGINT) AS sentences FROM documents""")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as the prose splitter cuts them."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.split(text, r"(?<=[.!?])\s+")).cast("long").alias("sentences"))


@query()
def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents split under 512 tokens with overlap."""
    return ch.prose_chunks(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "part", tx.n_tokens(F.col("chunk_text")).alias("tokens"), F.md5("chunk_text").alias("digest"))


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(read(spark, sf_dir, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""WITH a AS (SELECT item_id AS code, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM benchmark),
  d AS (SELECT doc_id AS query_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents) SELECT query_id, code FROM d JOIN a ON contains(t, ' ' || key || ' ') WHERE key <> ''""")
def alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases (whole benchmark texts) that stand in documents, by joins on runs of words."""
    aliases = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("code"), F.col("text").alias("alias"))
    return alias_matches(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), aliases)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables by supplier group: rows by flag and status, columns by ship year, values in thousands."""
    year = F.year("l_shipdate").cast("string")
    sums = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("table_id"), F.concat("l_returnflag", F.lit(" "), "l_linestatus").alias("label"), year.alias("year")).agg(F.format_number(F.round(F.sum(F.col("l_quantity"))).cast("long"), 0).alias("value"))
    return sums


def ledger_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as cells (r, c) of grids with a header row, empty columns and repeated cells left to the operator."""
    cells = ledger(spark, sf_dir)
    labels = cells.select("table_id", "label").distinct()
    rows = labels.withColumn("r", (F.ascii("label") * 1000 + F.ascii(F.substring("label", 3, 1))).cast("int"))
    years = cells.select("table_id", "year").distinct()
    body = cells.join(rows, ["table_id", "label"]).select("table_id", "r", F.col("year").cast("int").alias("c"), F.col("value").alias("text"))
    head = years.select("table_id", F.lit(0).alias("r"), F.col("year").cast("int").alias("c"), F.concat(F.lit("Year ended "), "year").alias("text"))
    side = rows.select("table_id", "r", F.lit(0).alias("c"), F.col("label").alias("text"))
    corner = labels.select("table_id").distinct().select("table_id", F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit("Net sales by segment").alias("text"))
    every = body.unionByName(head).unionByName(side).unionByName(corner)
    return tb.grids(every.withColumn("pos", F.lit(0)))


LEDGER_SQL = "SELECT l_suppkey % 10 AS table_id, l_returnflag || ' ' || l_linestatus AS row_label, 'Year ended ' || year(l_shipdate) AS col_header, format('{:,}', CAST(round(sum(l_quantity)) AS BIGINT)) AS value FROM lineitem GROUP BY ALL"


@query(LEDGER_SQL)
def unpivot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tb.structured(ledger_grids(spark, sf_dir))
    return records.select("table_id", F.explode("cell_grid").alias("x")).select("table_id", "x.*")


@query("WITH c AS (" + LEDGER_SQL + "), t AS (SELECT table_id, count(DISTINCT row_label) AS labels, count(DISTINCT col_header) AS columns, count(*) AS cells FROM c GROUP BY table_id) SELECT table_id, 'income_statement' AS statement_type, 'annual' AS period_type, true AS is_financial_statement, false AS is_cover_page, labels, columns + 1 AS headers, columns AS periods, cells FROM t")
def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids described: kind, periods, whether statement or cover, and their sizes."""
    titled = ledger_grids(spark, sf_dir).withColumn("table_title", F.when(F.col("table_id") % 2 == 0, "CONSOLIDATED STATEMENTS OF OPERATIONS").otherwise(""))
    size = lambda c: F.size(c).cast("long")
    return tb.described(tb.structured(titled)).select("table_id", "statement_type", "period_type", "is_financial_statement", "is_cover_page", size("row_labels").alias("labels"), size("column_headers").alias("headers"), size("periods").alias("periods"), size("cell_grid").alias("cells"))


@query("WITH c AS (" + LEDGER_SQL + ") SELECT table_id, 'ACME (T1) | ' || row_label || ' | ' || col_header || ': ' || value AS chunk_text FROM c")
def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_table_chunks(spark, sf_dir).where("chunk_type = 'row'").select("table_id", "chunk_text")


@query()
def table_and_micro_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups and micro-blocks of the same tables."""
    rows = all_table_chunks(spark, sf_dir).where("chunk_type <> 'row'")
    return rows.select("table_id", "chunk_type", "part", tx.n_tokens(F.col("chunk_text")).alias("tokens"), F.md5("chunk_text").alias("digest"))


def all_table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tb.described(tb.structured(ledger_grids(spark, sf_dir).withColumn("table_title", F.lit("CONSOLIDATED STATEMENTS OF OPERATIONS"))))
    emits = ch.emits_rows(F.col("is_financial_statement"), F.col("statement_type"), F.col("cell_grid"))
    slim = records.select("table_id", F.lit("ACME (T1) | 10-K FY2024 | Item 8").alias("table_head"), "retrieval_text", "column_headers", "cell_grid", emits.alias("row_chunks"), F.lit("ACME (T1)").alias("row_context"))
    return ch.table_chunks(slim)


_RULES = [(f"(CASE WHEN regexp_matches(title, {_sql('(?i)' + t)}) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(header, {_sql('(?i)' + h)}) THEN 1 ELSE 0 END)", name) for t, h, name in tb.STATEMENTS]
TITLES = ("CONSOLIDATED STATEMENTS OF OPERATIONS", "Long-term debt", "Segment information", "Earnings per share", "", "Consolidated Balance Sheets", "Stock-based compensation", "Other comprehensive income")
HEADERS = ("Total assets", "Net sales | Basic", "Maturity date", "Title of each class", "Region", "Vested", "")


@query(f"""WITH o AS (SELECT o_orderkey, ([{', '.join(_sql(t) for t in TITLES)}])[o_orderkey % {len(TITLES)} + 1] AS title, ([{', '.join(_sql(h) for h in HEADERS)}])[o_orderkey % {len(HEADERS)} + 1] AS header FROM orders),
  s AS (SELECT *, [{', '.join(p for p, _ in _RULES)}] AS points FROM o)
  SELECT o_orderkey, CASE WHEN regexp_matches(header, {_sql(tb.COVER_ADMIN)}) THEN 'cover_admin_table' WHEN list_max(points) > 0 THEN ([{', '.join(_sql(n) for _, n in _RULES)}])[list_position(points, list_max(points))] ELSE 'other_table' END AS statement_type FROM s""")
def classify_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda x: F.element_at(F.array(*map(F.lit, x)), (F.col("o_orderkey") % len(x) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", tb.statement_type(pick(TITLES), pick(HEADERS), F.lit("")).alias("statement_type"))


@query(f"WITH f AS (SELECT o_orderkey AS chunk_id, {FORM_SQL} AS form_type, 'T' || o_custkey AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'row' ELSE 'prose' END AS chunk_type FROM orders) SELECT chunk_id, concat_ws(' | ', ticker, form_type, CASE chunk_type WHEN 'prose' THEN 'Item 1' ELSE 'eps_table' END) || chr(10) || 'body' AS embed_text FROM f")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir).select(F.col("o_orderkey").alias("chunk_id"), F.col("form").alias("form_type"), "ticker", F.when(F.col("o_orderkey") % 2 == 0, "row").otherwise("prose").alias("chunk_type"), F.lit("Item 1").alias("section"), F.lit("eps_table").alias("statement_type"), F.lit("body").alias("text"))
    return rows.select("chunk_id", tx.embed_text().alias("embed_text"))
