"""Scans: companies, manifests, submissions, chunks, and HTML as ordered blocks. Schemas are declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPANY = "ticker string, company string, cik string"
MANIFEST = (
    "doc_id string, ticker string, company string, form_type string, filing_date string, period_end_date string, period_type string, fiscal_year int, fiscal_quarter int, report_priority int, "
    "sector string, industry string, accession string, cik string, source_url string, raw_path string, file_ext string, is_exhibit boolean, exhibit_type string, parse_status string, index_status string, "
    "chunk_status string, indexed_points int"
)
RECENT = "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,primaryDocument:array<string>,reportDate:array<string>,items:array<string>>"
SUBMISSIONS = f"cik string, sic string, sicDescription string, filings struct<recent:{RECENT},files:array<struct<name:string>>>"


def companies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPANY).option("header", True).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Readable rows and unreadable lines of a JSON Lines file; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    return parsed.where(~bad).select("row.*").drop("_corrupt"), parsed.where(bad).select("value")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, MANIFEST)[0]


def known_ids(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, "doc_id string")[0].select("doc_id").distinct()


def submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path)


def archive_pages(spark: SparkSession, path: str) -> DataFrame:
    """(cik, recent) of older submissions, which lie in files named CIK<number>-submissions-<page>.json."""
    rows = spark.read.schema(RECENT[len("struct<") : -1].replace(":array", " array")).option("multiLine", True).json(path)
    fields = F.struct(*[F.col(c) for c in rows.columns]).alias("recent")
    return rows.select(F.regexp_extract(F.input_file_name(), r"CIK(\d+)", 1).alias("cik"), fields)


def with_archives(current: DataFrame, archives: DataFrame) -> DataFrame:
    """Filings of current and archive pages (cik, accessionNumber, position, ...), each accession once: the current page
    comes first, then the lower position."""
    both = current.withColumn("_page", F.lit(0)).unionByName(archives.withColumn("_page", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy("cik", "accessionNumber").orderBy("_page", "position")
    return both.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_page")


def blobs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw files with their SHA-256, for parsers (plug-ins over ``mapInPandas``) to take."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def excel_tables(files: DataFrame) -> DataFrame:
    """(path, sheet, grid) of the visible sheets of .xlsx ``files`` (path, content); blank rows go. Needs openpyxl."""
    import io
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import openpyxl

        for frame in batches:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                book = openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True)
                for sheet in book.worksheets:
                    if sheet.sheet_state == "visible":
                        rows = [["" if v is None else str(v).strip() for v in r] for r in sheet.iter_rows(values_only=True)]
                        out.append((path, sheet.title, [r for r in rows if any(r)]))
            yield pd.DataFrame(out, columns=["path", "sheet", "grid"])

    return files.where(F.lower("path").endswith(".xlsx")).select("path", "content").mapInPandas(run, "path string, sheet string, grid array<array<string>>")


def unescaped(text: Column) -> Column:
    """The five named entities of XML and the no-break space."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


BLOCK = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=</?(?:h[1-6]|p|li|ul|ol|div|article|footer|nav|body|table)\b)"


def html_blocks(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, block_order, tag, text): headings, paragraphs and list items in order, with blank ones left out."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    tags, texts = (F.regexp_extract_all("body", F.lit(BLOCK), F.lit(k)) for k in (1, 2))
    rows = pages.select(id_col, body.alias("body")).select(id_col, F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("text"))).alias("pos", "b"))
    clean = F.trim(F.regexp_replace(unescaped(F.regexp_replace("b.text", "<[^>]*>", "")), r"\s+", " "))
    kept = rows.select(id_col, "pos", F.lower("b.tag").alias("tag"), clean.alias("text")).where("text <> ''")
    return kept.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("pos")) - 1).alias("block_order"), "tag", "text")


def page_range(pages: Column) -> Column:
    """First, last and all distinct pages of an item; page 1 if it has none."""
    own = F.array_sort(F.array_distinct(F.filter(F.coalesce(pages, F.array().cast("array<int>")), lambda p: p.isNotNull())))
    own = F.when(F.size(own) == 0, F.array(F.lit(1))).otherwise(own)
    return F.struct(F.array_min(own).alias("page_start"), F.array_max(own).alias("page_end"), own.alias("pages"))
