"""The test tables, and the relations that stand in for filings on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Forms and filing columns that orders stand for; the same as SQL.
FORMS = {"1-URGENT": "10-K", "2-HIGH": "10-Q", "3-MEDIUM": "8-K", "4-NOT SPECIFIED": "10-KT", "5-LOW": "DEF 14A"}
FORM_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMS.items()) + " ELSE 'OTHER' END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: form, filed, period_end (null for a third), ticker, accession."""
    form = F.lit("OTHER")
    for k, v in FORMS.items():
        form = F.when(F.col("o_orderpriority") == k, v).otherwise(form)
    day = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", form.alias("form"), day.cast("string").alias("filed"), F.when(F.col("o_orderkey") % 3 != 0, F.date_sub(day, 40).cast("string")).alias("period_end"),
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0").alias("accession"),
    )


FILINGS_SQL = f"""SELECT o_orderkey, o_custkey, {FORM_SQL} AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) - 40 AS VARCHAR) END AS period_end,
  'T' || o_custkey AS ticker, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS accession FROM orders"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks: one for each line, with its place."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_order", "text"))


LINES_SQL = """SELECT doc_id, source, k - 1 AS block_order, parts[k] AS text FROM (
  SELECT doc_id, source, parts, unnest(generate_series(1, len(parts))) AS k FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))"""


def hybrid_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with vectors: documents and embeddings of the same number."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")
    return docs.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), "id")
