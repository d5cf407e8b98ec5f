"""Command line: ``spark-submit -m millrace`` or ``python -m millrace VERB``. Paths may be any that Spark reads."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filings as fl
from .functions import text as tx
from .operators import chunking as ch
from .operators import metrics as me
from .operators.answer import Engine
from .operators.planner import plan
from .sources import readers, sinks


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Submissions (JSON) and companies (CSV) to new rows of the manifest."""
    raw = readers.submissions(spark, a.submissions).select("cik", "sic", "sicDescription", F.col("filings.recent").alias("recent"))
    rows = fl.rows_of_recent(raw).where(fl.is_target(F.col("form"), F.col("filingDate"), a.since) & ((F.col("form") != "8-K") | fl.is_earnings_report(F.col("items"), F.col("primaryDocument"))))
    named = rows.withColumn("cik", fl.padded_cik(F.col("cik"))).join(readers.companies(spark, a.companies).withColumn("cik", fl.padded_cik(F.col("cik"))), "cik")
    plain, kind = F.replace("accessionNumber", F.lit("-"), F.lit("")), fl.period_type(F.col("form"))
    found = named.select(
        fl.filing_id(F.col("ticker"), F.col("form"), F.col("filingDate"), plain).alias("doc_id"), "ticker", "company", F.col("form").alias("form_type"), F.col("filingDate").alias("filing_date"), F.col("reportDate").alias("period_end_date"), kind.alias("period_type"),
        fl.fiscal_year(F.col("reportDate"), F.col("filingDate"), F.col("form")).alias("fiscal_year"), fl.fiscal_quarter(F.col("reportDate"), kind).alias("fiscal_quarter"), fl.report_priority(F.col("form")).alias("report_priority"), plain.alias("accession"), "cik", F.lit("pending").alias("parse_status"),
    )
    if a.tickers:
        found = found.where(F.col("ticker").isin(a.tickers))
    seen = readers.known_ids(spark, a.manifest) if a.append else found.select("doc_id").limit(0)
    sinks.unseen(found, seen, "doc_id", "filing_date").write.mode("append").json(a.manifest)


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Web pages (Parquet: page_id, html) to ordered blocks without noise."""
    blocks = readers.html_blocks(spark.read.parquet(a.source))
    blocks.where(tx.is_prose(F.col("text")) | tx.short_heading(F.col("text")).isNotNull()).write.mode(a.mode).parquet(a.out)


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    """Blocks (page_id, block_order, text) to numbered, linked chunks with sections."""
    blocks = spark.read.parquet(a.source).withColumn("own_section", tx.section_of(F.col("text"), F.lit(a.form)))
    parts = ch.prose_chunks(ch.carried_sections(blocks, doc="page_id")).withColumn("chunk_type", F.when(tx.is_footnote(F.col("text")), "footnote").otherwise("prose"))
    kept = ch.without_repeats(ch.numbered(parts, ["block_order", "part"], "page_id"), tx.content_hash(F.col("chunk_type"), F.col("section"), F.col("chunk_text")), "page_id")
    ch.linked(kept, "page_id").write.mode(a.mode).parquet(a.out)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks to the next version of an index, replacing those with the same id."""
    new = spark.read.parquet(a.source).withColumn("point_id", fl.point_id(F.col("chunk_id").cast("string")))
    old = sinks.latest_version(spark, a.out) if a.version > 1 else new.limit(0)
    sinks.write_version(sinks.upserted(old, new, ["point_id"]), a.out, a.version)


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    """A question's plan, or its answer over chunks with vectors."""
    if a.plan_only:
        print(json.dumps(plan(spark, a.q), default=str))
        return
    chunks: DataFrame = spark.read.parquet(a.chunks)
    size = chunks.select(F.max(F.size("embedding"))).first()[0]
    answer = Engine(spark, chunks, embed=lambda q: [float(ord(q[i % len(q)]) % 7 - 3) for i in range(size)]).ask(a.q)
    print(json.dumps(answer, default=str) if a.json else f"{answer['answer']}\n{len(answer['citations'])} citations, {answer['context_count']} sources")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Metrics of results (JSON Lines: query_id, bucket, found, gold), overall and by bucket."""
    rows, _ = readers.json_lines(spark, a.results, "query_id string, bucket string, found array<int>, gold array<int>")
    rows = me.first_of_bucket(rows, 5, "bucket", "query_id") if a.quick else rows
    names = [f"{m}_{k}" for m in ("recall", "precision", "f1", "ndcg") for k in (5, 10, 20)] + ["mrr"]
    me.means(me.retrieval_metrics(rows, compat=a.compat), names).write.mode("overwrite").json(a.out)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="millrace")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(f, *required: str, **optional) -> argparse.ArgumentParser:
        p = verbs.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        for name in required:
            p.add_argument(f"--{name}", required=True)
        for name, default in optional.items():
            p.add_argument(f"--{name.replace('_', '-')}", **({"action": "store_true"} if default is False else {"default": default, "type": type(default)} if default is not None else {"nargs": "*"}))
        return p

    verb(ingest, "submissions", "companies", "manifest", since="2019-01-01", tickers=None, append=False)
    verb(parse, "source", "out", mode="errorifexists")
    verb(chunk, "source", "out", form="10-K", mode="errorifexists")
    verb(index, "source", "out", version=1)
    verb(query, "q", chunks="", plan_only=False, json=False)
    verb(evaluate, "results", "out", quick=False, compat=False)
    a = top.parse_args(argv)
    a.run(SparkSession.builder.appName(f"millrace {a.verb}").getOrCreate(), a)


if __name__ == "__main__":
    main()
