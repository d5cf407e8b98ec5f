"""Choosing and rendering the context of an answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chosen(candidates: Column, max_chunks: int = 8, per_doc: int = 6, per_page: int = 3, diverse: bool = False, multi_year: bool = False) -> Column:
    """Of an array of candidates, best first, those to keep, as an array in order of choice: a greedy fold under caps on
    documents, pages, repeated row labels, company-years and evidence types. Equal texts (of one type and citation)
    come once. If under four (or ``max_chunks``) come through, a second fold without caps fills up."""
    most = max(max_chunks, 10 if diverse else 0, 8 if multi_year else 0)
    some = lambda x, f: F.coalesce(x[f].cast("string"), F.lit(""))
    count = lambda held, test: F.size(F.filter(held, lambda h: F.coalesce(test(h), F.lit(False))))
    both = lambda f, c: lambda h: h[f].eqNullSafe(c[f])
    keyed = F.transform(candidates, lambda c: F.struct(c.alias("row"), F.concat_ws("\u0001", some(c, "chunk_type"), some(c, "citation_key"), F.trim(F.regexp_replace(F.lower(some(c, "text")), r"\s+", " "))).alias("said")))

    def allowed(held: Column, c: Column) -> Column:
        doc = lambda h: h["row"]["doc_id"].eqNullSafe(c["doc_id"])
        label = lambda x: F.when(some(x, "chunk_type") == "row", some(x, "row_label")).otherwise("")
        rules = [
            count(held, doc) < per_doc,
            (F.size(held) >= most - 2) | (count(held, lambda h: some(h["row"], "chunk_type") == some(c, "chunk_type")) < max(2, most // 2)),
            c["page"].isNull() | (count(held, lambda h: doc(h) & (h["row"]["page"] == c["page"])) < per_page),
            (label(c) == "") | (count(held, lambda h: doc(h) & (label(h["row"]) == label(c))) < 1),
        ]
        if diverse:
            rules.append(count(held, lambda h: both("ticker", c)(h["row"]) & both("fiscal_year", c)(h["row"])) < 2)
        return reduce(Column.__and__, rules)

    def grow(capped: bool) -> Callable[[Column, Column], Column]:
        def step(held: Column, c: Column) -> Column:
            fits = (F.size(held) < most) & ~F.exists(held, lambda h: h["said"] == c["said"])
            return F.when(fits & allowed(held, c["row"]) if capped else fits, F.concat(held, F.array(c))).otherwise(held)

        return step

    none = F.filter(keyed, lambda c: F.lit(False))
    first = F.aggregate(keyed, none, grow(capped=True))
    filled = F.element_at(F.transform(F.array(first), lambda held: F.when(F.size(held) < min(most, 4), F.aggregate(keyed, held, grow(capped=False))).otherwise(held)), 1)
    return F.transform(filled, lambda c: c["row"])


def assemble(candidates: DataFrame, max_chunks: int = 8, per_doc: int = 6, per_page: int = 3, diverse: bool = False, multi_year: bool = False) -> DataFrame:
    """``chosen`` for each query_id of ``candidates`` (reranked lists of some dozens each), with ``place``."""
    present = [c for c in candidates.columns if c != "query_id"]
    missing = [F.lit(None).cast("string").alias(c) for c in CANDIDATE if c not in candidates.columns]
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("by_rank"), F.struct(*present, *missing).alias("own"))), lambda a, b: F.when(a["by_rank"] < b["by_rank"], -1).when(a["by_rank"] > b["by_rank"], 1).otherwise(0))
    lists = candidates.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.transform("rows", lambda r: r["own"]).alias("rows"))
    kept = lists.select("query_id", F.posexplode(chosen(F.col("rows"), max_chunks, per_doc, per_page, diverse, multi_year)).alias("place", "row"))
    return kept.select(*[F.col("query_id") if c == "query_id" else F.col(f"row.{c}").alias(c) for c in candidates.columns], F.col("place").cast("int").alias("place"))


CANDIDATE = ("query_id", "rank", "doc_id", "chunk_type", "citation_key", "text", "page", "ticker", "fiscal_year", "row_label")


def with_parents(context: DataFrame, chunks: DataFrame) -> DataFrame:
    """``context`` (query_id, place, chunk_id, parent_chunk_id, chunk_type, col_header) with the table chunks whose
    rows lost their period: parents of row chunks without a column header, not yet in context, come first."""
    asked = context.where((F.col("chunk_type") == "row") & (F.trim(F.coalesce("col_header", F.lit(""))) == "") & F.col("parent_chunk_id").isNotNull())
    asked = asked.groupBy("query_id", F.col("parent_chunk_id").alias("chunk_id")).agg(F.min("place").alias("asked"))
    new = asked.join(context.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    found = new.join(chunks.where(F.col("chunk_type").isin("table", "micro_block")).select("chunk_id", "chunk_type"), "chunk_id")
    both = found.select("query_id", "chunk_id", "chunk_type", F.lit(0).alias("part"), F.col("asked").alias("at")).unionByName(context.select("query_id", "chunk_id", "chunk_type", F.lit(1).alias("part"), F.col("place").alias("at")))
    order = Window.partitionBy("query_id").orderBy("part", "at", "chunk_id")
    return both.select("query_id", "chunk_id", "chunk_type", (F.row_number().over(order) - 1).alias("place"))


def source_block(place: Column) -> Column:
    """One numbered source with its label and metadata, as a prompt shows it."""
    some = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    known = lambda c: F.coalesce(some(c), F.lit("?"))
    label = F.concat(F.lit("["), known("ticker"), F.lit(" "), known("form_type"), F.lit(" FY"), known("fiscal_year"), F.lit(", p."), known("page"), F.lit("]"))
    period = F.coalesce(some("col_header"), F.concat(F.lit("period ended "), some("period_end_date")), F.concat(F.lit("FY"), some("fiscal_year"), F.lit(" filing")))
    metric = F.when((F.col("chunk_type") == "row") & some("row_label").isNotNull(), F.concat(F.lit("metric: "), some("row_label"), F.coalesce(F.concat(F.lit(" ("), period, F.lit(")")), F.lit(""))))
    bits = F.concat_ws(" | ", F.when(F.lower(some("section")) != "general", some("section")), some("chunk_type"), metric)
    head = F.concat(F.lit("Source "), (place + 1).cast("string"), F.lit(" "), label, F.when(bits != "", F.concat(F.lit(" — "), bits)).otherwise(""))
    return F.concat(head, F.lit("\n"), F.coalesce(some("text"), F.lit("")))


SEPARATOR = "\n\n---\n\n"


def within_budget(blocks: DataFrame, budget: int, join_cost: int = 6) -> DataFrame:
    """Of (query_id, place, block) the leading blocks whose running length, with ``join_cost`` for each join, keeps
    within ``budget``: everything from the first block that exceeds it is left out."""
    upto = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.length("block") + join_cost).over(upto) - join_cost
    return blocks.withColumn("total_chars", total).where(F.col("total_chars") <= budget)


def rendered(blocks: DataFrame) -> DataFrame:
    """(query_id, context): the blocks of each query in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "block")))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), SEPARATOR).alias("context"))
