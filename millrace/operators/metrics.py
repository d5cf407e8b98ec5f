"""Retrieval and answer metrics, as columns over ranked lists and as grouped means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _top(found: Column, k: int) -> Column:
    return F.slice(found, 1, k)


def recall_at(found: Column, gold: Column, k: int) -> Column:
    """Gold items among the first ``k``; 1 without gold."""
    hits = F.size(F.filter(gold, lambda g: F.array_contains(_top(found, k), g)))
    return F.when(F.size(gold) == 0, 1.0).otherwise(hits / F.nullif(F.size(gold), F.lit(0)))


def precision_at(found: Column, gold: Column, k: int) -> Column:
    """Hits among the first ``k``, repeats counted, over their number."""
    own = _top(found, k)
    return F.coalesce(F.size(F.filter(own, lambda x: F.array_contains(gold, x))) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0))


def f1_at(found: Column, gold: Column, k: int) -> Column:
    p, r = precision_at(found, gold, k), recall_at(found, gold, k)
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def reciprocal_rank(found: Column, gold: Column) -> Column:
    ranks = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(1 / F.get(ranks, F.lit(0)), F.lit(0.0))


def ndcg_at(found: Column, gold: Column, k: int, compat: bool = False) -> Column:
    """Gains by 1 / log2(place + 1) over the ideal. An item found again gains nothing, unless ``compat``."""
    own = _top(found, k)
    gain = lambda x, i: F.array_contains(gold, x) & (F.lit(compat) | (F.array_position(own, x) == i + 1))
    dcg = F.aggregate(F.transform(own, lambda x, i: F.when(gain(x, i), 1 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    size = F.least(F.size(F.array_distinct(gold)), F.lit(k))
    ideal = F.aggregate(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return F.when(ideal > 0, dcg / F.nullif(ideal, F.lit(0.0))).otherwise(0.0)


def retrieval_metrics(results: DataFrame, ks: tuple[int, ...] = (5, 10, 20), compat: bool = False) -> DataFrame:
    """``results`` (found, gold: arrays) with all metrics at each of ``ks`` and mrr."""
    found, gold = F.col("found"), F.col("gold")
    columns = {f"{name}_{k}": f(found, gold, k) for k in ks for name, f in (("recall", recall_at), ("precision", precision_at), ("f1", f1_at))}
    columns |= {f"ndcg_{k}": ndcg_at(found, gold, k, compat) for k in ks}
    return results.withColumns(columns | {"mrr": reciprocal_rank(found, gold)})


def means(measured: DataFrame, metrics: list[str], bucket: str = "bucket") -> DataFrame:
    """Means overall and by bucket, in one pass over grouping sets; the overall row has bucket "all"."""
    grouped = measured.rollup(bucket).agg(F.grouping(bucket).alias("total"), *[F.round(F.avg(m), 6).alias(m) for m in metrics], F.count("*").alias("n"))
    return grouped.withColumn(bucket, F.when(F.col("total") == 1, "all").otherwise(F.col(bucket).cast("string"))).drop("total")


def contains_gold(answer: Column, gold: Column, others: Column) -> Column:
    low = F.lower(answer)
    return low.contains(F.lower(gold)) | F.coalesce(F.exists(others, lambda x: low.contains(F.lower(x))), F.lit(False))


def cited_pages(answer: Column) -> Column:
    pattern = r"(?i)\[[A-Z][A-Z0-9\-]*\s+[A-Za-z0-9\-\/]+\s+FY\d{4},\s*pp?\.?\s*(\d+)(?:\s*[-–]\s*(\d+))?\]"
    both = F.concat(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), F.regexp_extract_all(answer, F.lit(pattern), F.lit(2)))
    return F.transform(F.filter(both, lambda x: x != ""), lambda x: x.cast("int"))


ABSTAINS = "Insufficient evidence"


def answer_metrics(results: DataFrame) -> DataFrame:
    """Correctness, faithfulness, abstention and citation accuracy of ``results`` (answer, gold_answer,
    gold_alternatives, hallucinated_numbers, gold pages); without cases that count a ratio is 0."""
    abstained = F.col("answer").startswith(ABSTAINS)
    cited = F.when(F.size("gold") == 0, True).otherwise(F.arrays_overlap(cited_pages(F.col("answer")), "gold"))
    ratio = lambda hit: F.coalesce(F.round(F.avg(hit.cast("int")), 6), F.lit(0.0))
    return results.agg(
        ratio(contains_gold(F.col("answer"), F.col("gold_answer"), F.col("gold_alternatives"))).alias("correctness"),
        ratio(F.size("hallucinated_numbers") == 0).alias("faithfulness"),
        ratio(abstained).alias("abstention_rate"),
        ratio(F.when(~abstained, cited)).alias("citation_accuracy"),
        F.count("*").alias("n"),
    )


def failures(results: DataFrame) -> DataFrame:
    """(query_id, failure): what went wrong with each of ``results``; one result can fail in several ways."""
    answer, pages = F.col("answer"), cited_pages(F.col("answer"))
    error = F.col("error").isNotNull() & (answer == "Error")
    kinds = F.when(error, F.array(F.lit("error"))).otherwise(F.array_compact(F.array(
        F.when(answer.startswith(ABSTAINS), "abstention"),
        F.when(~F.coalesce("correct_period", F.lit(True)), "wrong_period"),
        F.when(F.size("hallucinated_numbers") > 0, "hallucination_blocked"),
        F.when((F.size("gold") > 0) & ~answer.startswith("Insufficient") & ~F.coalesce(F.arrays_overlap(pages, "gold"), F.lit(False)), "citation_miss"),
    )))
    return results.select("query_id", F.explode(kinds).alias("failure"))


def first_of_bucket(rows: DataFrame, n: int, bucket: str, order: str) -> DataFrame:
    """The first ``n`` rows of each bucket: the sample that quick evaluations take."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(bucket).orderBy(order))).where(F.col("rn") <= n).drop("rn")
