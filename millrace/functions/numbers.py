"""Numbers in financial text: extraction, normal form, and whether a context bears them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a financial number, and units.
FINANCIAL = r"(?i)(?<![A-Za-z0-9])(?:\$?\d[\d,]*(?:\.\d+)?\s*(?:B|M|K|T)\b|\$?\d[\d,]*(?:\.\d+)?\s*(?:billion|million|thousand|trillion)\b|\d[\d,]*(?:\.\d+)?\s*%)"
BARE = r"(?i)(?<![A-Za-z$%])\b(\d[\d,]*(?:\.\d+)?)\b(?!\s*(?:B|M|K|T|%|billion|million|thousand|trillion)\b)"
UNITS = {"t": 1e12, "trillion": 1e12, "b": 1e9, "billion": 1e9, "m": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3}
SCALES = (1e6, 1e9, 1e3)
CITATION = r"(?i)\[([A-Z][A-Z0-9\-]*)\s+([A-Za-z0-9\-\/]+)\s+FY(\d{4}),\s*p{1,2}\.?\s*(\d+)(?:\s*[-–]\s*(\d+))?\]"


def normal_number(raw: Column, compat: bool = False) -> Column:
    """The value of a number with its unit. ``compat`` reads "thousand" as t, a trillion, as the reference does."""
    order = ("t", "trillion", "b", "billion", "m", "million", "k", "thousand") if compat else ("trillion", "thousand", "t", "billion", "b", "million", "m", "k")
    pattern = r"(?i)\$?(\d+(?:\.\d+)?)\s*(" + "|".join(order) + ")?"
    plain = F.replace(raw, F.lit(","), F.lit(""))
    factor = F.element_at(F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)]), F.lower(F.regexp_extract(plain, pattern, 2)))
    return F.regexp_extract(plain, pattern, 1).try_cast("double") * F.coalesce(factor, F.lit(1.0))


def financial_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FINANCIAL), F.lit(0))


def bare_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(BARE), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def scaled_values(text: Column) -> Column:
    """Values that bare numbers may stand for: by the text's own unit header, else, where amounts are evident, each
    number from 100 up in millions, billions and thousands."""
    unit = F.lower(F.regexp_extract(text, r"(?i)\(In\s+(million|billion|thousand)s?", 1))
    own = F.when(unit == "million", 1e6).when(unit == "billion", 1e9).when(unit == "thousand", 1e3)
    bare = bare_numbers(text)
    evident = text.rlike(r"\|\s*\$\s*\|") | F.exists(bare, lambda x: x >= 1000)
    implied = F.flatten(F.transform(F.filter(bare, lambda x: x >= 100), lambda x: F.array(*[x * s for s in SCALES])))
    none = F.array().cast("array<double>")
    return F.when(own.isNotNull(), F.transform(bare, lambda x: x * own)).when(evident, implied).otherwise(none)


def unsupported_numbers(answers: DataFrame, context: DataFrame, compat: bool = False) -> DataFrame:
    """(query_id, missing): for each answer (query_id, answer) its sorted distinct numbers that no text of its context
    (query_id, text) bears out, word for word or by value."""
    raw = answers.select("query_id", F.explode(F.array_distinct(F.transform(financial_numbers(F.col("answer")), F.trim))).alias("raw"))
    raw = raw.withColumn("value", normal_number(F.col("raw"), compat)).withColumn("bare", F.when(F.col("raw").endswith("%"), F.trim(F.regexp_replace("raw", "%+$", ""))))
    raw = raw.withColumn("bare_value", normal_number(F.col("bare"), compat))
    seen = context.select("query_id", "text", F.array_union(F.transform(financial_numbers(F.col("text")), lambda x: normal_number(x, compat)), scaled_values(F.col("text"))).alias("values"))
    holds = lambda v: F.coalesce(F.array_contains("values", v), F.lit(False))
    backed = F.col("text").contains(F.col("raw")) | holds(F.col("value")) | F.coalesce(F.col("text").contains(F.col("bare")), F.lit(False)) | holds(F.col("bare_value"))
    missing = raw.join(raw.join(seen, "query_id").where(backed).select("query_id", "raw").distinct(), ["query_id", "raw"], "left_anti")
    found = missing.groupBy("query_id").agg(F.array_sort(F.collect_set("raw")).alias("missing"))
    return answers.select("query_id").distinct().join(found, "query_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def citations(answers: DataFrame) -> DataFrame:
    """(query_id, place, ticker, form, year, page, page_end) of each distinct citation in ``answers``."""
    parts = [F.regexp_extract_all("answer", F.lit(CITATION), F.lit(k)).alias(n) for k, n in enumerate(("ticker", "form", "year", "page", "page_end"), 1)]
    rows = answers.select("query_id", F.posexplode(F.arrays_zip(*parts)).alias("place", "c")).select("query_id", "place", F.upper("c.ticker").alias("ticker"), F.col("c.form").alias("form"), "c.year", "c.page", F.nullif("c.page_end", F.lit("")).alias("page_end"))
    same = rows.groupBy("query_id", "ticker", F.upper("form").alias("up"), "year", "page", "page_end").agg(F.min(F.struct("place", "form")).alias("first"))
    return same.select("query_id", "first.place", "ticker", "first.form", "year", "page", "page_end")


def matched_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """``citations`` with label, chunk_id of the first context chunk (query_id, place, chunk_id, ticker, form_type,
    fiscal_year, page) that fits, and matched. A page range fits its two ends only."""
    found = citations(answers)
    chunk = context.select("query_id", F.upper("ticker").alias("ticker"), F.upper("form_type").alias("up"), F.col("fiscal_year").cast("string").alias("year"), F.col("page").cast("string").alias("at"), F.struct(F.col("place").alias("p"), "chunk_id").alias("chunk"))
    met = found.withColumn("up", F.upper("form")).join(chunk, ["query_id", "ticker", "up", "year"]).where((F.col("at") == F.col("page")) | (F.col("at") == F.col("page_end")))
    first = met.groupBy("query_id", "place").agg(F.min("chunk").alias("chunk"))
    label = F.concat("ticker", F.lit(" "), "form", F.lit(" FY"), "year", F.lit(", p."), "page", F.coalesce(F.concat(F.lit("-"), "page_end"), F.lit("")))
    return found.join(first, ["query_id", "place"], "left").select("query_id", "place", label.alias("label"), F.col("chunk.chunk_id").alias("chunk_id"), F.col("chunk").isNotNull().alias("matched"))
