"""Rule-based query planning: entities, years, intent, filters and search depths, as columns over many queries.

``plan_queries`` plans a whole table of queries in one pass; ``plan`` is the same for one question on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words that stand for companies and sectors, and word families that set a query's flags.
COMPANIES = {
    "AAPL": ("apple", "apple inc"), "MSFT": ("microsoft", "microsoft corp"), "NVDA": ("nvidia",), "AMZN": ("amazon", "amazon.com"), "GOOGL": ("google", "alphabet"), "META": ("meta", "facebook"),
    "TSLA": ("tesla",), "BRK-B": ("berkshire", "berkshire hathaway"), "JPM": ("jpmorgan", "jp morgan", "jpmorgan chase"), "V": ("visa",), "UNH": ("unitedhealth", "unitedhealth group"), "XOM": ("exxon", "exxonmobil"),
    "MA": ("mastercard",), "LLY": ("eli lilly", "lilly"), "AVGO": ("broadcom",), "JNJ": ("johnson", "johnson & johnson"), "PG": ("procter", "procter & gamble"), "HD": ("home depot",), "COST": ("costco",), "MRK": ("merck",),
    "ABBV": ("abbvie",), "CVX": ("chevron",), "CRM": ("salesforce",), "AMD": ("amd", "advanced micro devices"), "NFLX": ("netflix",), "TMO": ("thermo fisher",), "ACN": ("accenture",), "LIN": ("linde",), "MCD": ("mcdonald",),
    "BAC": ("bank of america",), "WMT": ("walmart",), "PEP": ("pepsi",), "ORCL": ("oracle",), "CSCO": ("cisco",), "ABT": ("abbott",), "GE": ("ge aerospace", "general electric"), "TXN": ("texas instruments",), "QCOM": ("qualcomm",),
    "IBM": ("ibm",), "NOW": ("servicenow",), "MS": ("morgan stanley",), "GS": ("goldman sachs", "goldman"), "INTU": ("intuit",), "AMAT": ("applied materials",), "SPGI": ("s&p global", "sp global"), "BLK": ("blackrock",),
    "CAT": ("caterpillar",), "RTX": ("rtx",), "HON": ("honeywell",),
}
SECTORS = {
    "Technology": ("technology", "tech", "software", "semiconductor", "semiconductors", "chip", "chips"), "Financial Services": ("financial sector", "financial services", "financial", "bank", "banks", "banking"),
    "Healthcare": ("healthcare", "health care", "pharma", "biotech"), "Energy": ("energy", "oil", "gas"), "Utilities": ("utilities",), "Real Estate": ("real estate",), "Communication Services": ("communication services", "media"),
    "Consumer Staples": ("consumer staples",), "Consumer Discretionary": ("consumer discretionary", "retail"), "Industrials": ("industrials", "industrial"), "Basic Materials": ("materials", "basic materials"),
}
FAMILIES = {
    "numeric": r"revenue|segments?|net\s+income|gross\s+margin|margins?|debt|cash|assets?|liabilit(?:y|ies)|eps|earn(?:ings?)?|capex|dividends?|buybacks?|r&d|research\s+and\s+development|operating\s+income|cash\s+flows?|balance\s+sheet",
    "comparison": r"compare|comparison|versus|vs|between|relative\s+to|compared\s+with|peers?|among",
    "trend": r"trend(?:ed|ing)?|over\s+time|(?:past|last)\s+\d+\s+(?:fiscal\s+)?years?|histor(?:y|ical|ically)|yoy|year\s+over\s+year|grow(?:th|ing|n)?|declin(?:e|ed|ing)|increas(?:e|ed|ing)|chang(?:e|ed|ing)",
    "thematic": r"how\s+are|discuss(?:ing|ed)?|talk(?:ing)?\s+about|mention(?:ed|ing)?|commentary|themes?|ai|artificial\s+intelligence|adoption|demand|outlook|guidance|macro|strategy|across|sector|industry|companies|recent\s+performance",
    "investment": r"(?:which\s+)?should\s+i\s+invest|worth\s+investing|invest(?:ing|ment)?|buy|sell|recommend(?:ation|ed)?|portfolio|valuation|best\s+stock",
    "segment": r"segments?|break\s*down|by\s+segment|geograph(?:y|ic)|business\s+units?",
    "annual": r"fy\s*20\d{2}|fiscal\s+year|annual|10-?k|last\s+reported\s+fy|latest\s+(?:fiscal\s+year|fy|annual)|(?:past|last)\s+\d+\s+fiscal\s+years?|over\s+the\s+(?:past|last)\s+\d+\s+(?:fiscal\s+)?years?",
    "quarterly": r"quarter(?:ly)?|q[1-4]|10-?q|three\s+months\s+ended|nine\s+months\s+ended",
    "release": r"earnings\s+release|results\s+of\s+operations|8-?k|recent\s+performance",
    "latest": r"latest|most\s+recent|current|last\s+reported|recent",
}
DEPTHS = {"single_company_factual": (36, 10, 6), "cross_company_comparison": (72, 18, 8), "trend_over_time": (60, 16, 8), "thematic_synthesis": (90, 22, 12), "investment_opinion": (96, 24, 10)}
BY_COMPANIES = ("cross_company_comparison", "investment_opinion")
DIVERSE = ("cross_company_comparison", "thematic_synthesis", "investment_opinion")
ADDED = {"segment": "segment revenue operating income business units geography", "numeric": "financial statement table row values"}


def has(query: Column, family: str) -> Column:
    return query.rlike(r"(?i)\b(?:" + FAMILIES[family] + r")\b")


def _quoted(alias: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in alias)


def names(query: Column, alias: str) -> Column:
    return query.rlike(r"(?i)(?<![A-Za-z0-9])" + _quoted(alias) + r"(?![A-Za-z0-9])")


def tickers(query: Column) -> Column:
    """Sorted tickers that a query names by alias or by capital letters."""
    named = [F.when(reduce(Column.__or__, [names(query, a) for a in aliases]), F.lit(t)) for t, aliases in COMPANIES.items()]
    capitals = F.array_intersect(F.regexp_extract_all(query, F.lit(r"\b[A-Z]{1,5}(?:-[A-Z])?\b"), F.lit(0)), F.array(*map(F.lit, COMPANIES)))
    return F.array_sort(F.array_union(F.array_compact(F.array(*named)), capitals))


def sector(query: Column) -> Column:
    """The sector of the longest alias in a query, else null."""
    aliases = sorted(((a, s) for s, every in SECTORS.items() for a in every), key=lambda x: -len(x[0]))
    return F.coalesce(*[F.when(names(query, a), F.lit(s)) for a, s in aliases])


def years_of(query: Column, available: Column) -> Column:
    """Years of a query, newest first: named ones; the last n before the newest named or available one; or, for
    "latest", the newest available (``available`` is sorted, newest first)."""
    named = F.reverse(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(r"(?i)\b(?:FY\s*)?(20\d{2})\b"), F.lit(1)), lambda x: x.cast("int")))))
    n = F.greatest(F.lit(1), F.least(F.lit(10), F.regexp_extract(query, r"(?i)\b(?:last|past)\s+(\d+)\s+(?:fiscal\s+)?years?\b", 1).try_cast("int")))
    spoken = query.rlike(r"(?i)\b(?:last|past)\s+\d+\s+(?:fiscal\s+)?years?\b")
    back = F.when(F.size(named) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(named, F.lit(0)) - i)).otherwise(F.slice(available, 1, n))
    return F.when(spoken, back).when(F.size(named) > 0, named).when(has(query, "latest"), F.slice(available, 1, 1)).otherwise(F.array().cast("array<int>"))


def plan_queries(queries: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``queries`` (query_id, query) with their plans. ``corpus`` (ticker, sector, fiscal_year) tells which years
    there are in the scope of a query; all of them count, however many."""
    q = F.col("query")
    flags = {f: has(q, f) for f in FAMILIES}
    rows = queries.select("query_id", "query", tickers(q).alias("tickers"), sector(q).alias("sector"), *[c.alias(f) for f, c in flags.items()])
    if corpus is None:
        rows = rows.withColumn("available", F.array().cast("array<int>"))
    else:
        scopes = corpus.where("fiscal_year is not null").select("ticker", F.col("sector").alias("in_sector"), F.col("fiscal_year").cast("int").alias("y")).distinct()
        # a query meets the scopes of its companies, else of its sector, by equality; without either all years count
        named = rows.select("query_id", "sector", F.explode("tickers").alias("ticker")).join(scopes, "ticker").where("sector is null or sector = in_sector").select("query_id", "y")
        by_sector = scopes.select(F.col("in_sector").alias("sector"), "y").distinct()
        others = rows.where((F.size("tickers") == 0) & F.col("sector").isNotNull()).select("query_id", "sector").join(by_sector, "sector").select("query_id", "y")
        found = named.union(others).groupBy("query_id").agg(F.collect_set("y").alias("ys"))
        every = scopes.agg(F.collect_set("y").alias("all_years"))  # one row
        own = F.when((F.size("tickers") == 0) & F.col("sector").isNull(), F.col("all_years")).otherwise(F.coalesce("ys", F.array().cast("array<int>")))
        rows = rows.join(found, "query_id", "left").crossJoin(F.broadcast(every)).withColumn("available", F.reverse(F.array_sort(own))).drop("ys", "all_years")
    n = F.size("tickers")
    broad = (n == 0) | (n > 2) | F.lower(q).rlike("across|sector|industry")
    intent = (
        F.when(F.col("investment"), "investment_opinion").when(F.col("thematic") & broad, "thematic_synthesis").when(F.col("trend"), "trend_over_time")
        .when((n > 1) & (F.col("comparison") | F.col("numeric")), "cross_company_comparison").when(F.col("thematic"), "thematic_synthesis").otherwise("single_company_factual")
    )
    scope = F.when(F.col("annual") & ~F.col("quarterly"), "annual").when(F.col("quarterly") & ~F.col("annual"), "quarterly").when(F.col("release"), "event").otherwise("either")
    rows = rows.withColumn("intent", intent).withColumn("report_scope", scope).withColumn("named_years", years_of(q, F.col("available")))
    lists = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    sources = F.when(F.col("report_scope") == "annual", lists("10-K")).when((F.col("report_scope") == "quarterly") & F.col("release"), lists("10-Q", "8-K-earnings")).when(F.col("report_scope") == "quarterly", lists("10-Q")).when(F.col("report_scope") == "event", lists("8-K-earnings")).otherwise(lists())
    years = F.when((F.col("intent") == "trend_over_time") & (F.size("named_years") == 0), F.slice("available", 1, 3)).otherwise(F.col("named_years"))
    depth = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, d in DEPTHS.items() for x in (name, d[k])]), F.col("intent"))
    final = F.when(F.col("intent").isin(*BY_COMPANIES), F.greatest(depth(2), 2 * F.greatest(F.lit(2), n))).otherwise(depth(2))
    kinds = F.concat(F.when(F.col("numeric"), lists("row", "table", "micro_block")).otherwise(lists()), F.when(F.col("thematic"), lists("prose")).otherwise(lists()))
    return rows.select(
        "query_id", "query", F.concat_ws(" ", q, *[F.when(F.col(f), F.lit(words)) for f, words in ADDED.items()]).alias("retrieval_query"), "intent", "tickers", "sector", years.alias("fiscal_years"), "report_scope", sources.alias("source_classes"),
        F.when(F.col("segment") & (F.col("intent") == "single_company_factual"), lists("segment_table")).otherwise(lists()).alias("statement_types"), kinds.alias("chunk_types"), depth(0).alias("dense_k"), depth(0).alias("sparse_k"), depth(1).alias("rerank_k"), final.alias("final_k"),
        F.when(n > 1, "multi").when(n == 1, "single").otherwise("broad").alias("entity_scope"), F.when(F.size("named_years") > 0, "specific_years").when(F.col("latest"), "latest").otherwise("unspecified").alias("time_scope"), F.get("available", F.lit(0)).alias("latest_year"),
        (F.col("intent").isin(*DIVERSE) | (n > 1)).alias("multi_hop"), F.col("intent").isin(*DIVERSE).alias("diverse"), (F.col("intent") == "trend_over_time").alias("multi_year"), *FAMILIES,
    )


def plan(spark: SparkSession, question: str, corpus: DataFrame | None = None) -> dict:
    """The plan of one question as the search functions take it: filters, depths, flags and hints."""
    row = plan_queries(spark.createDataFrame([(0, question)], "query_id long, query string"), corpus).first().asDict()
    one = lambda x: x[0] if len(x) == 1 else list(x)
    filters = {"ticker": row["tickers"], "fiscal_year": row["fiscal_years"], "sector": [row["sector"]] if row["sector"] else [], "source_class": row["source_classes"], "statement_type": row["statement_types"]}
    hints = {"prefer_source_classes": row["source_classes"], "prefer_statement_types": ["segment_table"] if row["segment"] else [], "prefer_chunk_types": row["chunk_types"], "multi_hop": row["multi_hop"], "diverse": row["diverse"], "multi_year": row["multi_year"]}
    flags = {"numeric": row["numeric"], "latest": row["latest"], "annual": row["report_scope"] == "annual", "trend": row["trend"]}
    return row | {"question": question, "query": row["retrieval_query"], "filters": {k: one(v) for k, v in filters.items() if v}, "retrieval_hints": hints, "flags": flags}


def latest_years(corpus: DataFrame) -> DataFrame:
    """The newest year of each ticker."""
    return corpus.groupBy("ticker").agg(F.max("fiscal_year").alias("latest_year"))


def alias_matches(queries: DataFrame, aliases: DataFrame, lead: int = 4) -> DataFrame:
    """(query_id, code): codes of all aliases (alias, code) that stand in a query as whole words. Queries are met by
    their runs of ``lead`` words (fewer for shorter aliases), so the join is on equal strings and no query meets every
    alias; whole aliases are then looked for in the queries that hold their beginning."""
    words = lambda c: F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), "")
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    keyed = aliases.select("code", words(F.col("alias")).alias("a")).where(F.size("a") > 0)
    keyed = keyed.select("code", F.array_join(F.slice("a", 1, lead), " ").alias("key"), spaced(F.col("a")).alias("whole"))
    own = queries.select("query_id", words(F.col("query")).alias("w"))
    sizes = [r["n"] for r in aliases.select(F.least(F.size(words(F.col("alias"))), F.lit(lead)).alias("n")).where("n > 0").distinct().collect()]  # ``lead`` at most

    def runs(w: Column) -> Column:
        each = [F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>")), _joined(w, n)) for n in sorted(sizes)]
        return F.array_distinct(F.flatten(F.array(*each))) if each else F.array().cast("array<string>")

    # a lambda's variable is made once for a query; the column itself would be made again for each run
    keys = own.select("query_id", F.explode(F.element_at(F.transform(F.array("w"), runs), 1)).alias("key"))
    met = keys.join(keyed, "key").select("query_id", "code", "whole")
    return met.join(own.select("query_id", spaced(F.col("w")).alias("text")), "query_id").where(F.contains("text", F.col("whole"))).select("query_id", "code").distinct()


def _joined(w: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(w, i, n), " ")


def first_per_query(rows: DataFrame, order: list[Column]) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("rn = 1").drop("rn")
