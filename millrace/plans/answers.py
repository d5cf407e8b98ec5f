"""Queries: planning, numbers, citations, verification, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as nu
from ..operators import answer as an
from ..operators import metrics as me
from ..operators import planner as pl
from ..sources.sinks import stored
from .registry import query
from .tables import hybrid_corpus, read

QUESTIONS = (
    "What was {} revenue in FY2024?", "Compare {} and Goldman Sachs net income in FY2023.", "How has {} debt trended over the past 3 years?", "How are companies discussing AI demand across the industry?",
    "Should I invest in {} or Visa?", "Latest quarterly segment breakdown for {}", "{} energy generation in 2022", "V and MA margins", "8-K recent performance of {}",
)
ALIASES = ("Apple", "tesla", "JPMorgan Chase", "Procter & Gamble", "amazon.com", "ge aerospace", "Nobody")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ASK_SQL = f"SELECT c_custkey AS query_id, replace(([{', '.join(map(_lit, QUESTIONS))}])[c_custkey % {len(QUESTIONS)} + 1], '{{}}', ([{', '.join(map(_lit, ALIASES))}])[c_custkey % {len(ALIASES)} + 1]) AS query FROM customer"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda x: F.element_at(F.array(*map(F.lit, x)), (F.col("c_custkey") % len(x) + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.replace(pick(QUESTIONS), F.lit("{}"), pick(ALIASES)).alias("query"))


def _re2(alias: str) -> str:
    return _lit(r"(?i)(^|[^A-Za-z0-9])" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in alias) + r"($|[^A-Za-z0-9])")


_TICKERS = ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches(query, {_re2(a)})' for a in aliases)} OR list_contains(caps, '{t}') THEN '{t}' END" for t, aliases in pl.COMPANIES.items())
_SECTOR = "CASE " + " ".join(f"WHEN regexp_matches(query, {_re2(a)}) THEN {_lit(s)}" for a, s in sorted(((a, s) for s, x in pl.SECTORS.items() for a in x), key=lambda x: -len(x[0]))) + " END"
_FLAG_SQL = ", ".join(f"regexp_matches(query, {_lit('(?i)' + chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')}) AS {f}" for f, p in pl.FAMILIES.items())


@query(f"""WITH q AS ({ASK_SQL}), c AS (SELECT *, regexp_extract_all(query, '\\b[A-Z]{{1,5}}(?:-[A-Z])?\\b') AS caps FROM q),
  p AS (SELECT query_id, query, list_sort(list_filter([{_TICKERS}], lambda x: x IS NOT NULL)) AS tickers, {_SECTOR} AS sector, {_FLAG_SQL}, list_sort(list_distinct(list_transform(regexp_extract_all(query, '(?i)\\b(?:FY\\s*)?(20\\d{{2}})\\b', 1), lambda x: CAST(x AS INTEGER))), 'DESC') AS years FROM c),
  i AS (SELECT *, len(tickers) AS n, CASE WHEN investment THEN 'investment_opinion' WHEN thematic AND (len(tickers) = 0 OR len(tickers) > 2 OR regexp_matches(lower(query), 'across|sector|industry')) THEN 'thematic_synthesis' WHEN trend THEN 'trend_over_time'
    WHEN len(tickers) > 1 AND (comparison OR numeric) THEN 'cross_company_comparison' WHEN thematic THEN 'thematic_synthesis' ELSE 'single_company_factual' END AS intent FROM p)
  SELECT query_id, intent, array_to_string(tickers, ',') AS tickers, sector, array_to_string(years, ',') AS years, CASE WHEN annual AND NOT quarterly THEN 'annual' WHEN quarterly AND NOT annual THEN 'quarterly' WHEN release THEN 'event' ELSE 'either' END AS report_scope,
  CASE intent WHEN 'single_company_factual' THEN 36 WHEN 'cross_company_comparison' THEN 72 WHEN 'trend_over_time' THEN 60 WHEN 'thematic_synthesis' THEN 90 ELSE 96 END AS dense_k,
  CASE intent WHEN 'single_company_factual' THEN 6 WHEN 'cross_company_comparison' THEN greatest(8, 2 * greatest(2, n)) WHEN 'trend_over_time' THEN 8 WHEN 'thematic_synthesis' THEN 12 ELSE greatest(10, 2 * greatest(2, n)) END AS final_k FROM i""")
def plan_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of questions about companies, without a corpus of years."""
    rows = pl.plan_queries(asked(spark, sf_dir))
    return rows.select("query_id", "intent", F.array_join("tickers", ",").alias("tickers"), "sector", F.array_join(F.transform("fiscal_years", lambda y: y.cast("string")), ",").alias("years"), "report_scope", "dense_k", "final_k")


UNIT_TEXTS = ("${} billion", "{} million", "{}.5%", "{} thousand", "{}K", "{},000 T", "{}")
UNIT_FACTORS = (1e9, 1e6, 1, 1e3, 1e3, 1e15, 1)


@query(f"""SELECT l_orderkey, l_linenumber, (l_partkey % 900 + CASE WHEN l_partkey % 7 = 2 THEN 0.5 ELSE 0 END) * ([{', '.join(map(str, UNIT_FACTORS))}])[l_partkey % 7 + 1]::DOUBLE AS value FROM lineitem""")
def normalise_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace(F.element_at(F.array(*map(F.lit, UNIT_TEXTS)), (F.col("l_partkey") % 7 + 1).cast("int")), F.lit("{}"), (F.col("l_partkey") % 900).cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", nu.normal_number(raw).alias("value"))


@query("""WITH o AS (SELECT o_orderkey AS query_id, o_custkey % 500 + 1 AS a, o_orderkey % 9 AS b FROM orders)
  SELECT query_id, CASE WHEN a IN (3 * (b + 1), 5) THEN '' ELSE '$' || a || ' million' END AS missing FROM o""")
def numeric_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with an amount, held against contexts in millions with another one (and 5, which stands before a %)."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 500 + 1).cast("string").alias("a"), (3 * (F.col("o_orderkey") % 9 + 1)).cast("string").alias("b"))
    answers = rows.select("query_id", F.concat(F.lit("It was $"), "a", F.lit(" million in all, that is 5% more.")).alias("answer"))
    context = rows.select("query_id", F.concat(F.lit("(In millions) Revenue "), "b", F.lit(" grew by 5%")).alias("text"))
    return nu.unsupported_numbers(answers, context).select("query_id", F.array_join("missing", ",").alias("missing"))


@query("""WITH o AS (SELECT o_orderkey AS query_id, o_custkey % 40 AS p, o_orderkey % 40 AS c FROM orders) SELECT query_id, 'T1 10-K FY2024, p.' || p || '-' || (p + 2) AS label, c IN (p, p + 2) AS matched FROM o""")
def citations_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges fit their two ends only."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 40).alias("p"), (F.col("o_orderkey") % 40).alias("c"))
    answers = rows.select("query_id", F.concat(F.lit("Up [t1 10-K FY2024, pp. "), F.col("p").cast("string"), F.lit("-"), (F.col("p") + 2).cast("string"), F.lit("]. Again [T1 10-K FY2024, p. "), F.col("p").cast("string"), F.lit("-"), (F.col("p") + 2).cast("string"), F.lit("]")).alias("answer"))
    context = rows.select("query_id", F.lit(0).alias("place"), F.lit("x").alias("chunk_id"), F.lit("T1").alias("ticker"), F.lit("10-k").alias("form_type"), F.lit(2024).alias("fiscal_year"), F.col("c").alias("page"))
    return nu.matched_citations(answers, context).select("query_id", "label", "matched")


@query("""WITH c AS (SELECT o_custkey AS query_id, count(*) AS n, list_distinct(list('T' || o_orderkey % 3)) AS have, list_distinct(list(year(o_orderdate))) AS years FROM orders GROUP BY 1),
  q AS (SELECT c_custkey AS query_id, (['single_company_factual', 'trend_over_time', 'thematic_synthesis', 'cross_company_comparison'])[c_custkey % 4 + 1] AS intent, coalesce(n, 0) AS n, coalesce(have, []) AS have, coalesce(years, []) AS years FROM customer LEFT JOIN c ON c_custkey = query_id)
  SELECT query_id, n > 0 AND n >= 3 AND CASE intent WHEN 'single_company_factual' THEN list_has_any(have, ['T0', 'T1']) AND list_contains(years, 1998) WHEN 'trend_over_time' THEN list_has_any(have, ['T0', 'T1']) AND len(years) >= 2
    WHEN 'thematic_synthesis' THEN len(have) >= 2 ELSE list_has_all(have, ['T0', 'T1']) END AS passed FROM q""")
def verify_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 3).cast("string")).alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), F.lit("10-K").alias("form_type"), F.lit("10-K").alias("source_class"))
    intent = F.element_at(F.array(*map(F.lit, ("single_company_factual", "trend_over_time", "thematic_synthesis", "cross_company_comparison"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    plans = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), intent.alias("intent"), F.array(F.lit("T0"), F.lit("T1")).alias("tickers"), F.array(F.lit(1998)).alias("fiscal_years"), F.array(F.lit("10-K")).alias("source_classes"), F.lit(None).cast("int").alias("latest_year"), F.lit(6).alias("final_k"))
    return an.verified(context, plans).select("query_id", "passed")


RESULT_SQL = """SELECT o_orderkey AS query_id, (['Insufficient evidence in all', 'Revenue was 5 [T1 10-K FY2024, p.3]', 'Error', 'It was Five [T1 10-K FY2024, pp. 7-9]'])[o_orderkey % 4 + 1] AS answer, [CAST(o_orderkey % 10 AS INTEGER)] AS gold, o_orderkey % 6 = 0 AS bad, o_orderkey % 5 <> 0 AS correct_period FROM orders"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    answer = F.element_at(F.array(*map(F.lit, ("Insufficient evidence in all", "Revenue was 5 [T1 10-K FY2024, p.3]", "Error", "It was Five [T1 10-K FY2024, pp. 7-9]"))), (key % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(
        key.alias("query_id"), answer.alias("answer"), F.array((key % 10).cast("int")).alias("gold"), F.when(key % 6 == 0, F.array(F.lit("9%"))).otherwise(F.array().cast("array<string>")).alias("hallucinated_numbers"), (key % 5 != 0).alias("correct_period"),
        F.when(answer == "Error", "x").alias("error"), F.lit("REVENUE").alias("gold_answer"), F.array(F.lit("five")).alias("gold_alternatives"),
    )


@query("WITH r AS (" + RESULT_SQL + """), p AS (SELECT *, CASE WHEN answer LIKE 'Revenue%' THEN [3] WHEN answer LIKE 'It was%' THEN [7, 9] ELSE [] END AS pages FROM r)
  SELECT round(avg(CAST(regexp_matches(lower(answer), 'revenue|five') AS INTEGER)), 6) AS correctness, round(avg(CAST(NOT bad AS INTEGER)), 6) AS faithfulness, round(avg(CAST(answer LIKE 'Insufficient%' AS INTEGER)), 6) AS abstention_rate,
  round(avg(CASE WHEN answer NOT LIKE 'Insufficient%' THEN CAST(list_has_any(pages, gold) AS INTEGER) END), 6) AS citation_accuracy, count(*) AS n FROM p""")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.answer_metrics(results(spark, sf_dir))


@query("WITH r AS (" + RESULT_SQL + """), p AS (SELECT *, CASE WHEN answer LIKE 'Revenue%' THEN [3] WHEN answer LIKE 'It was%' THEN [7, 9] ELSE [] END AS pages FROM r),
  f AS (SELECT unnest(CASE WHEN answer = 'Error' THEN ['error'] ELSE list_filter([CASE WHEN answer LIKE 'Insufficient%' THEN 'abstention' END, CASE WHEN NOT correct_period THEN 'wrong_period' END, CASE WHEN bad THEN 'hallucination_blocked' END,
    CASE WHEN answer NOT LIKE 'Insufficient%' AND NOT list_has_any(pages, gold) THEN 'citation_miss' END], lambda x: x IS NOT NULL) END) AS failure FROM p) SELECT failure, count(*) AS n FROM f GROUP BY 1""")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.failures(results(spark, sf_dir)).groupBy("failure").agg(F.count("*").alias("n"))


@query()
def answer_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from plan to checked answer over the hybrid corpus, with the default models."""
    corpus = stored(hybrid_corpus(spark, sf_dir).drop("lang", "label"), "corpus")
    chunks = corpus.select(
        "id", F.col("id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), "text", "embedding", F.lit("prose").alias("chunk_type"), F.lit("10-K").alias("source_class"), F.lit("10-K").alias("form_type"), F.lit("other_table").alias("statement_type"), F.lit("annual").alias("period_type"),
        F.lit(1).alias("report_priority"), F.lit("").alias("row_label"), F.lit("").alias("col_header"), (F.col("id") % 5 + 2020).cast("int").alias("fiscal_year"), F.lit(None).cast("string").alias("fiscal_quarter"), F.array().cast("array<string>").alias("periods"), F.element_at(F.array(F.lit("AAPL"), F.lit("TSLA")), (F.col("id") % 2 + 1).cast("int")).alias("ticker"),
        F.lit("Technology").alias("sector"), F.lit("").alias("section"), F.lit("").alias("table_title"), F.concat(F.lit("p."), F.col("id").cast("string")).alias("citation_key"), F.col("id").cast("int").alias("page"), F.lit("").alias("period_end_date"),
    )
    engine = an.Engine(spark, chunks, embed=lambda q: [float(ord(q[i % len(q)]) % 7 - 3) for i in range(64)])
    rows = [(q, r["intent"], r["retries"], r["answer"], r["context_count"]) for q in ("What was Apple revenue in FY2022?", "Compare Apple and Tesla margins") for r in [engine.ask(q)]]
    return spark.createDataFrame(rows, "query string, intent string, retries int, answer string, context_count int")

