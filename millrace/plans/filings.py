"""Queries: filing metadata, scans, joins and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filings as fl
from ..operators import planner as pl
from ..sources import sinks
from .registry import query
from .tables import FILINGS_SQL, filings, read


@query("WITH f AS (" + FILINGS_SQL + """), m AS (SELECT *, CASE WHEN form IN ('10-K', '10-KT') THEN 'annual' WHEN form = '10-Q' THEN 'quarterly' ELSE 'event' END AS period_type FROM f)
  SELECT o_orderkey, CASE form WHEN '10-K' THEN 1 WHEN '10-Q' THEN 2 WHEN '8-K' THEN 3 ELSE 9 END AS report_priority, period_type,
  coalesce(year(CAST(period_end AS DATE)), year(CAST(filed AS DATE)) - CASE WHEN form = '10-K' AND month(CAST(filed AS DATE)) <= 6 THEN 1 ELSE 0 END) AS fiscal_year,
  CASE WHEN period_type = 'quarterly' THEN quarter(CAST(period_end AS DATE)) END AS fiscal_quarter, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
  ticker || '_' || replace(lower(form), '-', '') || '_' || filed || '_' || right(accession, 6) AS doc_id, accession[1:10] || '-' || accession[11:12] || '-' || accession[13:] AS accession_fmt,
  CAST(('0x' || sha256(ticker || accession)[1:16])::UBIGINT AS VARCHAR) AS point_id, CAST(epoch(CAST(filed AS DATE)) AS BIGINT) AS filed_ts,
  CASE WHEN form LIKE '10-K%' THEN '10-K' WHEN form = '10-Q' THEN '10-Q' WHEN form = '8-K' THEN CASE WHEN o_orderkey % 2 = 0 THEN '8-K-earnings' ELSE '8-K' END WHEN form = 'DEF 14A' THEN 'proxy' ELSE form END AS source_class FROM m""")
def filing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns that follow from a filing's form, dates and numbers."""
    form, filed, ended = F.col("form"), F.col("filed"), F.col("period_end")
    rows = filings(spark, sf_dir).withColumn("kind", fl.period_type(form))
    section = F.when(F.col("o_orderkey") % 2 == 0, "Item 2.02. Results").otherwise("Item 5.02")
    return rows.select(
        "o_orderkey", fl.report_priority(form).alias("report_priority"), F.col("kind").alias("period_type"), fl.fiscal_year(ended, filed, form).alias("fiscal_year"), fl.fiscal_quarter(ended, F.col("kind")).alias("fiscal_quarter"),
        fl.padded_cik(F.col("o_custkey").cast("string")).alias("cik"), fl.filing_id(F.col("ticker"), form, filed, F.col("accession")).alias("doc_id"), fl.dashed_accession(F.col("accession")).alias("accession_fmt"),
        fl.point_id(F.concat("ticker", "accession")).cast("string").alias("point_id"), fl.filed_epoch(filed).alias("filed_ts"), fl.source_class(form, F.col("kind"), section, F.lit("")).alias("source_class"),
    )


@query("""WITH i AS (SELECT o_orderkey, (['2.02,9.01', '5.02', '', '8.01 , 9.01'])[o_orderkey % 4 + 1] AS items, (['q3earnings.htm', 'proxy.htm', 'Release.htm'])[o_orderkey % 3 + 1] AS doc FROM orders)
  SELECT o_orderkey FROM i WHERE CASE WHEN items <> '' THEN list_has_any(string_split_regex(items, '[, ]+'), ['2.02', '7.01', '8.01']) ELSE regexp_matches(lower(doc), 'earnings|result|revenue|financial|quarter|annual|q1|q2|q3|q4|fy|release') END""")
def earnings_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("o_orderkey") % n + 1).cast("int"))
    return read(spark, sf_dir, "orders").where(fl.is_earnings_report(pick(4, "2.02,9.01", "5.02", "", "8.01 , 9.01"), pick(3, "q3earnings.htm", "proxy.htm", "Release.htm"))).select("o_orderkey")


@query("WITH f AS (" + FILINGS_SQL + ") SELECT form, count(*) AS n, min(filed) AS first_filed FROM f WHERE form IN ('10-K', '10-K405', '10-KSB', '10-Q', '8-K') AND filed >= '1998-01-01' GROUP BY form")
def target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).where(fl.is_target(F.col("form"), F.col("filed"), "1998-01-01")).groupBy("form").agg(F.count("*").alias("n"), F.min("filed").alias("first_filed"))


@query("""WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders GROUP BY o_custkey)
  SELECT o_custkey, i - 1 AS position, CAST(k[i] AS VARCHAR) AS accession, CASE WHEN i < len(p) THEN p[i] ELSE '' END AS form FROM (SELECT *, unnest(generate_series(1, len(k))) AS i FROM a)""")
def transpose_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Struct-of-arrays to rows; the second array lacks its last element and counts as padded."""
    both = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    arrays = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(both.alias("x"))
    form = F.transform("x", lambda y: y["o_orderpriority"])
    recent = F.struct(F.transform("x", lambda y: y["o_orderkey"].cast("string")).alias("accession"), F.slice(form, 1, F.size(form) - 1).alias("form"))
    return fl.rows_of_recent(arrays.select("o_custkey", recent.alias("recent")))


@query("""WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders JOIN s ON o_orderkey = l_orderkey))
  SELECT o_orderkey, o_custkey FROM n WHERE rn = 1""")
def anti_join_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    seen = orders.join(read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_custkey").distinct()
    return sinks.unseen(orders, seen, "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, coalesce(CASE WHEN n_nationkey < 20 THEN n_name END, 'Unknown') AS sector FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def sector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sic = read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("sic"), F.col("n_name").alias("sector"))
    return fl.sector_of(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sic")), sic).select("c_custkey", "sector")


@query("""SELECT o_orderkey, url FROM (SELECT o_orderkey, '/a/' || l_linenumber || '/d' || (l_partkey % 3) || '.htm' AS url, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS rn
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE ends_with('/a/' || l_linenumber || '/d' || (l_partkey % 3) || '.htm', 'd' || (o_orderkey % 3) || '.htm')) WHERE rn = 1""")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing's first index document whose address ends in its primary document's name."""
    url = F.concat(F.lit("/a/"), F.col("l_linenumber").cast("string"), F.lit("/d"), (F.col("l_partkey") % 3).cast("string"), F.lit(".htm"))
    primary = F.concat(F.lit("d"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".htm"))
    met = read(spark, sf_dir, "orders").select("o_orderkey", primary.alias("primary")).join(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", url.alias("url")), "o_orderkey").where(F.col("url").endswith(F.col("primary")))
    first = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey")
    return met.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("o_orderkey", "url")


@query("""SELECT l_orderkey, count(*) AS exhibits FROM lineitem WHERE upper((['ex-99.1', 'EX-99.2', 'EX-21', 'ex-13', 'GRAPHIC', 'EX-10.1', 'EX-99'])[(l_linenumber - 1) % 7 + 1]) IN ('EX-99.1', 'EX-99.2', 'EX-99', 'EX-13', 'EX-10.1') GROUP BY l_orderkey""")
def exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with their documents as an array, exploded and filtered by exhibit type."""
    kinds = F.element_at(F.array(*map(F.lit, ("ex-99.1", "EX-99.2", "EX-21", "ex-13", "GRAPHIC", "EX-10.1", "EX-99"))), ((F.col("l_linenumber") - 1) % 7 + 1).cast("int"))
    index = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(kinds.alias("type"))).alias("documents"))
    return index.select("l_orderkey", F.explode("documents").alias("d")).where(F.upper("d.type").isin(*fl.EXHIBIT_TYPES)).groupBy("l_orderkey").agg(F.count("*").alias("exhibits"))


@query("SELECT CAST(o_custkey % 20 AS BIGINT) AS ticker, list(DISTINCT CAST(year(o_orderdate) AS INTEGER) ORDER BY CAST(year(o_orderdate) AS INTEGER) DESC) AS years, max(CAST(year(o_orderdate) AS INTEGER)) AS latest_year FROM orders GROUP BY 1")
def fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year there is, newest first, and the newest, by scope: exact, without an early stop."""
    corpus = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("ticker"), F.year("o_orderdate").alias("fiscal_year"))
    years = corpus.groupBy("ticker").agg(F.reverse(F.array_sort(F.collect_set("fiscal_year"))).alias("years"))
    return years.join(pl.latest_years(corpus), "ticker")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS quarter_no, CASE event_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '2' WHEN 2 THEN 'x' END AS quarter FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties, tolerant whole numbers and normalised quarters."""
    key = F.col("event_id")
    number = F.when(key % 3 == 0, (key % 5).cast("string")).when(key % 3 == 1, "1.5").otherwise("")
    quarter = F.element_at(F.array(*map(F.lit, ("q3", "2", " x ", "  "))), (key % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), fl.safe_int(number).alias("quarter_no"), fl.quarter_text(quarter).alias("quarter"))


@query("SELECT o_custkey AS id, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders, then odd ones upserted over them by customer, and the newest of each kept."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_totalprice").alias("price"))
    old = sinks.upserted(rows.limit(0), rows.where("o_orderkey % 2 = 0"), ["id"], "o_orderkey")
    newer = rows.where("o_orderkey % 2 = 1").join(old.select("id", F.col("o_orderkey").alias("have")), "id", "left").where("have is null or o_orderkey > have").drop("have")
    return sinks.upserted(old, newer, ["id"], "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.without(read(spark, sf_dir, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("""WITH r AS (SELECT l_orderkey AS k, max({'s': l_linenumber, 't': CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'parsed' END}).t AS status FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
  SELECT coalesce(status, 'pending') AS parse_status, count(*) AS n FROM orders LEFT JOIN r ON o_orderkey = k WHERE coalesce(status, 'pending') <> 'parsed' GROUP BY 1""")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written back to the manifest, then what is still to do."""
    manifest = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("pending").alias("parse_status"))
    results = read(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("parsed").alias("status"), F.col("l_linenumber").alias("seq"))
    todo = sinks.pending(sinks.with_status(manifest, results, "parse_status"), None, "parse_status", "parsed")
    return todo.groupBy("parse_status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE c_mktsegment END AS sector, c_name AS company FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enrichment_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of parsed documents filled from the manifest where they are missing."""
    orders = read(spark, sf_dir, "orders")
    parsed = orders.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("sector"))
    known = orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("doc_id"), F.col("c_mktsegment").alias("sector"), F.col("c_name").alias("company"))
    return sinks.filled(parsed, known, ["sector", "company"])


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.incremental import windowed_counts as counts

    return counts(read(spark, sf_dir, "events"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, over all runs."""
    rows = read(spark, sf_dir, "events")
    first = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("event_id", "user_id")
