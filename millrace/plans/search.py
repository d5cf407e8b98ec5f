"""Queries: dense, sparse and hybrid search, fusion, rescoring, relaxation, quantisation, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as ctx
from ..operators import metrics as me
from ..operators import retrieval as rt
from .registry import query
from .tables import filings, hybrid_corpus, read

KNN_SQL = """
  SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS s
  FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id {and_}"""


def _ask(rows: DataFrame, id_col: str) -> DataFrame:
    """The stated queries of a search: every row whose id is divisible by 100."""
    return rows.where(F.col(id_col) % 100 == 0)


@query("WITH s AS (" + KNN_SQL.format(and_="") + "), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 10")
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return rt.dense_topk(_ask(vectors, "vec_id"), vectors, 10, "vec_id").withColumn("score", F.round("score", 6))


@query("WITH s AS (" + KNN_SQL.format(and_="AND q.label = c.label") + "), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-filtered search: only rows with the query's own label, so the filter comes before the limit."""
    vectors = read(spark, sf_dir, "embeddings")
    return rt.dense_topk(_ask(vectors, "vec_id"), vectors, 10, "vec_id", group="label").withColumn("score", F.round("score", 6))


@query("WITH g AS (" + KNN_SQL.format(and_="AND q.label = c.label") + "), a AS (" + KNN_SQL.format(and_="") + """),
  p AS (SELECT *, 0 AS pass, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM g UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) FROM a),
  m AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY s DESC, pass) AS rn FROM p WHERE r <= 10)
  SELECT query_id, id, round(s, 6) AS score, pass FROM m WHERE rn = 1""")
def multi_hop_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    asked = _ask(vectors, "vec_id")
    own, every = rt.dense_topk(asked, vectors, 10, "vec_id", group="label"), rt.dense_topk(asked, vectors, 10, "vec_id")
    return rt.best_of_passes([own, every]).withColumn("score", F.round("score", 6))


POSTINGS_SQL = """p AS (SELECT id, token, 1 + ln(count(*)) AS w FROM (SELECT doc_id AS id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) AS token FROM {docs}) WHERE token <> '' GROUP BY id, token),
  s AS (SELECT q.id AS query_id, c.id, round(sum(q.w * c.w), 6) AS s FROM p q JOIN p c USING (token) WHERE q.id % 100 = 0 AND q.id <> c.id GROUP BY ALL)"""


@query("WITH " + POSTINGS_SQL.format(docs="documents") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) SELECT query_id, id, round(s, 4) AS score, rank FROM r WHERE rank <= 10")
def sparse_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return rt.sparse_topk(_ask(docs, "id"), docs, 10).withColumn("score", F.round("score", 4))


@query("WITH h AS (SELECT doc_id, text FROM documents JOIN embeddings ON doc_id = vec_id), " + POSTINGS_SQL.format(docs="h") + """,
  d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s
        FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT doc_id FROM h) AND b.vec_id IN (SELECT doc_id FROM h)),
  l AS (SELECT query_id, id, 0 AS list, 1.0 AS w, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM d
        UNION ALL SELECT query_id, id, 1, 1.1, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) FROM s),
  f AS (SELECT query_id, id, round(sum(w::DOUBLE / (40 + rank)), 9) AS score, min(list * 1000 + rank) AS seen FROM l WHERE rank <= 36 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM f)
  SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core query: dense and sparse lists of 36, fused by weighted reciprocal ranks, the best ten."""
    corpus = hybrid_corpus(spark, sf_dir)
    asked = _ask(corpus, "id")
    dense, sparse = rt.dense_topk(asked, corpus, 36), rt.sparse_topk(asked, corpus, 36)
    fused = rt.fused_rank(rt.fuse([(dense, rt.DENSE_WEIGHT), (sparse, rt.SPARSE_WEIGHT)]), 10)
    return fused.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query()
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search, with the exact list's share as recall of each query."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = _ask(vectors, "vec_id")
    near = rt.lsh_topk(asked, vectors, 10, dims=64, tables=40, bits=5, id_col="vec_id")
    exact = rt.dense_topk(asked, vectors, 10, "vec_id").select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(near.select("query_id", "id", "rank"), ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.col("rank").isNotNull().cast("int")).alias("recall"))


@query("""WITH b AS (SELECT quantile_cont(abs(x), 0.99) AS bound FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings))
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(round(least(greatest(x / bound, -1), 1) * 127) AS INTEGER)) AS codes FROM embeddings, b""")
def quantise_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.quantise(read(spark, sf_dir, "embeddings")).select("vec_id", "codes")


#: Chunks that filings stand for, as candidates of a search.
CANDIDATES_SQL = """SELECT o_orderkey AS id, (['prose', 'row', 'table', 'micro_block'])[o_orderkey % 4 + 1] AS chunk_type, CASE WHEN o_orderkey % 5 = 0 THEN '8-K' WHEN o_orderkey % 2 = 0 THEN '10-K' ELSE '10-Q' END AS source_class,
  (['income_statement', 'segment_table', 'other_table'])[o_orderkey % 3 + 1] AS statement_type, CASE WHEN o_orderkey % 2 = 0 THEN 'annual' ELSE 'quarterly' END AS period_type, o_orderkey % 2 + 1 AS report_priority,
  (['Total revenue', 'Cost of revenue', 'Net income', ''])[o_orderkey % 4 + 1] AS row_label, year(o_orderdate) AS fiscal_year, CASE WHEN o_orderkey % 7 = 0 THEN [CAST(year(o_orderdate) + 1 AS VARCHAR)] ELSE [] END AS periods, 'T' || o_custkey % 50 AS ticker, CAST(o_custkey % 5 AS VARCHAR) AS sector FROM orders"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, pick = F.col("o_orderkey"), lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("o_orderkey") % n + 1).cast("int"))
    year = F.year("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        key.alias("id"), pick(4, "prose", "row", "table", "micro_block").alias("chunk_type"), F.when(key % 5 == 0, "8-K").when(key % 2 == 0, "10-K").otherwise("10-Q").alias("source_class"),
        pick(3, "income_statement", "segment_table", "other_table").alias("statement_type"), F.when(key % 2 == 0, "annual").otherwise("quarterly").alias("period_type"), (key % 2 + 1).alias("report_priority"),
        pick(4, "Total revenue", "Cost of revenue", "Net income", "").alias("row_label"), year.alias("fiscal_year"), F.when(key % 7 == 0, F.array((year + 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("periods"),
        F.concat(F.lit("T"), (F.col("o_custkey") % 50).cast("string")).alias("ticker"), (F.col("o_custkey") % 5).cast("string").alias("sector"),
    )


PLAN = {"query": "total revenue by segment", "fiscal_years": [1997, 1998], "retrieval_hints": {"prefer_source_classes": ["10-K"], "prefer_statement_types": ["segment_table"]}}
FLAGS = {"numeric": True, "annual": True, "latest": True, "trend": True}


@query("WITH c AS (" + CANDIDATES_SQL + """) SELECT id,
  round(CASE WHEN chunk_type IN ('row', 'table', 'micro_block') THEN 0.12 ELSE 0 END + CASE WHEN statement_type IN ('income_statement', 'segment_table') THEN 0.08 ELSE 0 END + CASE WHEN source_class = '10-K' THEN 0.12 + 0.10 ELSE 0 END
  + CASE WHEN period_type = 'annual' THEN 0.06 ELSE 0 END + CASE WHEN report_priority = 1 AND source_class = '10-K' THEN 0.05 WHEN report_priority = 2 AND source_class = '10-Q' THEN 0.04 ELSE 0 END
  + CASE WHEN statement_type = 'segment_table' THEN 0.08 ELSE 0 END + CASE WHEN len(periods) > 0 THEN 0.03 ELSE 0 END + CASE WHEN row_label = 'Total revenue' THEN 0.15 ELSE 0 END, 6) AS pre,
  round(CASE chunk_type WHEN 'row' THEN 0.20 WHEN 'prose' THEN 0 ELSE 0.14 END + CASE WHEN source_class = '10-K' THEN 0.26 ELSE 0 END
  + CASE WHEN fiscal_year IN (1997, 1998) THEN 0.12 WHEN list_has_any(periods, ['1997', '1998']) THEN 0.06 ELSE 0 END, 6) AS post FROM c""")
def metadata_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("id", F.round(rt.pre_bonus(FLAGS, PLAN), 6).alias("pre"), F.round(rt.post_bonus(FLAGS, PLAN), 6).alias("post"))


@query("WITH c AS (" + CANDIDATES_SQL + """), t AS (SELECT id, ticker, fiscal_year, CASE WHEN ticker = 'T7' AND statement_type = 'none' AND fiscal_year = 1990 THEN 0 WHEN ticker = 'T7' AND fiscal_year = 1990 THEN 1
  WHEN ticker = 'T7' AND statement_type = 'none' THEN 2 WHEN ticker = 'T7' THEN 3 ELSE 4 END AS variant FROM c) SELECT id, ticker, fiscal_year, variant FROM t WHERE variant = (SELECT min(variant) FROM t)""")
def filter_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter without hits, relaxed to the first variant that has any."""
    rows = rt.first_satisfied(candidates(spark, sf_dir), {"ticker": "T7", "fiscal_year": 1990, "statement_type": "none"}, ("ticker", "fiscal_year", "sector", "source_class", "statement_type"))
    return rows.select("id", "ticker", "fiscal_year", "variant")


@query("WITH c AS (" + CANDIDATES_SQL + ") SELECT id FROM c WHERE ticker IN ('T1', 'T2') AND source_class = '10-K'")
def filter_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"ticker": ["T1", "T2"], "source_class": "10-K", "sector": "", "industry": None, "unknown": 1}
    return candidates(spark, sf_dir).where(rt.whitelisted(filters, ("ticker", "source_class", "sector", "fiscal_year"))).select("id")


@query("""WITH c AS (SELECT d.doc_id, i.item_id, list_distinct(list_filter(string_split_regex(lower(i.text), '[^a-z0-9]+'), lambda x: x <> '')) AS q, list_distinct(list_filter(string_split_regex(lower(d.text), '[^a-z0-9]+'), lambda x: x <> '')) AS t
  FROM documents d JOIN benchmark i ON d.doc_id % (SELECT count(*) FROM benchmark) = i.item_id) SELECT doc_id, item_id, round(len(list_intersect(q, t)) / len(q), 6) AS score FROM c""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default reranker on pairs of documents and benchmark texts."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ask"))
    pairs = read(spark, sf_dir, "documents").join(items, F.col("doc_id") % max(1, items.count()) == F.col("item_id"))
    return pairs.select("doc_id", "item_id", F.round(rt.token_overlap(F.col("ask"), F.col("text")), 6).alias("score"))


@query("""WITH d AS (SELECT doc_id, text, [ (doc_id * 7 + i * 13) % 50 for i in range(20) ] AS found, [ (doc_id * 3 + i * 11) % 50 for i in range(doc_id % 4) ] AS gold FROM documents),
  p AS (SELECT doc_id, found, gold, unnest([5, 10, 20]) AS k FROM d),
  m AS (SELECT doc_id, k, CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_filter(gold, lambda g: list_contains(found[1:k], g))) / len(gold) END AS recall, len(list_filter(found[1:k], lambda x: list_contains(gold, x))) / k AS precision FROM p)
  SELECT doc_id, k, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = me.retrieval_metrics(judged(spark, sf_dir))
    each = F.array(*[F.struct(F.lit(k).alias("k"), *[F.round(f"{m}_{k}", 6).alias(m) for m in ("recall", "precision", "f1")]) for k in (5, 10, 20)])
    return rows.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists and gold pages that follow from a document's number."""
    numbers = lambda n, a, b: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (F.col("doc_id") * a + i * b) % 50)
    return read(spark, sf_dir, "documents").select("doc_id", "lang", numbers(F.lit(20), 7, 13).alias("found"), numbers((F.col("doc_id") % 4).cast("int"), 3, 11).alias("gold"))


@query("""WITH d AS (SELECT doc_id, [ (doc_id * 7 + i * 13) % 50 for i in range(20) ] AS found, [ (doc_id * 3 + i * 11) % 50 for i in range(doc_id % 4) ] AS gold FROM documents),
  u AS (SELECT doc_id, gold, unnest(found) AS x, generate_subscripts(found, 1) AS r FROM d), h AS (SELECT doc_id, any_value(gold) AS gold, x, min(r) AS r FROM u WHERE list_contains(gold, x) GROUP BY doc_id, x),
  g AS (SELECT doc_id, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) AS dcg, min(r) AS first FROM h GROUP BY doc_id)
  SELECT d.doc_id, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg / list_sum([1 / log2(i + 2) for i in range(len(list_distinct(gold)))]), 0), 6) AS ndcg_10 FROM d LEFT JOIN g USING (doc_id)""")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    return rows.select("doc_id", F.round(me.reciprocal_rank(F.col("found"), F.col("gold")), 6).alias("mrr"), F.round(me.ndcg_at(F.col("found"), F.col("gold"), 10), 6).alias("ndcg_10"))


@query("""WITH d AS (SELECT lang, [ (doc_id * 7 + i * 13) % 50 for i in range(20) ] AS found, [ (doc_id * 3 + i * 11) % 50 for i in range(doc_id % 4) ] AS gold FROM documents),
  m AS (SELECT lang, CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_filter(gold, lambda g: list_contains(found[1:10], g))) / len(gold) END AS recall_10, len(list_filter(found[1:10], lambda x: list_contains(gold, x))) / 10 AS precision_10 FROM d)
  SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, round(avg(recall_10), 6) AS recall_10, round(avg(precision_10), 6) AS precision_10, count(*) AS n FROM m GROUP BY GROUPING SETS ((lang), ())""")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.means(me.retrieval_metrics(judged(spark, sf_dir), ks=(10,)), ["recall_10", "precision_10"], "lang")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5")
def sample_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.first_of_bucket(read(spark, sf_dir, "documents").select("doc_id", "source"), 5, "source", "doc_id")


@query()
def context_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each customer's filings under all caps, diverse."""
    rows = candidates(spark, sf_dir).join(filings(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("query_id"), "form"), "id")
    chunks = rows.select("query_id", F.col("id").alias("rank"), F.col("form").alias("doc_id"), "chunk_type", F.lit("p.1").alias("citation_key"), F.concat("row_label", F.lit(" "), F.col("id").cast("string")).alias("text"), (F.col("id") % 3).cast("int").alias("page"), "ticker", "fiscal_year", "row_label")
    return ctx.assemble(chunks, 8, diverse=True).select("query_id", "rank", "place")


@query("""WITH b AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, repeat('x', CAST(200 + o_orderkey % 300 AS INTEGER)) AS block FROM orders),
  t AS (SELECT query_id, place, sum(length(block) + 6) OVER (PARTITION BY query_id ORDER BY place) - 6 AS total_chars FROM b) SELECT query_id, place, CAST(total_chars AS BIGINT) AS total_chars FROM t WHERE total_chars <= 2000""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    blocks = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), place.alias("place"), F.expr("repeat('x', cast(200 + o_orderkey % 300 as int))").alias("block"))
    return ctx.within_budget(blocks, 2000).select("query_id", "place", "total_chars")


@query("""WITH c AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, CAST(o_orderkey AS VARCHAR) AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN 'row' ELSE 'table' END AS chunk_type,
    CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '1997' END AS col_header, CAST(o_orderkey // 2 AS VARCHAR) AS parent FROM orders),
  a AS (SELECT query_id, parent AS chunk_id, min(place) AS asked FROM c WHERE chunk_type = 'row' AND col_header = '' GROUP BY ALL), n AS (SELECT a.* FROM a ANTI JOIN c ON a.query_id = c.query_id AND a.chunk_id = c.chunk_id),
  f AS (SELECT n.query_id, n.chunk_id, 'table' AS chunk_type, 0 AS part, asked AS spot FROM n JOIN c ON n.chunk_id = c.chunk_id AND c.chunk_type = 'table' UNION ALL SELECT query_id, chunk_id, chunk_type, 1, place FROM c)
  SELECT query_id, chunk_id, chunk_type, row_number() OVER (PARTITION BY query_id ORDER BY part, spot, chunk_id) - 1 AS place FROM f""")
def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    context = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), place.alias("place"), key.cast("string").alias("chunk_id"), F.when(key % 3 == 0, "row").otherwise("table").alias("chunk_type"), F.when(key % 2 == 0, "").otherwise("1997").alias("col_header"), F.floor(key / 2).cast("string").alias("parent_chunk_id"))
    return ctx.with_parents(context, context)
