"""From question to checked answer: retrieve, verify, widen once, generate, check numbers and citations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import matched_citations, unsupported_numbers
from . import context as ctx
from . import retrieval as rt
from .planner import plan

ABSTENTION = "Insufficient evidence in retrieved documents to answer this question."
FILTER_FIELDS = ("ticker", "company", "form_type", "fiscal_year", "fiscal_quarter", "period_type", "sector", "industry", "source_class", "statement_type")


def verified(context: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, checks: map of check to result, passed) of each plan, by one aggregation of its context (query_id,
    ticker, fiscal_year, form_type, source_class)."""
    seen = context.groupBy("query_id").agg(F.count("*").alias("n"), F.collect_set("ticker").alias("have"), F.collect_set(F.col("fiscal_year").cast("int")).alias("years"), F.collect_set(F.upper(F.coalesce("source_class", "form_type"))).alias("forms"))
    rows = plans.join(seen, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for c, kind in (("have", "string"), ("years", "int"), ("forms", "string")):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(f"array<{kind}>")))
    intent, asked = F.col("intent"), F.size("tickers")
    single, trend = intent == "single_company_factual", intent == "trend_over_time"
    wanted = F.when(F.size("fiscal_years") > 0, F.col("fiscal_years")).when(F.col("latest_year").isNotNull(), F.array("latest_year"))
    same_form = F.exists("source_classes", lambda w: F.exists("forms", lambda f: f.contains(F.upper(w)) | F.upper(w).contains(f)))
    check = lambda name, when, value: F.when(when, F.struct(F.lit(name).alias("key"), F.coalesce(value, F.lit(False)).alias("value")))
    checks = F.array_compact(F.array(
        check("has_context", F.lit(True), F.col("n") > 0),
        check("sufficient_chunks", F.lit(True), F.col("n") >= F.least(F.greatest("final_k", F.lit(2)), F.lit(3))),
        check("all_companies_present", (asked > 0) & (intent == "cross_company_comparison"), F.size(F.array_except("tickers", "have")) == 0),
        check("target_company_present", (asked > 0) & (single | trend), F.arrays_overlap("tickers", "have")),
        check("multi_year", trend, F.size("years") >= 2),
        check("correct_period", single & wanted.isNotNull(), F.arrays_overlap(wanted, "years")),
        check("correct_form", single & (F.size("source_classes") > 0), same_form),
        check("company_diversity", intent == "thematic_synthesis", F.size("have") >= 2),
        check("company_diversity", intent == "investment_opinion", F.size("have") >= F.greatest(F.lit(2), asked)),
    ))
    return rows.select("query_id", F.map_from_entries(checks).alias("checks"), F.forall(checks, lambda c: c["value"]).alias("passed"))


def widened(p: dict) -> dict:
    """The plan for the one further search: no year, no ticker for broad questions, more candidates."""
    drop = {"fiscal_year"} | ({"ticker"} if p["intent"] in ("thematic_synthesis", "investment_opinion") else set())
    more = {"dense_k": (20, 120), "sparse_k": (20, 120), "rerank_k": (5, 25), "final_k": (2, 10)}
    return p | {"filters": {k: v for k, v in p["filters"].items() if k not in drop}} | {k: min(p[k] + add, most) for k, (add, most) in more.items()}


Scorer = Callable[[Column, Column], Column]
Generator = Callable[[str, str, list[str]], str]


def extract(question: str, context: str, reminders: list[str]) -> str:
    """The default generator: the source that shares most words with the question, and its citation."""
    words = set(question.lower().split())
    sources = [s.partition("\n") for s in context.split(ctx.SEPARATOR)]
    head, _, body = max(sources, key=lambda s: len(words & set(s[2].lower().split())))
    label = head[head.find("[") : head.find("]") + 1]
    return f"{body.splitlines()[0] if body else ''} {label}".strip()


@dataclass
class Engine:
    """Answers questions over ``chunks`` (chunk_id, doc_id, text, embedding and metadata) with pluggable models:
    ``embed`` makes a question's vector, ``score`` a reranking score, ``generate`` an answer."""

    spark: SparkSession
    chunks: DataFrame
    embed: Callable[[str], list[float]]
    score: Scorer = rt.token_overlap
    generate: Generator = extract
    fields: tuple[str, ...] = FILTER_FIELDS
    trail: list[str] = field(default_factory=list)

    def search(self, p: dict) -> DataFrame:
        """Candidates of a plan: filtered dense and sparse lists, fused, with the metadata bonus; the first looser
        variant of the filters that has any. Questions on several companies search each and all, best score wins."""
        ids = self.chunks.select(F.xxhash64("chunk_id").alias("id"), "*") if "id" not in self.chunks.columns else self.chunks
        present = tuple(f for f in self.fields if f in ids.columns)
        for filters in rt.relaxed_variants(p["filters"]):
            rows = ids.where(rt.whitelisted(filters, present))
            if not rows.isEmpty():
                break
        names = p["tickers"] if p["retrieval_hints"]["multi_hop"] and len(p["tickers"]) > 1 and "ticker" in present else []
        k = max(18, p["dense_k"] // max(1, len(names))) if names else p["dense_k"]
        passes = [self._pass(rows.where(F.col("ticker") == t), p, k) for t in names] + [self._pass(rows, p, p["dense_k"])]
        return self._met(rt.best_of_passes(passes), rows)

    def _met(self, lists: DataFrame, rows: DataFrame) -> DataFrame:
        """``lists``, which have some hundred rows whatever the corpus, with the ``rows`` of their ids. These are picked
        while reading; a join of what Spark takes for large would deal out all texts and vectors."""
        some = self.spark.createDataFrame(lists.collect(), lists.schema)
        return some.join(rows.where(F.col("id").isin([r["id"] for r in some.select("id").distinct().collect()])), "id")

    def _pass(self, rows: DataFrame, p: dict, k: int) -> DataFrame:
        ask = self.spark.createDataFrame([(-1, p["query"], [float(x) for x in self.embed(p["query"])])], "id long, text string, embedding array<double>")
        dense = rt.dense_topk(ask, rows, k)
        sparse = rt.sparse_topk(ask, rows, k)
        fused = rt.fuse([(dense, rt.DENSE_WEIGHT), (sparse, rt.SPARSE_WEIGHT)])
        scored = self._met(fused, rows).withColumn("score", F.col("score") + rt.pre_bonus(p["flags"], p))
        return scored.select("query_id", "id", "score")

    def rerank(self, p: dict, candidates: DataFrame) -> DataFrame:
        final = self.score(F.lit(p["query"]), rt.reranker_text()) + rt.post_bonus(p["flags"], p)
        order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("score"), "id")
        return candidates.withColumn("final_score", final).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p["rerank_k"])

    def retrieve(self, p: dict) -> DataFrame:
        hints = p["retrieval_hints"]
        slim = self.rerank(p, self.search(p)).drop("embedding")
        return ctx.assemble(slim, p["final_k"], diverse=hints["diverse"], multi_year=hints["multi_year"])

    def ask(self, question: str) -> dict:
        """Answer, citations, unsupported numbers, checks, retries and the plan's facts."""
        p = plan(self.spark, question, self.chunks)
        plans = self.spark.createDataFrame([(-1, p["intent"], p["tickers"], p["fiscal_years"], p["source_classes"], p["latest_year"], p["final_k"])], "query_id long, intent string, tickers array<string>, fiscal_years array<int>, source_classes array<string>, latest_year int, final_k int")
        retries = 0
        while True:
            found = self.retrieve(p)
            context = self.spark.createDataFrame(found.collect(), found.schema)  # ``final_k`` rows
            checks = verified(context, plans).first()
            if checks["passed"] or retries == 2:
                break
            retries += 1  # a second failure is counted and answered as it is
            if retries == 2:
                break
            p = widened(p)
        return {"query": question, "intent": p["intent"], "retries": retries, "checks": checks["checks"], **self.answer(question, context)}

    def answer(self, question: str, context: DataFrame, tries: int = 3) -> dict:
        blocks = context.select("query_id", "place", ctx.source_block(F.col("place")).alias("block"))
        first = ctx.rendered(ctx.within_budget(blocks, 24_000)).first()
        if first is None:
            return {"answer": ABSTENTION, "citations": [], "hallucinated_numbers": [], "context_count": 0}
        missing: list[str] = []
        for _ in range(tries):
            text = self.generate(question, first["context"], missing)
            told = self.spark.createDataFrame([(-1, text)], "query_id long, answer string")
            missing = unsupported_numbers(told, context.select("query_id", "text")).first()["missing"]
            if not missing:
                break
        cited = [r.asDict() for r in matched_citations(told, context).orderBy("place").collect()]
        return {"answer": ABSTENTION if missing else text, "citations": cited, "hallucinated_numbers": missing, "context_count": context.count()}
