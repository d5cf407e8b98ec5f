"""Semantics that no SQL shows: small cases with results worked out by hand."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import filings as fl
from millrace.functions import numbers as nu
from millrace.functions import text as tx
from millrace.operators import answer as an
from millrace.operators import chunking as ch
from millrace.operators import context as ctx
from millrace.operators import metrics as me
from millrace.operators import planner as pl
from millrace.operators import retrieval as rt
from millrace.plans import registry
from millrace.operators import tables as tb


def value(spark, column, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(column).first()[0]


def test_fusion_and_order(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    sparse = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    rows = rt.fused_rank(rt.fuse([(dense, 1.0), (sparse, 1.1)]), 10).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [11, 12, 10]
    assert rows[0]["score"] == pytest.approx(1 / 42 + 1.1 / 41)


def test_fusion_keeps_first_seen_on_ties(spark):
    dense = spark.createDataFrame([(1, 20, 1), (1, 10, 2)], "query_id long, id long, rank int")
    rows = rt.fused_rank(rt.fuse([(dense, 0.0)]), 10).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [20, 10]


def test_metrics(spark):
    rows = spark.createDataFrame([([41, 41, 9], [41]), ([1], [])], "found array<int>, gold array<int>")
    got = me.retrieval_metrics(rows, ks=(3,), compat=True).collect()
    assert (got[0]["recall_3"], round(got[0]["precision_3"], 6), got[0]["mrr"]) == (1.0, round(2 / 3, 6), 1.0)
    assert got[0]["ndcg_3"] == pytest.approx(1 + 1 / math.log2(3))
    assert (got[1]["recall_3"], got[1]["ndcg_3"], got[1]["mrr"]) == (1.0, 0.0, 0.0)
    assert me.retrieval_metrics(rows, ks=(3,)).first()["ndcg_3"] == 1.0


@pytest.mark.parametrize(("raw", "compat", "expected"), [("$245.1 billion", False, 2.451e11), ("12 million", False, 1.2e7), ("5 thousand", True, 5e12), ("5 thousand", False, 5e3), ("1,234", False, 1234.0)])
def test_numbers(spark, raw, compat, expected):
    assert value(spark, nu.normal_number(F.lit(raw), compat)) == pytest.approx(expected)


def test_header_scale_backs_an_amount(spark):
    answers = spark.createDataFrame([(1, "It was $245 million, up 7 %."), (2, "It was $246 million.")], "query_id long, answer string")
    context = spark.createDataFrame([(1, "(In millions) Revenue 245 and 7% more"), (2, "(In millions) Revenue 245")], "query_id long, text string")
    assert dict(nu.unsupported_numbers(answers, context).collect()) == {1: [], 2: ["$246 million"]}


def test_citation_range_fits_ends_only(spark):
    answers = spark.createDataFrame([(1, "So [MSFT 10-K FY2024, pp. 40-42] it is")], "query_id long, answer string")
    context = spark.createDataFrame([(1, 0, "c", "MSFT", "10-K", 2024, 41)], "query_id long, place int, chunk_id string, ticker string, form_type string, fiscal_year int, page int")
    row = nu.matched_citations(answers, context).first()
    assert (row["label"], row["matched"]) == ("MSFT 10-K FY2024, p.40-42", False)


@pytest.mark.parametrize(("ended", "filed", "form", "year"), [(None, "2024-02-01", "10-K", 2023), (None, "2024-07-01", "10-K", 2024), (None, "2024-02-01", "10-Q", 2024), ("2022-12-31", "2024-02-01", "10-K", 2022), ("bad", "2024-02-01", "10-Q", 2024)])
def test_fiscal_year(spark, ended, filed, form, year):
    assert value(spark, fl.fiscal_year(F.lit(ended).cast("string"), F.lit(filed), F.lit(form))) == year


@pytest.mark.parametrize(("items", "doc", "kept"), [("2.02,9.01", "x", True), ("5.02", "q3earnings.htm", False), (None, "q3earnings.htm", True)])
def test_earnings(spark, items, doc, kept):
    assert value(spark, fl.is_earnings_report(F.lit(items).cast("string"), F.lit(doc))) is kept


def test_padding_never_cuts(spark):
    assert value(spark, fl.padded_cik(F.lit(" 12345678901 "))) == "12345678901"
    assert value(spark, fl.padded_cik(F.lit("320193"))) == "0000320193"


def test_relaxation():
    filters = {"ticker": "A", "fiscal_year": 2024, "statement_type": "x"}
    assert rt.relaxed_variants(filters) == [filters, {"ticker": "A", "fiscal_year": 2024}, {"ticker": "A", "statement_type": "x"}, {"ticker": "A"}, {}]
    assert rt.relaxed_variants({"ticker": "A"}) == [{"ticker": "A"}, {}]
    assert rt.relaxed_variants({}) == [{}]


def test_header_years_become_a_row():
    assert tb.split_header([["", "2024", "2023"], ["Revenue", "10", "9"]]) == (["", "", ""], [["", "2024", "2023"], ["Revenue", "10", "9"]], [])
    assert tb.split_header([["", "$", "Sales"], ["Item", "", "net"], ["A", "1", "2"]])[0] == ["Item", "", "Sales / net"]


def test_columns_compact():
    assert tb.compact(["Name", "Sales", ""], [["a", "$", "5"], ["b", "", "7"]]) == (["Name", "Sales"], [["a", "5"], ["b", "7"]])
    assert tb.drop_phantoms(["a", "", "b"], [["1", "", "2"]]) == (["a", "b"], [["1", "2"]])


def cells(n):
    return [(f"label {i}", "2024", str(i)) for i in range(n)]


def test_micro_blocks():
    assert ch.micro_blocks(cells(5)) == []
    assert [len(b) for b in ch.micro_blocks(cells(6))] == [6]
    assert [len(b) for b in ch.micro_blocks(cells(9))] == [8]
    assert [len(b) for b in ch.micro_blocks([*cells(3), ("Total:", "", "1"), *cells(3)])] == [3 + 3, 1 + 3 + 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Short one.", "A rather longer sentence; it has clauses: several.", "word " * 40 + ".", "x" * 400]), max_size=40))
def test_prose_chunks_fit(parts):
    for chunk in ch.split_prose(" ".join(parts), most=60, overlap=8):
        assert ch.estimate(chunk) <= 60
        assert len(chunk) >= 50


def test_prose_keeps_every_sentence():
    text = " ".join(f"Sentence number {i} says a little about {i * 7}." for i in range(300))
    chunks = ch.split_prose(text, most=100, overlap=16)
    assert all(any(f"number {i} " in c for c in chunks) for i in range(300))
    assert all(a.split(".")[-2].strip() in b for a, b in zip(chunks, chunks[1:], strict=False))


def test_row_groups():
    groups = ch.row_groups(["x" * 40] * 70, "h", "t")
    assert [len(g) for g in groups] == [30, 30, 10]


FIELDS = ("doc_id", "chunk_type", "citation_key", "text", "page", "ticker", "fiscal_year", "row_label")
SCHEMA = "query_id long, rank long, doc_id string, chunk_type string, citation_key string, text string, page int, ticker string, fiscal_year int, row_label string"


def kept_places(spark, lists, *caps, **options):
    rows = [(q, k, *(c.get(f) for f in FIELDS)) for q, own in enumerate(lists) for k, c in enumerate(own)]
    found = ctx.assemble(spark.createDataFrame(rows, SCHEMA), *caps, **options).collect()
    return [[r["rank"] for r in sorted(found, key=lambda r: r["place"]) if r["query_id"] == q] for q in range(len(lists))]


def test_context_caps(spark):
    rows = [{"doc_id": "d", "chunk_type": "row", "citation_key": "", "text": f"t{i}", "page": i, "ticker": "A", "fiscal_year": 2024, "row_label": f"l{i}"} for i in range(9)]
    assert kept_places(spark, [rows, [rows[0], rows[0]]], 8) == [[0, 1, 2, 3], [0]]


def test_context_caps_against_plain_loops(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    lists = [[{"doc_id": pick("d", "e", None), "chunk_type": pick("row", "prose", None), "citation_key": pick("p.1", None), "text": pick("a  B", "A b ", "c", "d", "e", "f", None), "page": pick(1, 2, None), "ticker": pick("A", "B"), "fiscal_year": pick(2023, None), "row_label": pick("x", "y", "", None)} for _ in range(rng.randint(1, 14))] for _ in range(60)]

    def plain(own, most, per_doc, per_page, diverse):
        said = lambda c: (c["chunk_type"] or "", c["citation_key"] or "", " ".join((c["text"] or "").lower().split()))
        label = lambda c: (c["row_label"] or "") if c["chunk_type"] == "row" else ""
        kept = []
        for capped in (True, False):
            if not capped and len(kept) >= min(most, 4):
                break
            for k, c in enumerate(own):
                held = [own[i] for i in kept]
                if len(kept) >= most or said(c) in map(said, held):
                    continue
                same = lambda *f, held=held, c=c: sum(all(h[x] == c[x] for x in f) for h in held)
                if capped and (same("doc_id") >= per_doc or (c["page"] is not None and same("doc_id", "page") >= per_page)):
                    continue
                if capped and label(c) and any(h["doc_id"] == c["doc_id"] and label(h) == label(c) for h in held):
                    continue
                if capped and len(kept) < most - 2 and sum((h["chunk_type"] or "") == (c["chunk_type"] or "") for h in held) >= max(2, most // 2):
                    continue
                if capped and diverse and same("ticker", "fiscal_year") >= 2:
                    continue
                kept.append(k)
        return kept

    assert kept_places(spark, lists, 6, 3, 2) == [plain(own, 6, 3, 2, False) for own in lists]
    assert kept_places(spark, lists, 8, diverse=True) == [plain(own, 10, 6, 3, True) for own in lists]


def test_sparse_search_uses_every_word(spark):
    rng = random.Random(6)
    words = ["the", "of", "cash", "debt", "tax", "loss"]
    texts = [" ".join(["The"] * rng.randint(0, 3) + rng.choices(words, k=rng.randint(0, 6))) for _ in range(700)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    weights = [{w: 1 + math.log(n) for w, n in Counter((t or "").lower().split()).items()} for t in texts]
    want = []
    for q in range(0, len(texts), 100):
        dots = [(-round(sum(w * weights[i].get(t, 0) for t, w in weights[q].items()), 6), i) for i in range(len(texts)) if i != q]
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(x for x in dots if x[0] < 0)[:7])]
    got = rt.sparse_topk(docs.where("id % 100 = 0"), docs, 7).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(q, i, r) for q, i, _, r in want]
    assert [r["score"] for r in got] == pytest.approx([s for _, _, s, _ in want], abs=1e-6)


def test_sparse_search_by_norms(spark, monkeypatch):
    """Queries in several chunks, long rows that pass first: nothing that a norm rules out belongs to the best."""
    monkeypatch.setattr(rt, "CHUNK", 4)
    rng = random.Random(8)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    texts = [" ".join(x[1] for x in rng.choices(words, k=rng.choice((0, 2, 5, 400)))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = rt.sparse_topk(docs.where("id % 100 = 0"), docs, 4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    weights = [{w: 1 + math.log(n) for w, n in Counter(t.split()).items()} for t in texts]
    want = []
    for q in range(0, len(texts), 100):
        dots = [(-round(sum(w * weights[i].get(t, 0) for t, w in weights[q].items()), 6), i) for i in range(len(texts)) if i != q]
        want += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(x for x in dots if x[0] < 0)[:4])]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect()) == sorted(want)


def test_searches_hold_k_rows(spark):
    """A task gives k rows of each query, however many blocks pass, and pairs of blocks aren't rows."""
    rng = np.random.default_rng(5)
    held = rt._Dense(3)
    row = lambda ids, m: {"ids": pa.scalar(list(ids), pa.list_(pa.int64())), "matrix": pa.scalar(m.tobytes()), "codes": pa.scalar(b"")}
    asked, passing = rng.integers(-2, 3, (20, 4)).astype("<f8"), rng.integers(-2, 3, (600, 4)).astype("<f8")
    held.ask(row(range(20), asked))
    for at in range(0, 600, 50):
        held.meet(row(range(at, at + 50), passing[at : at + 50]))
    got = [tuple(r.values()) for batch in held.found() for r in batch.to_pylist()]
    want = [(q, i, -s) for q in range(20) for s, i in sorted((-float(asked[q] @ passing[i]), i) for i in range(600) if i != q)[:3]]
    assert got == want
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "id long, embedding array<double>")
    assert "Join" not in rt.dense_topk(vectors.where("id % 10 = 0"), vectors, 3)._jdf.queryExecution().optimizedPlan().toString()


def test_approximate_search_finds_most(spark):
    got = registry.queries()["knn_lsh"](spark, "/root/testdata/sf0.01")
    shares = [r["recall"] for r in got.collect()] if "recall" in got.columns else []
    assert shares and min(shares) >= 0.8 and sum(shares) / len(shares) >= 0.9


def test_approximate_search_compares_blocks(spark):
    """Candidates share a bucket; vectors are dealt out once, so copies of one vector don't multiply."""
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.standard_normal((300, 8)), np.tile(rng.standard_normal(8), (40, 1)), np.zeros((2, 8))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    found = rt.lsh_topk(rows.where("id % 50 = 0"), rows, 5, dims=8, tables=4, bits=5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    planes = np.random.default_rng(1).standard_normal((4, 5, 8))
    codes = ((np.einsum("tbd,nd->ntb", planes, vectors) > 0) @ (1 << np.arange(5)))
    norms = np.linalg.norm(vectors, axis=1)
    want = []
    for q in range(0, len(vectors), 50):
        dots = [(-round(float(vectors[q] @ vectors[i] / (norms[q] * norms[i] or 1)), 9), i) for i in range(len(vectors)) if i != q and (codes[q] == codes[i]).any()]
        want += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(dots)[:5])]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect()) == sorted((q, i, r) for q, i, r in want)


def test_prose_chunks_leave_texts_out(spark):
    """Chunks of a long text don't each carry it."""
    text = " ".join(f"Sentence number {i} is about cash." for i in range(900))
    rows = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "short", "c"), (4, text[:300], None)], "doc_id long, text string, tag string")
    slim, whole = ch.prose_chunks(rows, keep=["doc_id"]), ch.prose_chunks(rows)
    assert slim.columns == ["doc_id", "part", "chunk_text"] and whole.columns == ["doc_id", "text", "tag", "part", "chunk_text"]
    want = [(1, i, c) for i, c in enumerate(ch.split_prose(text))] + [(4, 0, text[:300])]
    assert sorted(map(tuple, slim.collect())) == want == sorted((r["doc_id"], r["part"], r["chunk_text"]) for r in whole.collect())


def test_single_questions_move_no_corpus(spark):
    """One question's search deals out neither texts nor vectors, and candidates are picked while reading."""
    chunks = spark.createDataFrame([(i, str(i), "cash debt" if i % 3 else "tax cash cash", [1.0, float(i)]) for i in range(40)], "id long, chunk_id string, text string, embedding array<double>")
    ask = spark.createDataFrame([(-1, "cash", [1.0, 3.0])], "id long, text string, embedding array<double>")
    for found in (rt.dense_topk(ask, chunks, 3), rt.sparse_topk(ask, chunks, 3)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Union" not in plan and [r["rank"] for r in found.orderBy("rank").collect()] == [1, 2, 3]
    assert [r["id"] for r in rt.sparse_topk(ask, chunks, 3).orderBy("rank").collect()] == [0, 3, 6]
    engine = an.Engine(spark, chunks, embed=lambda q: [1.0, 1.0])
    met = engine._met(spark.createDataFrame([(-1, 7), (-1, 9), (-1, 99)], "query_id long, id long"), chunks)
    assert sorted(r["id"] for r in met.collect()) == [7, 9]


def test_document_chunks_are_dealt_by_size(spark, tmp_path):
    """Partitions follow the size of the blocks, so that a task's share doesn't grow with them."""
    spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("t")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ch.partitions_for(rows) == least
    assert ch.partitions_for(rows, 1 << 12) > 4 * ch.partitions_for(rows, 1 << 15) > least
    plan = registry.queries()["document_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 2


def test_pages(spark):
    blocks = spark.createDataFrame([("d", i, "10-K", True, 0) for i in range(400)] + [("e", i, "10-K", True, 0) for i in range(10)] + [("f", 0, "10-K", False, 7)], "doc_id string, block_order int, form_type string, page_is_surrogate boolean, page int")
    got = {(r["doc_id"], r["block_order"]): r["page"] for r in ch.pseudo_pages(blocks).collect()}
    assert (got["d", 4], got["d", 5], got["e", 2], got["e", 3], got["f", 0]) == (1, 2, 1, 2, 7)


def test_plan(spark):
    p = pl.plan(spark, "Compare JPMorgan and Goldman Sachs net income in FY2024.")
    assert (p["tickers"], p["fiscal_years"], p["intent"], p["dense_k"], p["rerank_k"], p["final_k"]) == (["GS", "JPM"], [2024], "cross_company_comparison", 72, 18, 8)
    assert p["filters"] == {"ticker": ["GS", "JPM"], "fiscal_year": 2024, "source_class": "10-K"}
    p = pl.plan(spark, "What of Tesla's energy generation in FY2024?")
    assert (p["tickers"], p["sector"]) == (["TSLA"], "Energy")


def test_widened_plan_shrinks_thematic():
    p = {"intent": "thematic_synthesis", "filters": {"ticker": "A", "fiscal_year": 2024, "sector": "x"}, "dense_k": 90, "sparse_k": 110, "rerank_k": 22, "final_k": 12}
    w = an.widened(p)
    assert (w["filters"], w["dense_k"], w["sparse_k"], w["rerank_k"], w["final_k"]) == ({"sector": "x"}, 110, 120, 25, 10)


def test_headings(spark):
    cases = ["Note 4 - Revenue The Company sells things", "Item 1A. Risk Factors", "Plain text", "Apple Inc. CONDENSED CONSOLIDATED BALANCE SHEETS (Unaudited)"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(tx.short_heading(F.col("t")), tx.statement_title(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("Note 4 - Revenue", None), ("Item 1A. Risk Factors", None), (None, None), (None, "CONDENSED CONSOLIDATED BALANCE SHEETS")]


def test_answer_pipeline(spark):
    from millrace.plans.answers import answer_pipeline

    rows = answer_pipeline(spark, "/root/testdata/sf0.001").collect()
    assert [r["intent"] for r in rows] == ["single_company_factual", "cross_company_comparison"]
    assert all(r["context_count"] > 0 for r in rows)
