"""Chunks of whole documents, figures, context and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import documents as dc
from millrace.operators import tables as tb
from millrace.sources import readers

GRID = [["Net sales by segment", "Year ended 2023", "Year ended 2024"]] + [[f"Segment {c}", f"{i},100", f"{i},200"] for i, c in enumerate("ABCDEFG", 1)]
COVER = [["Title of each class", "Trading symbol"], ["Common stock", "ACME"]]


def test_prose_and_tables_together(spark):
    prose = spark.createDataFrame(
        [("d", 0, 0, "Item 7. Management's discussion and analysis of what happened in the year", None, 1, True), ("d", 3, 0, "A sentence that stands after the table and is long enough to stay.", None, 1, True), ("e", 0, 0, "short", None, 1, True)],
        "doc_id string, block_order int, pos int, text string, own_section string, page int, page_is_surrogate boolean",
    )
    prose = prose.withColumn("own_section", F.when(F.col("block_order") == 0, "MD&A"))
    tables = spark.createDataFrame([(1, "d", 1, GRID, "Consolidated statements of operations"), (2, "d", 2, COVER, "")], "table_id int, doc_id string, block_order int, grid array<array<string>>, table_title string")
    tables = tb.described(tb.structured(tables)).withColumns({"pos": F.lit(0), "own_section": F.lit(None).cast("string"), "page": F.lit(1), "page_is_surrogate": F.lit(True)})
    meta = spark.createDataFrame([("d", "Acme", "ACM", "10-K", 2024, None, "2024-12-31"), ("e", "B", "B", "10-K", 2024, None, None)], "doc_id string, company string, ticker string, form_type string, fiscal_year int, fiscal_quarter int, period_end_date string")
    rows = [r.asDict() for r in dc.document_chunks(prose, tables, meta).orderBy("chunk_index").collect()]
    kinds = [r["chunk_type"] for r in rows]
    assert kinds == ["prose", "table", *["row"] * 14, "micro_block", "prose"] and {r["section"] for r in rows} == {"MD&A"}
    assert [r["chunk_index"] for r in rows] == list(range(18)) and {r["doc_id"] for r in rows} == {"d"}
    assert rows[1]["chunk_text"].startswith("Acme (ACM) | 10-K FY2024 | MD&A\nNet sales by segment | Year ended 2023")
    assert rows[2]["chunk_text"] == "Acme (ACM) | 10-K FY2024 | income_statement | annual | period ended 2024-12-31 | Segment A | Year ended 2023: 1,100"
    assert {r["parent_chunk_id"] for r in rows if r["chunk_type"] in ("row", "micro_block")} == {rows[1]["chunk_id"]}
    assert rows[1]["next_chunk_id"] == rows[17]["chunk_id"] and rows[17]["prev_chunk_id"] == rows[1]["chunk_id"] and rows[2]["next_chunk_id"] is None
    assert "Title of each class" not in " ".join(r["chunk_text"] for r in rows)


def test_payload_has_all_fields(spark):
    row = dc.payloads(spark.createDataFrame([("c", None)], "chunk_id string, ticker string")).first().asDict()
    assert len(row) == 38 and row["ticker"] is None and row["company"] == "" and row["units"] == [] and row["is_cover_page"] is False and row["page"] is None


def test_figures(spark):
    rows = spark.createDataFrame([("Cap", ["Cap", "x", None], "", 3, 4), (None, None, "u", 3, 4), ("", [], None, None, None)], "c string, a array<string>, u string, w int, h int")
    got = [r[0] for r in rows.select(dc.figure_text(*map(F.col, "cauwh"))).collect()]
    assert got == ["Cap | x | [Figure: 3x4px]", "[Figure URI: u]", dc.NO_FIGURE]


def test_results_and_context(spark):
    cases = spark.createDataFrame([("1", "b"), ("2", "b")], "query_id string, bucket string")
    rows = dc.with_results(cases, spark.createDataFrame([("1", "yes", "z")], "query_id string, answer string, bucket string")).orderBy("query_id").collect()
    assert [(r.answer, r.failed, r.bucket) for r in rows] == [("yes", False, "b"), ("Error", True, "b")]
    used = dc.context_used(spark.createDataFrame([("T", "10-K", 2024, 3, "S", "row", "more")], "ticker string, form_type string, fiscal_year int, page int, section string, chunk_type string, text string"))
    assert used.columns == ["ticker", "form", "fy", "page", "section", "type"]


def test_archive_pages(spark, tmp_path):
    (tmp_path / "CIK0000000042-submissions-001.json").write_text('{"accessionNumber": ["a"], "form": ["10-K"], "filingDate": ["2020-01-01"], "primaryDocument": ["x"], "reportDate": [""], "items": [""]}')
    row = readers.archive_pages(spark, str(tmp_path)).first()
    assert row.cik == "0000000042" and row.recent.accessionNumber == ["a"]
