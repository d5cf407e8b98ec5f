"""Sources, sinks and incremental runs on files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.sources import readers, sinks
from millrace.streaming import incremental


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"doc_id": "a", "fiscal_year": 2024}) + "\n\nnot json\n" + json.dumps({"doc_id": "b"}) + "\n")
    good, bad = readers.json_lines(spark, str(tmp_path / "m.jsonl"), readers.MANIFEST)
    assert sorted(r["doc_id"] for r in good.collect()) == ["a", "b"]
    assert [r["value"] for r in bad.collect()] == ["not json"]


def test_html_blocks(spark):
    page = "<html><script>x<p>no</p></script><h1>A &amp; B</h1><p>one <b>two<p>three</p><ul><li>four</li></ul><p> </p></html>"
    rows = readers.html_blocks(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).orderBy("block_order").collect()
    assert [(r["tag"], r["text"]) for r in rows] == [("h1", "A & B"), ("p", "one two"), ("p", "three"), ("li", "four")]


def test_page_range(spark):
    rows = spark.createDataFrame([([3, 1, 3],), (None,)], "p array<int>").select(readers.page_range(F.col("p")).alias("r")).collect()
    assert [(r["r"]["page_start"], r["r"]["page_end"], r["r"]["pages"]) for r in rows] == [(1, 3, [1, 3]), (1, 1, [1])]


def test_versions(spark, tmp_path):
    base = str(tmp_path / "t")
    sinks.write_version(spark.range(2), base, 1)
    sinks.write_version(spark.range(5), base, 2)
    assert sinks.latest_version(spark, base).count() == 5


def test_schema_problems(spark):
    want = spark.createDataFrame([], "a long, b string").schema
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "a int, v array<double>")
    assert len(sinks.schema_problems(rows, want, "v", 3)) == 3


def test_incremental(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k long, v long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    for rows in ([(1, 1), (2, 1)], [(2, 5), (3, 2)]):
        write(rows)
        incremental.ingest_new(spark, source, schema, str(tmp_path / "c1"), str(tmp_path / "out"), ["k"])
        incremental.upsert_new(spark, source, schema, str(tmp_path / "c2"), str(tmp_path / "base"), ["k"], "v")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 1), (2, 1), (3, 2)]
    assert sorted(map(tuple, sinks.latest_version(spark, str(tmp_path / "base")).collect())) == [(1, 1), (2, 5), (3, 2)]
