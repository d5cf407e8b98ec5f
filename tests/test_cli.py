"""The verbs of the command line, one after another."""

from __future__ import annotations

import json

from millrace.__main__ import main


def test_verbs(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    recent = {"accessionNumber": ["0000320193-24-000123", "0000320193-24-000124"], "form": ["10-K", "8-K"], "filingDate": ["2024-11-01", "2024-11-02"], "primaryDocument": ["a.htm", "b.htm"], "reportDate": ["2024-09-28"], "items": ["", "5.02"]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "320193", "sic": "3571", "filings": {"recent": recent, "files": []}}))
    (tmp_path / "c.csv").write_text("ticker,company,cik\nAAPL,Apple,0000320193\n")
    main(["ingest", "--submissions", at("s.json"), "--companies", at("c.csv"), "--manifest", at("manifest")])
    rows = spark.read.json(at("manifest")).collect()
    assert [(r["doc_id"], r["fiscal_year"]) for r in rows] == [("AAPL_10k_2024-11-01_000123", 2024)]

    page = "<h1>Item 1A. Risk Factors</h1>" + "".join(f"<p>Sentence {i} of this page is long enough to be a chunk of its own.</p>" for i in range(3)) * 2
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(at("pages"))
    main(["parse", "--source", at("pages"), "--out", at("blocks")])
    main(["chunk", "--source", at("blocks"), "--out", at("chunks")])
    chunks = spark.read.parquet(at("chunks")).orderBy("chunk_index").collect()
    assert [r["section"] for r in chunks] == ["Item 1A. Risk Factors"] * 3
    assert chunks[0]["next_chunk_id"] == chunks[1]["chunk_id"]
    main(["index", "--source", at("chunks"), "--out", at("index")])
    main(["index", "--source", at("chunks"), "--out", at("index"), "--version", "2"])
    assert spark.read.parquet(at("index/v000002")).count() == 3

    main(["query", "--q", "Apple revenue in FY2024", "--plan-only"])
    assert json.loads(capsys.readouterr().out)["tickers"] == ["AAPL"]
    (tmp_path / "r.jsonl").write_text(json.dumps({"query_id": "q", "bucket": "b", "found": [1, 2], "gold": [2]}) + "\n")
    main(["evaluate", "--results", at("r.jsonl"), "--out", at("summary")])
    assert {r["bucket"]: r["mrr"] for r in spark.read.json(at("summary")).collect()} == {"b": 0.5, "all": 0.5}
