"""The corpus pipeline against the stages' brute-force versions."""

from __future__ import annotations

import random

from .conftest import prose, rows_for
from .test_copies import slow_delete, slow_fingerprint, slow_roots


def test_stages_in_order(spark, frame, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item, passage = prose(rng, 40), prose(rng, 70)
    texts = [prose(rng, 150) for _ in range(40)]
    texts += [texts[0], texts[1] + " again", prose(rng, 60) + "\n" + item + "\n" + prose(rng, 60), prose(rng, 80) + "\n" + passage, prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 80)]
    rows = rows_for(texts)
    docs = frame(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    cut = slow_delete(rows)
    roots = slow_roots([slow_fingerprint(t) for _, t in cut])
    kept = [r for k, r in enumerate(cut) if roots[k] == k and item not in r[1]]
    left = frame(rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted(kept)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in kept}
