"""The pipeline's near copies against all pairs."""

from __future__ import annotations

import random

from .conftest import prose, rows_for


def slow_kept(rows, width=5):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if sets[i] == sets[j] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {rows[k][0] for k in set(root)}


def test_near_copies_are_found(spark, frame, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    line = prose(rng, 30)
    texts = ["", None, "one", "one two three", "One two three"]
    for _ in range(25):
        words = prose(rng, rng.randint(20, 200)).split()
        texts.append(" ".join(words) + " " + line)
        for edits in (1, 2, 3, 4, 6):
            own = list(words)
            for _ in range(edits):
                own[rng.randrange(len(own))] = prose(rng, 1, "xyz") + "q"
            texts.append(" ".join(own) + " " + line)
    rows = rows_for(texts)
    docs = frame(rows).select("doc_id", "text", "lang", "source", "n_chars")
    left = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == slow_kept(rows)
    assert corpus_pipeline.near_copies(spark, docs.limit(0), str(tmp_path)).count() == 0


def within(fps, plan):
    """All pairs of fingerprints within the radius that share a node of any table."""
    import numpy as np

    from millrace.llm.similar import _dealt
    from millrace.llm.simhash import gray_rank

    prefix, tables, radius = plan
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    near = (bits[:, None, :] != bits[None, :, :]).sum(axis=2) <= radius
    meet = np.zeros_like(near)
    for t in range(tables):
        codes = np.ascontiguousarray(np.packbits(bits[:, _dealt(t)], axis=1)).view(">u8").ravel().astype(np.uint64)
        node = gray_rank(codes) >> np.uint64(64 - prefix)
        meet |= node[:, None] == node[None, :]
    return {(i, j) for i, j in zip(*np.nonzero(near & meet), strict=True) if i < j}


def test_nodes_of_any_size_are_whole(spark):
    import numpy as np

    from millrace.llm import similar

    rng = np.random.default_rng(4)
    # a crowd about one fingerprint, thin pairs about others
    bits = [rng.integers(0, 2, 256, dtype=np.uint8) for _ in range(60)]
    bits += [b ^ (rng.random(256) < 0.1).astype(np.uint8) for b in bits] + [bits[0] ^ (rng.random(256) < p).astype(np.uint8) for p in (0.08, 0.12, 0.16) for _ in range(60)]
    fps = np.unique(np.packbits(np.stack(bits), axis=1, bitorder="little"), axis=0)
    number = {f.tobytes(): k for k, f in enumerate(fps)}
    table = spark.createDataFrame([(bytearray(f.tobytes()),) for f in fps], "fp binary")
    plan = similar.plan_tables(len(fps), 80)
    want = within(fps, plan)
    for node, hold in ((similar.NODE, similar.HELD), (16, 40), (3, 1)):
        pairs, crowds = similar.candidates(table, len(fps), 80, node, hold)
        ends = lambda r: tuple(sorted(number[bytes(x)] for x in r))
        found = {ends(r) for r in pairs.collect()}
        assert found <= want
        packs = [[number[bytes(r["members"][k : k + 32])] for k in range(0, len(r["members"]), 32)] for r in crowds.collect()]
        assert want <= found | {tuple(sorted((i, j))) for own in packs for i in own for j in own}
        # of a crowd all pairs that are not known to be connected are looked at
        labels = spark.createDataFrame([(bytearray(f.tobytes()), bytearray(f.tobytes()[:16]), False) for f in fps], "fp binary, root binary, mixed boolean")
        assert want <= found | {ends(r) for r in similar.crowd_pairs(crowds, labels, plan[2]).collect()}


def test_crowds_lose_no_link(spark, frame, tmp_path):
    """Documents that resemble each other, few of which are copies: nearest pairs of fingerprints are not the links."""
    import numpy as np

    import corpus_pipeline
    from millrace.llm import similar

    rng = random.Random(17)
    words = prose(rng, 60).split()
    texts = []
    for _ in range(120):
        own = list(words)
        for _ in range(rng.choice((1, 2))):
            own[rng.randrange(len(own))] = prose(rng, 1, "xyz") + "q"
        texts.append(" ".join(own))
    texts = list(dict.fromkeys(texts))
    sets = [similar.shingles(t.encode()) for t in texts]
    fps = np.stack([similar.wide_fingerprint(s) for s in sets])
    alike = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    root = list(range(len(texts)))
    for i, j in within(fps, similar.plan_tables(len(fps), 80)) | {(i, j) for j in range(len(texts)) for i in range(j) if (fps[i] == fps[j]).all()}:
        if alike(i, j):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    left = corpus_pipeline.near_copies(spark, frame(rows_for(texts)), str(tmp_path))
    assert {r["doc_id"] for r in left.collect()} == set(root)


def test_sets_with_one_fingerprint(spark, monkeypatch):
    """Sets that share a fingerprint with an unlike one are held against its partners, and each other, too."""
    from millrace.llm import similar

    rng = random.Random(2)
    first, second = prose(rng, 40), prose(rng, 40)
    texts = [first, second, first + " xq", second + " xq", second + " yq", prose(rng, 40)]
    rows = spark.createDataFrame(rows_for(texts), "doc_id long, text string, lang string, source string, n_chars long, row_key string, runs int")
    plain = similar.wide_fingerprint
    same = {similar.shingles(t.encode()).tobytes() for t in texts[:5]}
    one = plain(similar.shingles(texts[0].encode()))
    monkeypatch.setattr(similar, "wide_fingerprint", lambda hashes: one if hashes.tobytes() in same else plain(hashes))
    keep = similar.keep_one_similar(rows, 5, 80)
    assert {r["doc_id"] for r in keep.collect()} == {0, 1, 5}


def test_key_marks(spark):
    from pyspark.sql import functions as F

    from millrace.llm.common import key_marks, row_key

    keys = spark.range(3000).select(row_key("id").alias("key"), "id")
    hit = keys.where(key_marks(keys.where("id < 1000"))(F.col("key"))).select("id").collect()
    assert {r["id"] for r in hit} >= set(range(1000)) and len(hit) < 1020
    assert keys.where(key_marks(keys.limit(0))(F.col("key"))).count() == 0
    edges = spark.createDataFrame([(x * 4,) for x in ("00000000", "00007fff", "00008000", "007fffff", "ffffffff")], "key string")
    assert edges.where(key_marks(edges)(F.col("key"))).count() == 5


def test_sketches_bound_the_difference():
    """A sketch rules out no pair that is similar, whatever the sizes."""
    import numpy as np

    from millrace.llm import similar

    rng = np.random.default_rng(6)
    sets = [np.zeros(0, np.uint64)]
    for n in (1, 2, 15, 16, 17, 33, 100, 130, 1000, 5000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for share in (0, 0.05, 0.2, 0.5):
            sets.append(np.unique(np.concatenate((base[rng.random(n) >= share / 2], rng.integers(0, 2**64, int(n * share), dtype=np.uint64)))))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = similar.sketches_apart([similar.sketch(s) for s in sets], i, j)
    truly = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (apart <= truly).all()
    sizes = np.array([len(s) for s in sets])
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    unlike = (180 * truly > 30 * (small + large)) & (small >= 100) & (100 * small >= 80 * large)
    assert unlike.any() and (180 * apart > 20 * (sizes[i] + sizes[j]))[unlike].all()


def test_alike_documents_are_no_pairs(spark, frame, tmp_path, monkeypatch):
    """Documents that resemble each other without being copies aren't joined two by two, and the copies among them stay linked."""
    import corpus_pipeline
    from millrace.llm import similar

    rng = random.Random(23)
    words = prose(rng, 120).split()
    texts = []
    for k in range(260):
        own = list(words)
        for at in rng.sample(range(5, 115), 1 if k % 20 == 0 else 3):
            own[at] = prose(rng, 1, "xyz") + "q"
        texts.append(" ".join(own))
    rows = rows_for(texts)
    plain, made = similar.materialise, []

    def noted(df, tag, *more):
        stored = plain(df, tag, *more)
        if tag == "rest":
            made.append(stored.count())
        return stored

    monkeypatch.setattr(similar, "materialise", noted)
    left = corpus_pipeline.near_copies(spark, frame(rows), str(tmp_path))
    assert {r["doc_id"] for r in left.collect()} == slow_kept(rows)
    assert sum(made) <= len(rows)
