"""Operators 1 and 5 against the tokenizers library."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.orcids import ids_of, read_ids, round_trip, write_ids
from millrace.llm.packing import dissolve, pack_documents, plan_packs, slots
from millrace.llm.queries import BYTE_BPE, vocabulary
from millrace.llm.wordcoder import WordCoder

from .conftest import prose, rows_for


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(BYTE_BPE))


@pytest.fixture(scope="module")
def words():
    return WordCoder(vocabulary(BYTE_BPE), limit=500)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(alphabet=" \n\t\x1cab'.,1é日-½_　😀Z", max_size=30), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>"])), max_size=4).map("".join), max_size=8))
def test_words_encode_as_texts(words, tokenizer, texts):
    ids, bounds = words.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_hold_every_length_once(histogram):
    packs = plan_packs(histogram, 64)
    placed = Counter()
    for count, lengths in packs:
        assert sum(lengths) <= 64
        for n in lengths:
            placed[n] += count
    assert placed == Counter(histogram)
    assert len(packs) <= 3 * len(histogram)
    table, used = slots(packs)
    assert used == Counter(histogram)
    assert all(own["rank"][0] == 0 for own in table.values())


def test_shortest_pack_first():
    assert sorted(plan_packs({60: 1, 40: 1, 20: 2}, 100)) == [(1, [20, 20]), (1, [60, 40])]
    # the emptiest pack takes the next piece, not the one that it would fill
    assert sorted(plan_packs({70: 1, 50: 1, 30: 1}, 100)) == [(1, [50, 30]), (1, [70])]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20))
def test_what_is_cut_fits_the_gaps(histogram):
    packs = plan_packs(histogram, 64)
    kept, cut = dissolve(packs, 64, 1)
    total = sum(n * sum(x) for n, x in packs)
    assert sum(n * sum(x) for n, x in kept + cut) == total
    assert sum(n * sum(x) for n, x in cut) <= sum(n * (64 - sum(x)) for n, x in kept)
    assert sum(n for n, _ in kept) == -(-total // 64)  # as few sequences as there can be


def check_packing(rows, got, tokenizer):
    want, by_doc, encoded = Counter(), {}, {}
    for p in got:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for r in rows:
        encoded.setdefault(r[0], []).append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k in range(len(ids)):
            want[r[0], k, len(ids)] += 1
        for p in by_doc.get(r[0], []):
            if p["doc_tokens"] == len(ids):
                assert p["ids_crc32"] in {crc(x[p["start"] : p["start"] + p["length"]]) for x in encoded[r[0]]}
    assert Counter((r["doc_id"], r["start"] + k, r["doc_tokens"]) for r in got for k in range(r["length"])) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"], r["padded_length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length, total, padded in sorted(pieces):
            assert offset == at
            at += length
        assert at == total <= 1024
        assert padded == (total if total & (total - 1) == 0 else 1024)
    assert sorted(sequences) == list(range(len(sequences)))
    held = sum(p[0][3] for p in sequences.values())
    return 1 - sum(r["length"] for r in got) / held


def test_packing(frame, odd, tokenizer):
    rng = random.Random(1)
    rows = odd + rows_for([prose(rng, rng.randint(1, 900)) + " <|endoftext|>" * (k % 2) for k in range(60)], first=100)
    got = pack_documents(frame(rows), vocabulary(BYTE_BPE), 0, 1024).collect()
    assert check_packing(rows, got, tokenizer) < 0.03


def test_gaps_are_filled(frame, tokenizer):
    rng = random.Random(2)
    rows = rows_for(["a b " * rng.randint(300, 500) for _ in range(400)])  # no two fit together
    got = pack_documents(frame(rows), vocabulary(BYTE_BPE), 0, 1024).collect()
    assert check_packing(rows, got, tokenizer) < 0.01


def test_orc_round_trip(spark, frame, odd, tokenizer, tmp_path):
    odd = [*odd, (77, "before <|endoftext|> after", None, None, 0, "x", 1)]
    rows = sorted(odd, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    got = sorted(round_trip(frame(odd), vocabulary(BYTE_BPE)).collect(), key=lambda r: r["start"])
    at, want = 0, []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    path = str(tmp_path / "ids.orc")
    write_ids(frame(odd), path, vocabulary(BYTE_BPE))
    found = ids_of(spark, path, [4])
    assert [list(r["ids"]) for r in found.collect()] == [tokenizer.encode("One word.", add_special_tokens=False).ids + [2]] * 2
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^]]*doc_id", plan)
    assert read_ids(spark, path).count() == len(odd)


BIG = 1 << 40  # ids that py4j hands over as Java longs


def test_orc_files_prune(spark, frame, tmp_path):
    """Run-length integers, row indexes and Bloom filters are in the files, and readers skip by them."""
    from pyarrow import orc

    docs = frame(rows_for(["word " * 60] * 12_000)).withColumn("doc_id", F.col("doc_id") * 2 + F.lit(BIG))
    path = str(tmp_path / "ids.orc")
    write_ids(docs, path, vocabulary(BYTE_BPE))
    files = sorted(map(str, (tmp_path / "ids.orc").glob("part-*")))
    assert files
    meta = [orc.ORCFile(f) for f in files]
    assert sum(m.nrows for m in meta) == 12_000
    assert all(m.row_index_stride == 2000 and m.compression == "ZSTD" for m in meta)
    size = sum(len(open(f, "rb").read()) for f in files)
    assert size < 12_000 * 61 * 4 / 20  # a run of equal ids takes a few bytes
    # org.apache.orc's own dump names the streams: ROW_INDEX, BLOOM_FILTER_UTF8 on doc_id, and DIRECT_V2 (RLE v2)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    one = files[0]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(one), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {str(s.getKind()) for s in footer.getStreamsList()}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    assert {str(c.getKind()) for c in footer.getColumnsList()} >= {"DIRECT_V2"}
    # rows that the reader hands over for an id that is there, one that only a Bloom filter can rule out, and one out of range
    seen = lambda i: sum(read_rows(spark, f, i) for f in files)
    assert 0 < seen(BIG + 600) <= 4000
    assert min(seen(BIG + k) for k in range(601, 641, 2)) == 0
    assert seen(BIG + 10**9) == 0


def read_rows(spark, file, doc_id):
    from py4j.java_gateway import get_field

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    leaf = jvm.org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf.Type.LONG
    sarg = jvm.org.apache.hadoop.hive.ql.io.sarg.SearchArgumentFactory.newBuilder().equals("doc_id", leaf, doc_id).build()
    names = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 1)
    names[0] = "doc_id"
    rows = reader.rows(jvm.org.apache.orc.Reader.Options(conf).searchArgument(sarg, names))
    batch, n = reader.getSchema().createRowBatch(), 0
    while rows.nextBatch(batch):
        n += get_field(batch, "size")
    return n


def test_empty_tables(frame):
    assert pack_documents(frame([]), vocabulary(BYTE_BPE)).count() == 0
    assert round_trip(frame([]), vocabulary(BYTE_BPE)).count() == 0
