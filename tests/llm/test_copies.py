"""Operators 8 and 9 against brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.linededup import delete_copies, least_windows, lines_of, select
from millrace.llm.simhash import forest_links, gray_rank, keep_one, near_duplicates

from .conftest import prose, rows_for


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_roots(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_texts():
    rng = random.Random(3)
    base = [prose(rng, 400) for _ in range(4)]
    texts = []
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            words[rng.randrange(len(words))] = "changed" + str(i)
        texts.append(" ".join(words))
    return texts


def test_components(frame, odd):
    rows = odd + rows_for(near_texts(), first=50)
    fps = [slow_fingerprint(r[1]) for r in rows]
    roots = slow_roots(fps)
    got = near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    best = {}
    for r, k in zip(rows, roots, strict=True):
        if r[0] is not None:
            best[k] = min(best.get(k, r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", best.get(k)) for r, f, k in zip(rows, fps, roots, strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert len({k for k in roots}) < len(rows) - 20


def test_one_of_each_group_stays(frame, odd):
    rows = odd + rows_for(near_texts(), first=50)
    roots = slow_roots([slow_fingerprint(r[1]) for r in rows])
    best = {}
    for r, k in zip(rows, roots, strict=True):
        best[k] = min(best.get(k, (True, 0)), (r[0] is None, r[0] or 0))
    got = keep_one(frame(rows)).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "row_key", "runs"}
    assert sorted(str(r["doc_id"]) for r in got) == sorted("None" if null else str(i) for null, i in best.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 2**32))
def test_forest_connects_what_pairs_connect(seeds, salt):
    rng = np.random.default_rng(salt)
    fps = np.array(seeds, dtype=np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64))
    fps = np.unique(np.concatenate((fps, near)))
    fps = fps[np.argsort(gray_rank(fps))]
    pairs = {(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and bin(a ^ b).count("1") <= 3}

    def groups(links):
        label = {x: x for x in fps.tolist()}
        for a, b in links:
            a, b = label[a], label[b]
            label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
        return label

    a, b = forest_links(fps, None, 3)
    assert groups(pairs) == groups(zip(a.tolist(), b.tolist(), strict=True))
    assert len(a) < len(fps)
    left, right = fps[::2], fps[1::2]
    a, b = forest_links(left, right, 3)
    assert groups({p for p in pairs if (p[0] in left) != (p[1] in left)}) == groups(zip(a.tolist(), b.tolist(), strict=True))


def test_gray_neighbours_differ_in_a_bit():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def slow_delete(rows, least=50):
    space = " \t\n\r\x0b\x0c"
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    lines = {k: [(i, x.strip(space), len(x.encode().split())) for i, x in enumerate((rows[k][1] or "").split("\n")) if x.encode().split()] for k in order}

    def runs(own):
        for i in range(len(own)):
            n = 0
            for j in range(i, len(own)):
                n += own[j][2]
                if n >= least:
                    yield tuple(x[1] for x in own[i : j + 1]), own[i][0], own[j][0]

    first = {}
    for k in order:
        for content, a, b in runs(lines[k]):
            first.setdefault(content, (rows[k][0], rows[k][1], a, b))
    out = []
    for k, r in enumerate(rows):
        gone = set()
        for content, a, b in runs(lines[k]):
            doc, text, _, end = first[content]
            if (doc, text) != (r[0], r[1]) or a > end:
                gone |= set(range(a, b + 1))
        out.append((r[0], r[1] if not gone else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)))
    return out


def test_line_dedup(frame, odd):
    rng = random.Random(9)
    pool = [prose(rng, n) for n in (3, 8, 12, 20, 26, 30, 55, 60, 80)]
    texts = ["\n".join(rng.choice([*pool, "", prose(rng, 5), prose(rng, 25)]) for _ in range(rng.randint(1, 14))) for _ in range(120)]
    texts += ["\n".join([pool[4]] * 6), pool[7] + "\n" + pool[7], texts[0]]
    rows = odd + rows_for(texts, first=100)
    got = delete_copies(frame(rows), 50)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row_key", "runs"]
    # the lines without a word between two copies may stay
    worded = lambda t: t if t is None else [x for x in t.split("\n") if x.encode().split()]
    assert sorted(str((r["doc_id"], worded(r["text"]))) for r in got.collect()) == sorted(str((i, worded(t))) for i, t in slow_delete(rows))
    report = {r["doc_id"]: r for r in delete_copies(frame(rows), 50, report=True).collect()}
    assert report[100 + len(texts) - 2]["n_deleted_lines"] >= 1


def test_many_copied_lines_cost_in_proportion(frame):
    def seconds(n):
        docs = frame(rows_for(["\n".join(f"line {k} of this text" for k in range(n))] * 2))
        began = time.time()
        got = {r["doc_id"]: r["n_deleted_lines"] for r in delete_copies(docs, 50, report=True).collect()}
        assert got == {0: 0, 1: n}
        return time.time() - began

    seconds(100)
    assert seconds(64_000) < 2.2 * max(seconds(32_000), 3)


def test_windows_select_their_minima():
    rng = random.Random(4)
    for _ in range(50):
        text = "\n".join(prose(rng, rng.randint(1, 30), "ab") for _ in range(rng.randint(0, 40)))
        lines = lines_of(text)
        low = lines["low"].tolist()
        want = {}
        for a, b in least_windows(lines["words"], 50):
            assert lines["words"][a:b].sum() >= 50
            least = min(low[a:b])
            want.setdefault(max(k for k in range(a, b) if low[k] == least), []).append((a, b))
        assert dict(select(lines, 50)) == want


def test_empty_tables(frame):
    assert near_duplicates(frame([])).count() == 0
    assert keep_one(frame([])).count() == 0
    assert delete_copies(frame([])).count() == 0
