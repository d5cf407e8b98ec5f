"""Operators 2, 3 and 4: counts against brute force, models on held-out rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm.common import pieces
from millrace.llm.fertility import judge, keep_fluent, main_script
from millrace.llm.hmm import Model, score_texts
from millrace.llm.langid import identify, keep_identified
from millrace.llm.queries import vocabulary

from .conftest import prose, rows_for

FILES = ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
LETTERS = {"en": "aeiouthrsn", "de": "äöüßchzkgw", "fr": "éèçàquvjlp"}


def spec():
    return [*map(vocabulary, FILES), public_tokenizers.PATTERN]


def test_counts(frame, odd):
    rng = random.Random(2)
    texts = [prose(rng, 12) + " " + "a b c d e " * rng.randint(0, 4) + "\nsame line\n\n same line\nsame line #*$%" for _ in range(20)]
    rows = odd + rows_for(texts, first=50)
    got = sorted(map(tuple, judge(frame(rows), *spec()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((r[0], len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)))
    assert got == sorted(want, key=str)


def test_bands_reject_what_is_odd(frame):
    rng = random.Random(4)
    rows = rows_for([prose(rng, 120) for _ in range(200)] + [" ".join(w + "%%%" for w in prose(rng, 110).split()) for _ in range(4)] + ["☃ ☂ ⚑ " * 3 + prose(rng, 100)])
    got = {r["doc_id"]: r for r in judge(frame(rows), *spec()).collect()}
    assert sum(not got[i]["kept"] for i in range(200)) <= 6
    assert not any(got[i]["kept"] for i in range(200, 204))
    kept = {r["doc_id"] for r in keep_fluent(frame(rows), *spec()).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}


def test_scripts():
    assert [main_script(t) for t in ("abc", "абв", "日本", "123 ", "αβ")] == ["latin", "cyrillic", "han", "none", "greek"]


def language_rows(n=240, wrong=0.15):
    rng = random.Random(8)
    truth = [rng.choice(list(LETTERS)) for _ in range(n)]
    said = [rng.choice([x for x in LETTERS if x != t]) if rng.random() < wrong else t for t in truth]
    return truth, rows_for([prose(rng, rng.randint(20, 60), LETTERS[t]) for t in truth], said)


def test_text_outweighs_wrong_markup(frame):
    truth, rows = language_rows()
    got = {r["doc_id"]: r for r in identify(frame(rows), "doc_id", F.col("lang"), F.col("source")).collect()}
    assert sum(got[i]["language"] == t for i, t in enumerate(truth)) >= 0.99 * len(truth)
    assert all(r["kept"] for r in got.values())


def test_hosts_decide_without_text(frame):
    _, rows = language_rows(wrong=0)
    rows = [(*r[:3], "a.example.de" if r[2] == "de" else "b.example.com", *r[4:]) for r in rows]
    rows += [(900, "", None, "a.example.de", 0, "x", 1), (901, None, "fr", "c.example.com", 0, "x", 1), (902, "12 34", None, "new.example.de", 0, "x", 1)]
    got = {r["doc_id"]: r for r in identify(frame(rows), "doc_id", F.col("lang"), F.col("source")).collect()}
    assert [got[i]["language"] for i in (900, 901, 902)] == ["de", "fr", "de"]
    assert {got[i]["text_language"] for i in (900, 901, 902)} == {"und"}


def test_unknown_languages_go(frame):
    rng = random.Random(9)
    _, rows = language_rows()
    foreign = [prose(rng, 20, "aioltpzvgb") for _ in range(5)] + [prose(rng, 20, "бвгджзклмн") for _ in range(5)] + [prose(rng, 20, "bcdfgjkqwx") for _ in range(5)] + ["12 34", ""]
    rows += [(900 + i, t, None, "src0", len(t), "x", 1) for i, t in enumerate(foreign)]
    kept = {r["doc_id"] for r in identify(frame(rows), "doc_id", F.col("lang"), F.col("source")).where("kept").collect()}
    assert kept == {r[0] for r in rows if r[0] < 900}


def slow_identify(rows, strength=20.0):
    """(id, language, posterior, text language) of each row, one at a time: plain loops over trigrams and rows."""
    buckets = 1 << 14

    def grams(text):
        raw = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in b" " + text.encode() + b"  ")
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(raw) - 2) if raw[i + 1] != 32]

    texts = [grams(r[1] or "") for r in rows]
    said = [r[2] or "-" for r in rows]
    order = Counter(x for x in said if x != "-")
    langs = sorted(order, key=lambda x: (-order[x], x))
    counts = {x: Counter(g for t, d in zip(texts, said, strict=True) if d == x for g in t) for x in langs}
    logs = []
    for t in texts:
        logs.append([sum(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + buckets / 2)) / 3 for g in t) for x in langs])
    by_text = [max(range(len(langs)), key=lambda k, v=v: (v[k], -k)) if t else None for v, t in zip(logs, texts, strict=True)]
    shares = {k: Counter({d: 0.5 for d in [*langs, "-"]}) for k in range(len(langs))}
    for b, d in zip(by_text, said, strict=True):
        if b is not None:
            shares[b][d] += 1
    prior = [sum(shares[k].values()) / sum(sum(s.values()) for s in shares.values()) for k in range(len(langs))]
    hosts = [r[3].lower() if r[3] else "" for r in rows]
    suffix = [h.rsplit(".", 1)[1] if "." in h else "" for h in hosts]

    def smoothed(same, upper):
        n = Counter(b for b, s in zip(by_text, same, strict=True) if s and b is not None)
        return [(n[k] + strength * upper[k]) / (sum(n.values()) + strength) for k in range(len(langs))]

    def cut(k, size):
        full = {}
        for c in range(40):
            fits = sorted(v[k] * 3 / len(t) for v, t, b in zip(logs, texts, by_text, strict=True) if b == k and int(math.log2(len(t))) == c)
            if len(fits) >= 20:
                full[c] = [fits[math.ceil(len(fits) * q) - 1] for q in (0.25, 0.75)]
        chance = -math.log(buckets)
        if not full:
            return chance
        near = min(full, key=lambda c: (abs(c - size), c))
        low, high = full[near]
        return max(chance, min((low + chance) / 2, low - 3 * (high - low) * 2 ** (max(0, near - size) / 2)))

    out = []
    for i, r in enumerate(rows):
        p = smoothed([h == hosts[i] and s == suffix[i] for h, s in zip(hosts, suffix, strict=True)], smoothed([s == suffix[i] for s in suffix], prior))
        total = [logs[i][k] + math.log(shares[k][said[i]] / sum(shares[k].values())) + math.log(p[k]) for k in range(len(langs))]
        top = max(total)
        unknown = 1.0 if by_text[i] is None else math.exp(min(500, len(texts[i]) * cut(by_text[i], int(math.log2(len(texts[i])))) / 3 - max(logs[i])))
        posterior = 1 / sum(math.exp(x - top) for x in total) / (1 + unknown)
        out.append((r[0], langs[total.index(top)], posterior, "und" if by_text[i] is None else langs[by_text[i]]))
    return out


def test_fusion_against_plain_loops(frame):
    _, rows = language_rows(n=120)
    rows = [(*r[:3], rng_host(i), *r[4:]) for i, r in enumerate(rows)]
    rows += [(500, "", "de", "a.de", 0, "x", 1), (501, None, None, None, 0, "x", 1), (502, "xyz", "fr", "new.fr", 3, "x", 1), (503, "aei ou", None, "a.de", 3, "x", 1), rows[0]]
    got = sorted(map(tuple, identify(frame(rows), "doc_id", F.col("lang"), F.col("source")).select("doc_id", "language", "posterior", "text_language").collect()))
    for have, want in zip(got, sorted(slow_identify(rows)), strict=True):
        assert (have[0], have[1], have[3]) == (want[0], want[1], want[3])
        assert have[2] == pytest.approx(want[2], rel=1e-6)


def rng_host(i):
    return ("a.de", "b.de", "c.fr", "d.example.com", None)[i % 5]


def test_every_declared_language_is_modelled(frame):
    rng = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tags = ["q" + a + b for a in "abcdefgh" for b in letters][:90]
    alphabets = {t: "".join(rng.sample(letters, 6)) for t in tags}
    rows = rows_for([prose(rng, 60, alphabets[t]) for t in tags for _ in range(3)], [t for t in tags for _ in range(3)])
    got = {r["doc_id"]: r["language"] for r in identify(frame(rows), "doc_id", F.col("lang"), F.col("source")).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.95 * len(rows)
    with pytest.raises(ValueError, match="declared languages"):
        identify(frame(rows), "doc_id", F.col("lang"), F.col("source"), max_languages=64)


def test_pages(spark):
    from millrace.llm.queries import pages_langid

    got = pages_langid(spark, "/root/testdata/sf0.01")
    assert got.columns == ["page_id", "language", "posterior", "text_language", "declared", "n_trigrams", "kept"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/pages.parquet").count()
    assert sum(r["kept"] for r in rows) > 0.9 * len(rows)
    sure = [r for r in rows if r["declared"] != "-"]
    assert sum(r["language"] == r["declared"] for r in sure) > 0.8 * len(sure)


def test_language_edges(frame, odd):
    assert keep_identified(frame([])).count() == 0
    nothing = frame([(1, "text", None, None, 4, "x", 1)])
    assert keep_identified(nothing).count() == 0
    clash = frame([(1, "text", "en", "a.org", 4, "x", 1)]).selectExpr("*", "'h' as host", "1 as declared", "2 as suffix", "3 as logs", "4 as language")
    assert identify(clash, "doc_id", F.col("lang"), F.col("source")).count() == 1 and keep_identified(clash).columns == clash.columns
    _, rows = language_rows()
    kept = keep_identified(frame(rows + odd))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row_key", "runs"]
    assert kept.count() >= len(rows)


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    model = Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2).T)
    strings = [np.array(s) for s in ([0, 1, 2, 1], [2], [1, 1, 0])]
    for s, got in zip(strings, model.log_likelihood(strings), strict=True):
        total = 0.0
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert got == pytest.approx(math.log(total))


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(1)
    strings = [rng.choice(4, 60, p=p) for p in ([0.45, 0.45, 0.05, 0.05], [0.05, 0.05, 0.45, 0.45]) for _ in range(20)]
    weights = np.full(4, 0.25)
    model, seen = Model.first_guess(weights, 2), []
    for _ in range(8):
        starts, moves, emissions, total = model.expected(strings)
        assert starts.sum() == pytest.approx(len(strings))
        assert moves.sum() == pytest.approx(sum(len(s) - 1 for s in strings))
        assert emissions.sum() == pytest.approx(sum(map(len, strings)))
        seen.append(total)
        model = model.improved(starts, moves, emissions, weights)
    assert all(b > a - 0.5 for a, b in zip(seen, seen[1:], strict=False))
    assert seen[-1] > seen[0] + 100


def slow_scores(rows, states, rounds, n_words, n_endings):
    """Every score by enumeration of all state paths: training counts, Baum-Welch rounds, and the probabilities."""
    end = b" "
    docs = [([*(r[1] or "").encode().lower().split(), end], zlib.crc32(str(r[0]).encode()) % 7 == 2) for r in rows]
    count = Counter(t for own, out in docs if not out for t in own)
    top = sorted((w for w in count if w != end), key=lambda w: (-count[w], w))[: n_words - 1]
    symbol = {w: k for k, w in enumerate(top)} | {end: n_words - 1}
    of = lambda w: symbol.get(w, n_words + zlib.crc32(w[-3:]) % n_endings)
    size = n_words + n_endings
    mass, kinds = Counter(), Counter()
    for w, c in count.items():
        mass[of(w)] += c
        kinds[of(w)] += 1
    weights = np.array([mass[k] + 1 for k in range(size)]) / sum(mass[k] + 1 for k in range(size))
    model = Model.first_guess(weights, states)

    def paths(s):
        for path in itertools.product(range(states), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            yield path, p

    for _ in range(rounds):
        starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        for own, out in docs:
            if out:
                continue
            s = [of(w) for w in own]
            every = list(paths(s))
            total = sum(p for _, p in every)
            for path, p in every:
                starts[path[0]] += p / total
                for t, k in enumerate(path):
                    emissions[s[t], k] += p / total
                    if t:
                        moves[path[t - 1], k] += p / total
        model = model.improved(starts, moves, emissions, weights)
    out = []
    for (own, _), r in zip(docs, rows, strict=True):
        inner = sum(math.log10((count[w] + 1) / (mass[of(w)] + kinds[of(w)] + 1)) for w in own if of(w) >= n_words)
        out.append((r[0], math.log10(sum(p for _, p in paths([of(w) for w in own]))) + inner))
    return sorted(out)


@pytest.mark.parametrize("split", [400_000, 3])
def test_scores_by_enumeration(frame, monkeypatch, split):
    from millrace.llm import hmm

    monkeypatch.setattr(hmm, "SPLIT", split)  # parts of a few words too
    rng = random.Random(14)
    vocabulary = prose(rng, 12).split()
    rows = rows_for([" ".join(rng.choices(vocabulary, k=rng.randint(0, 5))) for _ in range(40)])
    got = sorted((r["doc_id"], r["score"]) for r in score_texts(frame(rows), states=2, rounds=2, n_words=5, n_endings=4).collect())
    for have, want in zip(got, slow_scores(rows, 2, 2, 5, 4), strict=True):
        assert have[0] == want[0] and have[1] == pytest.approx(want[1], abs=1e-9)


def test_the_alphabet_grows(frame):
    rows = rows_for(["one two three", "four five six", "one six", "rare"] * 6)
    got = sorted((r["doc_id"], r["score"]) for r in score_texts(frame(rows), states=2, rounds=1, n_words=2, n_endings=1, min_count=4).collect())
    count = Counter(t for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2 for t in r[1].split())
    own = sum(c >= 4 for c in count.values()) + 1 + (sum(zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows) >= 4)
    for have, want in zip(got, slow_scores(rows, 2, 1, own, 1), strict=True):
        assert have[0] == want[0] and have[1] == pytest.approx(want[1], abs=1e-9)


def test_word_numbers_use_four_bytes():
    from millrace.llm.hmm import _numbers, _planes

    numbers = np.array([0, 255, 2**24 - 1, 2**24, 2**31])
    assert _numbers(_planes(numbers)).tolist() == numbers.tolist()


def test_scores(frame, odd):
    rng = random.Random(12)
    known = {k: prose(rng, 60, v).split() for k, v in LETTERS.items()}
    texts = [" ".join(rng.choices(known[k], k=rng.randint(10, 60))) for k in rng.choices(list(LETTERS), k=240)]
    rows = odd + rows_for(texts, first=1000)
    got = score_texts(frame(rows), states=4, rounds=4, n_words=64, n_endings=32).collect()
    tokens = [([*(r[1] or "").encode().lower().split(), b" "], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2, r[0]) for r in rows]
    count = Counter(t for own, out, _ in tokens if not out for t in own)
    total, kinds = sum(count.values()), len(count)
    want = sorted(((i, out, len(own), sum(count[t] > 0 for t in own), total, round(sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in own), 4)) for own, out, i in tokens), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == want
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert score_texts(frame([])).count() == 0


def test_pieces_are_bounded():
    """Slices of a batch by bytes as well as rows, so that arrays made of them are bounded."""
    texts = ["a" * 40, None, "b" * 500, "", *["c"] * 30, "d" * 100]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["n", "text"])
    for part in (batch, batch.slice(1)):
        got = list(pieces(part, "text", rows=8, size=100))
        assert [x for p in got for x in p.column("n").to_pylist()] == part.column("n").to_pylist()
        assert all(p.num_rows == 1 or p.num_rows <= 8 and sum(len(t or "") for t in p.column("text").to_pylist()) <= 100 for p in got)
