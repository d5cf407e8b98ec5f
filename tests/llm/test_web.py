"""Operators 6, 7 and 10."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import random
import time
from html.parser import HTMLParser

from millrace.llm.decontam import leaks, remove_contaminated
from millrace.llm.urlfilter import SQL, intervals, match
from millrace.llm.warc import CHUNK, Markup, chunks, derivatives, derive, digest, parse, plain_text, read_records, record, response, write_derivatives, write_responses

from .conftest import prose, rows_for

ITEM = "Mr. and Mrs. live near Paris and drive 120 km to Berlin every week because their friend Anna of Paris sells 40 kg of apples for 12 dollars each"


def bench(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_leaks(spark, frame, odd):
    rng = random.Random(6)
    swapped = ITEM.replace("Paris", "Lyon").replace("Berlin", "Bonn").replace("120", "95").replace("Anna", "Eva").replace("40", "3").replace("12 ", "7 ")
    muddled = ITEM.replace("near Paris", "near Lyon").replace("of Paris", "of Rome")
    other = prose(rng, 40)
    texts = [prose(rng, 50) + "\n" + ITEM + "\n" + prose(rng, 50), "So: " + swapped + ". End.", muddled, prose(rng, 200), " ".join(other.split()[:9]) + " " + prose(rng, 100), other.upper(), "12 13 14 15 16 17 18 19 20 21", ITEM + " " + ITEM]
    rows = odd + rows_for(texts, first=100)
    tests = bench(spark, [ITEM, other, None, "too short", "12 13 14 15 16 17 18 19 20 21", other])
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(frame(rows), tests).collect()}
    assert set(got) == {(100, 0), (101, 0), (105, 1), (105, 5), (107, 0)}
    assert (got[100, 0]["exact"], got[101, 0]["exact"]) == (True, False)
    left = remove_contaminated(frame(rows), tests)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "row_key", "runs"]
    assert {r["doc_id"] for r in left.where("doc_id >= 100").collect()} == {102, 103, 104, 106}
    assert left.count() == len(rows) - 4
    assert leaks(frame([]), tests).count() == 0
    assert leaks(frame(rows), bench(spark, [])).count() == 0


def test_items_of_numbers_and_merged_values(spark, frame):
    sums, short = "What is 12 + 35 x 4 - 7 / 2 + 9 - 81 x 6 now?", "Add 17 to 25."
    basket = "she bought 12 apples and 15 pears at the market before going home"
    rng = random.Random(8)
    rows = rows_for([prose(rng, 30) + "\n" + sums + "\n" + prose(rng, 30), sums.replace("- 7", "- 70"), "So: " + short, "Add 18 to 25.", basket.replace("12", "7").replace("15", "7"), prose(rng, 90)])
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in leaks(frame(rows), bench(spark, [sums, short, basket])).collect()}
    assert got == {(0, 0): True, (2, 1): True, (4, 2): False}


def slow_leaks(rows, items, width=8, min_literal=4, min_share=0.3):
    """Every window of every document against every window of every item, by their words."""
    import regex

    from millrace.llm.decontam import NAME, NUMBER, UNIT

    def tokens(text):
        text = (text or "").replace("§", " ").replace("=", " ")
        text = regex.sub(UNIT, r"\1§U=\2", regex.sub(NUMBER, r"§D=\1", regex.sub(NAME, r"§N=\1", text)))
        return regex.sub(r"[^\p{L}\p{M}\p{N}§=\s]+", "", text).lower().split()

    plain = lambda w: w[:2] if w.startswith("§") else w
    out = {}
    for doc_id, text, *_ in rows:
        own = tokens(text)
        for item_id, item in items:
            words = tokens(item)
            size = min(width, len(words))
            kept, diagonals = set(), {}
            for p in range(len(words) - size + 1 if words else 0):
                window = words[p : p + size]
                literal = sum(not w.startswith("§") for w in window)
                if not literal:
                    continue
                kept.add(p)
                for a in range(len(own) - size + 1):
                    found = own[a : a + size]
                    if (found == window) if literal < min_literal else ([*map(plain, found)] == [*map(plain, window)]):
                        slots = {(i, d) for i, d in zip(window, found, strict=True) if i.startswith("§")}
                        places, pairs = diagonals.setdefault(a - p, (set(), set()))
                        places.add(p)
                        pairs |= slots
            good = [(places, pairs) for places, pairs in diagonals.values() if len({i for i, _ in pairs}) == len(pairs)]
            matched = set().union(*(places for places, _ in good))
            if matched and len(matched) / len(kept) >= min_share:
                out[doc_id, item_id] = (len(kept), len(matched), all(i == d for _, pairs in good for i, d in pairs))
    return out


def test_leaks_against_every_window(spark, frame, odd):
    rng = random.Random(21)
    units = ("km", "kg", "hours", "dollars")

    def question():
        parts = [rng.choice((prose(rng, 2), str(rng.randint(1, 30)), f"{rng.randint(1, 9)} {rng.choice(units)}", rng.choice(("of Anna", "with Bob", "near Rome")))) for _ in range(rng.randint(2, 14))]
        return " ".join(parts)

    def changed(text):
        return " ".join(str(rng.randint(1, 30)) if w.isdigit() and rng.random() < 0.5 else rng.choice(("Eva", "Max")) if w[0].isupper() and rng.random() < 0.5 else w for w in text.split())

    items = [(k, question()) for k in range(25)] + [(25, None), (26, "")]
    texts = [prose(rng, rng.randint(0, 20)) + " " + changed(rng.choice(items[:25])[1]) + " " + prose(rng, rng.randint(0, 20)) for _ in range(80)]
    texts += [" ".join(changed(rng.choice(items[:25])[1]).split()[: rng.randint(3, 12)]) for _ in range(40)]
    rows = [r for r in odd if len(r[1] or "") < 1000] + rows_for(texts, first=100)
    got = {(r["doc_id"], r["item_id"]): (r["item_windows"], r["matched_windows"], r["exact"]) for r in leaks(frame(rows), bench(spark, [t for _, t in items])).collect()}
    want = slow_leaks(rows, items)
    assert got == want and len(want) > 30 and not all(x[2] for x in want.values())


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


ENTRIES = [("bad.example.org", "spam", at(2), True, 1), ("bad.example.org", "spam", at(5), False, 2), ("bad.example.org", "spam", at(9), True, 3), ("example.org", "ads", at(4), None, 4), ("x.com/en", "ads", at(1), True, 5), ("x.com/en", "ads", at(1), False, 6), (None, "ads", at(1), True, 7)]
CAPTURES = [(1, "http://bad.example.org/a", at(1)), (2, "http://bad.example.org/a", at(3)), (3, "HTTPS://u@Bad.Example.org:80?q", at(5)), (4, "http://bad.example.org", at(12)), (5, "http://other.example.org", at(4)), (6, "http://x.com/en/1", at(3)), (7, None, at(3)), (8, "nonsense", at(3)), (9, "http://x.com", None), (2, "http://bad.example.org/a", at(3))]


def frames(spark, captures, entries):
    return spark.createDataFrame(captures, "page_id long, url string, fetched timestamp"), spark.createDataFrame(entries, "pattern string, category string, time timestamp, added boolean, `order` long")


def test_lists_in_force(spark):
    captures, entries = frames(spark, CAPTURES, ENTRIES)
    got = sorted((r["page_id"], r["blocked"], r["n_active"], r["categories"], r["first_pattern"]) for r in match(captures, entries).collect())
    spam = "bad.example.org"
    assert sorted(map(str, got)) == slow_match(CAPTURES, ENTRIES)
    want = [(1, False, 0, "", None), (2, True, 1, "spam", spam), (2, True, 1, "spam", spam), (3, True, 1, "ads", "example.org"), (4, True, 2, "ads,spam", spam), (5, True, 1, "ads", "example.org"), (6, False, 0, "", None), (7, False, 0, "", None), (8, False, 0, "", None), (9, False, 0, "", None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    valid = {(r["category"], r["valid_from"].day, r["valid_to"].day if r["valid_to"] else None, r["listed"]) for r in intervals(entries).collect()}
    assert valid == {("spam", 2, 5, True), ("spam", 5, 9, False), ("spam", 9, None, True), ("ads", 4, None, True), ("ads", 1, None, False)}


def test_deep_paths(spark):
    captures, entries = frames(spark, [(1, "http://a.b.org/x/y/z/w?q", at(3)), (2, "http://b.org/x/y", at(3))], [("b.org/x/y/z", "ads", at(1), True, 1)])
    assert {r["page_id"]: r["blocked"] for r in match(captures, entries).collect()} == {1: True, 2: False}


def slow_match(captures, entries):
    """Every capture against every entry."""
    import re

    state = {}
    for pattern, category, time, added, order in sorted((e for e in entries if None not in e[:3]), key=lambda e: (e[2], e[4], e[3] is not False)):
        state.setdefault((pattern, category), []).append((time, added is not False))
    out = []
    for page, url, fetched in captures:
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(/[^?#]*)?", url or "")
        covers = set()
        if found and fetched:
            labels, path = found[1].lower().split("."), [x for x in (found[2] or "").split("/") if x]
            for k in range(max(0, len(labels) - 6), max(1, len(labels) - 1)):  # no entry here is longer or deeper
                covers |= {"/".join([".".join(labels[k:]), *path[:d]]) for d in range(min(6, len(path)) + 1)}
        hits = []
        for (pattern, category), changes in state.items():
            before = [on for t, on in changes if fetched and t <= fetched]
            if pattern in covers and before and before[-1]:
                hits.append((pattern, category))
        out.append((page, bool(hits), len(hits), ",".join(sorted({c for _, c in hits})), min((p for p, _ in hits), default=None)))
    return sorted(map(str, out))


def test_lists_against_brute_force(spark):
    """Ties in time, repeated entries and captures, clashing columns, very long addresses."""
    rng = random.Random(13)
    hosts = ["a.org", "b.a.org", "c.b.a.org", "x.net", "localhost", "hot.com"]
    when = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.choice((0, 30, 60, 61)) * rng.randint(0, 60))
    entries = [(rng.choice(hosts) + rng.choice(("", "/p", "/p/q")), rng.choice(("ads", "spam", "adult")), when(), rng.random() < 0.6, k) for k in range(150)]
    entries += entries[:20] + [("hot.com", "ads", when(), rng.random() < 0.5, 1000 + k) for k in range(200)]
    captures = [(k, "http://" + rng.choice(hosts) + rng.choice(("", "/p", "/p/q/r", "//p?x")), when()) for k in range(300)]
    captures += captures[:5] + [(900, "http://" + "w." * 3000 + "b.a.org/" + "p/" * 3000, when()), (901, "http://hot.com/" + "long" * 20_000, when()), (902, None, None)]
    c, e = frames(spark, captures, entries)
    c, e = c.selectExpr("*", "'x' as pattern", "1 as capture", "'y' as category"), e.selectExpr("*", "'z' as url", "0 as valid_from", "1 as slice")
    got = match(c, e)
    assert got.columns == ["page_id", "url", "fetched", "blocked", "n_active", "categories", "first_pattern"]
    assert sorted(str((r["page_id"], r["blocked"], r["n_active"], r["categories"], r["first_pattern"])) for r in got.collect()) == slow_match(captures, entries)


def test_empty_lists(spark):
    captures, entries = frames(spark, CAPTURES, [])
    assert not any(r["blocked"] for r in match(captures, entries).collect())
    captures, entries = frames(spark, [], ENTRIES)
    assert match(captures, entries).count() == 0


def test_lists_as_sql(spark):
    import duckdb

    from millrace.llm.queries import op7_url_lists

    c = duckdb.connect()
    for t in ("events", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    key = lambda r: (r["page_id"], r["blocked"], r["n_active"], r["categories"], r["first_pattern"])
    want = c.execute(SQL).df().astype(object).where(lambda d: d.notna(), None).to_dict("records")
    assert sorted(map(str, map(key, op7_url_lists(spark, "/root/testdata/sf0.001").collect()))) == sorted(str(key(r)) for r in want)


HTML = '<!DOCTYPE html><html lang="EN"><head><title>A &amp; B</title><script>var x="<p>";</script></head><body><!-- no --><h1>Head</h1><p>One <b>two</b>\n three<p>a &lt; b</p><a href="/x">link</a></body></html>'


def test_plain_text():
    assert plain_text(HTML) == "Head\nOne two\nthree\na < b\nlink"
    assert plain_text("") == ""


def test_records_parse_back():
    headers, block = response(7, "http://e.org/\r\nX: y", HTML, "2024-01-01T00:00:00Z")
    data = b"".join(record(*r) + b"\r\n\r\n" for r in [(headers, block), *derivatives(headers, block)])
    found = list(parse(data))
    assert [h["WARC-Type"] for h, _ in found] == ["response", "metadata", "conversion"]
    assert all(h["WARC-Block-Digest"] == digest(b) for h, b in found)
    assert {h["WARC-Refers-To"] for h, _ in found[1:]} == {dict(headers)["WARC-Record-ID"]}
    assert b"language: en" in found[1][1] and b"outlink: /x" in found[1][1] and b"source-Content-Type: text/html" in found[1][1]
    assert dict(headers)["WARC-Target-URI"] == "http://e.org/X: y"


def test_markup_costs_its_length():
    def seconds(n):
        began = time.time()
        for unit in (b"<script ", b"<head><script>", b"<!-- ", b"<a href=", b"</title", b"<", b"<p href   "):
            Markup(unit * (n // len(unit)))
        return time.time() - began

    assert seconds(2_000_000) < 7
    assert plain_text("a<script >b") == "ab" and plain_text("<!-- a") == "<!-- a" and plain_text("1 < 2") == "1 < 2"


class Reader(HTMLParser):
    """The same by the standard library's parser."""

    def __init__(self, markup):
        super().__init__()
        self.out, self.links, self.titles, self.lang, self.inside = [], [], [], None, []
        self.feed(markup)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("script", "style", "head", "title"):
            self.inside.append(tag)
        if tag in ("p", "div", "li", "ul", "h1", "br"):
            self.out.append("\n")
        if tag == "a":
            self.links.append(attrs["href"])
        self.lang = attrs.get("lang", self.lang) if tag == "html" else self.lang

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)
        if tag in ("p", "div", "li", "ul", "h1"):
            self.out.append("\n")

    def handle_data(self, data):
        if self.inside[-1:] == ["title"]:
            self.titles.append(data)
        elif not self.inside:
            self.out.append(data)


def pages_at_random(rng, n):
    for k in range(n):
        body = "".join(rng.choice((f"<p>{prose(rng, 5)}</p>", f"<div class='x'>{prose(rng, 3)} &amp; ä<br>b</div>", f'<a class=q href="/{k}?a=1&amp;b">l</a>', "<!-- <p>no</p> -->", "<script>if (a<b) { '<p>' }</script>", "<ul><LI>one<li>two</UL>", " ")) for _ in range(rng.randint(0, 12)))
        yield f'<!doctype html><html lang="De"><head><title>T {k} &lt;</title><style>p{{}}</style></head><body>{body}</body></html>'


def test_derivatives_against_another_parser(spark, tmp_path):
    """Links, digests, headers and texts of every record, from files written and read."""
    rng = random.Random(3)
    rows = [(k, f"http://e.org/{k}", h) for k, h in enumerate(pages_at_random(rng, 60))]
    source, path = str(tmp_path / "r.warc"), str(tmp_path / "d.warc")
    write_responses(spark.createDataFrame(rows, "page_id long, url string, html string"), source)
    write_derivatives(spark, source, path)
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    responses = {r["target_uri"]: r for r in read_records(spark, source).collect()}
    assert len(responses) == len(rows)
    got = read_records(spark, path).collect()
    assert len(got) == 2 * len(rows) and len({r["record_id"] for r in got}) == len(got)
    for r in got:
        k = int(r["target_uri"].rsplit("/", 1)[1])
        payload, block = rows[k][2].encode(), bytes(r["block"])
        want = Reader(rows[k][2])
        assert r["refers_to"] == responses[r["target_uri"]]["record_id"] and r["date"] == responses[r["target_uri"]]["date"]
        assert bytes(responses[r["target_uri"]]["block"]).endswith(b"\r\n\r\n" + payload)
        assert r["source_digest"] == sha(payload) and r["block_digest"] == sha(block) and r["digest_ok"]
        if r["type"] == "conversion":
            assert block.decode().split() == "".join(want.out).split()
        else:
            fields = [x.split(": ", 1) for x in block.decode().splitlines()]
            assert [v for f, v in fields if f == "outlink"] == want.links
            assert ["title", "".join(want.titles)] in fields and ["language", "de"] in fields
            assert ["source-Content-Length", str(len(payload))] in fields and ["source-payload-digest", sha(payload)] in fields


def test_files(spark, tmp_path):
    rows = [(1, "http://a.org/", HTML, "x"), (2, None, None, "x"), (None, "http://b.org", "é\r\n\r\nWARC/1.1\r\n\r\n日本", "x"), (1, "http://a.org/", HTML, "x"), (5, "http://long.org", "<p>word</p>" * 900_000, "x"), (6, "http://last.org", "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    source, path = str(tmp_path / "r.warc"), str(tmp_path / "w.warc")
    write_responses(pages, source)
    write_derivatives(spark, source, path)
    got = read_records(spark, path).collect()
    want = [(dict(h)["WARC-Record-ID"], b) for r in rows for h, b in derivatives(*response(*r[:3], "2024-01-01T00:00:00Z"))]
    assert sorted((r["record_id"], bytes(r["block"])) for r in got) == sorted(want)
    assert all(r["digest_ok"] for r in got)
    write_responses(pages.limit(0), source + "0")
    write_derivatives(spark, source + "0", path + "0")
    assert read_records(spark, path + "0").count() == 0
    assert derive(pages).count() == 2 * len(rows)


def test_files_are_cut_by_bytes():
    records = [b"x" * n for n in (CHUNK - 1, 5, 7, 3 * CHUNK, 2)]
    sizes = [len(b.column(0)[0].as_py()) for b in chunks(iter(records))]
    assert len(sizes) == 3 and max(sizes) < 4 * CHUNK
