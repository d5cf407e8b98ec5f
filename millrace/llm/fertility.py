"""Operator 2: quality rules from tokeniser fertility.

Two public vocabularies measure each text. The byte-level one gives characters per token and the entropy of the
text's tokens (in parts of the most that as many tokens can have); the one with byte fallback gives the share of
tokens that are single bytes. Each is measured on words, every distinct word being encoded once per worker process.
For each language (for texts without one, for the main script) the quartiles of each measure over all documents that
pass the base rules make a band, and documents outside a band are rejected.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, row_key, text_or_empty

#: Measures with the width of a histogram bin and the least slack of a band on either side.
MEASURES = {"chars_per_token": (0.005, 0.0), "byte_fallback_share": (0.001, 0.02), "token_entropy": (0.001, 0.0)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: First code points of scripts, in order; a text without a language is judged with texts of its main script.
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "japanese"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other"))


class WordMeter:
    """Distinct words with their token counts; at most ``limit`` words are kept between batches."""

    def __init__(self, byte_level: str, byte_fallback: str, pattern: str, limit: int = 700_000):
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_level, "rb"))}
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=byte_fallback)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.n_pieces, self.n_bytes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.limit:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            texts = [w.decode("utf-8", "replace") for w in new]
            ids = [self.encode(" " + t) for t in texts]
            pieces = self.pieces.encode(texts, num_threads=1)
            sizes = np.array([len(x) for x in pieces], dtype=np.int32)
            marks = self.is_byte[np.fromiter(chain.from_iterable(pieces), np.int64, sizes.sum())]
            sums = np.concatenate(([0], np.cumsum(marks)))
            ends = np.cumsum(sizes)
            self.n_pieces = np.concatenate((self.n_pieces, sizes))
            self.n_bytes = np.concatenate((self.n_bytes, (sums[ends] - sums[ends - sizes]).astype(np.int32)))
            lengths = np.array([len(x) for x in ids])
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lengths)))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, lengths.sum())))
            for w in new:
                self.index[w] = len(self.index)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


_METERS: dict[tuple, WordMeter] = {}


def meter(*spec: str) -> WordMeter:
    if spec not in _METERS:
        _METERS[spec] = WordMeter(*spec)
    return _METERS[spec]


def _codes(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """For each text the number of its words in windows of five words that it holds twice or more. Exact: windows
    are numbered by doubling (pairs, pairs of pairs, then the fifth word)."""
    out = np.zeros(n_docs, np.int64)
    n = len(words) - width + 1
    if n <= 0:
        return out
    shift = np.int64(1) << 32
    two = _codes(words[:-1] * shift + words[1:])
    four = _codes(two[:-2] * shift + two[2:])
    five = _codes(four[:n] * shift + words[4:])
    inside = np.flatnonzero(doc[:n] == doc[width - 1 :])
    _, window, count = np.unique(doc[inside] * shift + five[inside], return_inverse=True, return_counts=True)
    starts = inside[count[window] >= 2]
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[starts + k] = True
    return np.bincount(doc[covered], minlength=n_docs)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(marks)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def main_script(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    place = np.searchsorted([a for a, _ in SCRIPTS], points, side="right") - 1
    place = place[(place >= 0) & ~np.isin(points, np.arange(0x5B, 0x61))]
    names = [s for _, s in SCRIPTS]
    if not len(place):
        return "none"
    count = {s: 0 for s in names}
    for k, n in enumerate(np.bincount(place, minlength=len(names))):
        count[names[k]] += int(n)
    return max(sorted(count), key=count.get)


def measure_texts(texts: list[bytes], m: WordMeter) -> dict[str, np.ndarray]:
    """Counts and measures of each text."""
    n = len(texts)
    size = np.array([len(t) for t in texts])
    bounds = np.concatenate(([0], np.cumsum(size)))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    out = {"word_chars": _per_text((_LEAD & ~_SPACE)[raw], bounds), "n_symbols": _per_text(_SYMBOL[raw], bounds)}
    split = [t.split() for t in texts]
    out["n_words"] = np.array([len(x) for x in split], dtype=np.int64)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup, dtype=np.int64)
    words = m.look_up([*chain.from_iterable(split)])
    doc = np.repeat(np.arange(n), out["n_words"])
    out["n_repeat_words"] = repeated_words(words, doc, n)
    lengths = m.starts[words + 1] - m.starts[words]
    tokens = np.bincount(doc, weights=lengths, minlength=n)
    pieces = np.bincount(doc, weights=m.n_pieces[words], minlength=n)
    lone = np.bincount(doc, weights=m.n_bytes[words], minlength=n)
    at = np.concatenate(([0], np.cumsum(lengths)))
    ids = m.ids[np.repeat(m.starts[words] - at[:-1], lengths) + np.arange(at[-1])].astype(np.int64)
    key, count = np.unique((np.repeat(doc, lengths) << 32) + ids, return_counts=True)
    spread = np.bincount(key >> 32, weights=count * np.log2(count), minlength=n)
    some = np.maximum(tokens, 2)
    out["chars_per_token"] = out["word_chars"] / np.maximum(tokens, 1)
    out["byte_fallback_share"] = lone / np.maximum(pieces, 1)
    out["token_entropy"] = np.where(tokens >= 2, (np.log2(some) - spread / some) / np.log2(some), 1.0)
    return out


def measures(docs: DataFrame, key: str, byte_level: str, byte_fallback: str, pattern: str) -> DataFrame:
    """doc_id, ``key``, band, the counts and the measures of each row of ``docs``."""
    names = [*COUNTS, *MEASURES]
    schema = f"doc_id long, `{key}` string, band string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in MEASURES)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                texts = part.column(2).cast(pa.large_binary()).to_pylist()
                got = measure_texts(texts, meter(byte_level, byte_fallback, pattern))
                band = [x if x else "script " + main_script(t.decode("utf-8", "replace")) for x, t in zip(part.column(3).to_pylist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(band, pa.string()), *(pa.array(got[n]) for n in names)], ["doc_id", key, "band", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key), text_or_empty().alias("text"), lang.alias("lang"))
    return rows.mapInArrow(run, schema)


def bands(measured: DataFrame, down: float, up: float, least: int) -> DataFrame:
    """For each band, size class and measure its bounds: ``down`` quartile distances under the first quartile and
    ``up`` over the third, and the measure's slack. Groups of under ``least`` documents have none; band "*" stands
    for all documents of a size class, size class -1 for all sizes of a band."""
    bins = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / w).alias("bin")) for m, (w, _) in MEASURES.items()])
    rows = measured.where("not base_failed").select("band", "size_class", F.explode(bins).alias("x")).select("band", "size_class", "x.measure", "x.bin")
    own = rows.groupBy("band", "size_class", "measure", "bin").agg(F.count("*").alias("n"))
    every = own.groupBy("size_class", "measure", "bin").agg(F.sum("n").alias("n")).withColumn("band", F.lit("*"))
    any_size = own.groupBy("band", "measure", "bin").agg(F.sum("n").alias("n")).withColumn("size_class", F.lit(-1).cast("long"))
    counts = own.unionByName(every).unionByName(any_size)
    group = Window.partitionBy("band", "size_class", "measure")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select("band", "size_class", "measure", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("all"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin")))
    found = placed.groupBy("band", "size_class", "measure").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max("all").alias("n")).where(F.col("n") >= least)
    width = F.create_map(*[F.lit(x) for m, (w, _) in MEASURES.items() for x in (m, w)])[F.col("measure")]
    slack = F.create_map(*[F.lit(x) for m, (_, s) in MEASURES.items() for x in (m, s)])[F.col("measure")]
    far = (F.col("q3") - F.col("q1")) * width
    bounds = F.struct((F.col("q1") * width - far * down - slack).alias("low"), ((F.col("q3") + 1) * width + far * up + slack).alias("high"))
    return found.groupBy("band", "size_class").pivot("measure", list(MEASURES)).agg(F.first(bounds))


def judge(docs: DataFrame, byte_level: str, byte_fallback: str, pattern: str, down: float = 2.0, up: float = 4.0, least: int = 30, key: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, kept, the measures, and in ``reasons`` the
    measures outside their bands.

    Null text has no words and fails the base rules (under 10 words, or over a fifth of them repeated). Null or empty
    lang: the text's main script stands for it. Measures lean on a text's length, so each band has its size classes
    (half doublings of the token count); a class of under ``least`` documents takes the bounds of all languages, if
    these are too few too those of all sizes of the band, and else none. Equal rows are judged one by one; other columns are ignored; an empty table gives
    no rows.
    """
    own = key or "row_key"
    keyed = docs if key else docs.withColumn("row_key", F.lit(""))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    tokens = F.greatest(F.col("word_chars") / F.greatest("chars_per_token", F.lit(1e-9)), F.lit(1.0))
    marked = measures(keyed, own, byte_level, byte_fallback, pattern).withColumn("base_failed", failed).withColumn("size_class", F.floor(2 * F.log2(tokens)))
    measured = materialise(marked, "measures")
    found = materialise(bands(measured, down, up, least), "bands")
    named = lambda side: [F.col(m).alias(f"{m}_{side}") for m in MEASURES]
    joined = measured.join(found.where("band <> '*'").select("band", "size_class", *named("own")), ["band", "size_class"], "left")
    joined = joined.join(found.where("band = '*'").select("size_class", *named("all")), "size_class", "left")
    joined = joined.join(found.where("band <> '*' and size_class = -1").select("band", *named("any")), "band", "left")

    def outside(m: str) -> Column:
        bounds = F.coalesce(f"{m}_own", f"{m}_all", f"{m}_any")
        return F.when((F.col(m) < bounds["low"]) | (F.col(m) > bounds["high"]), F.lit(m))

    judged = joined.withColumn("reasons", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[outside(m) for m in MEASURES]))))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return judged.select("doc_id", *([key] if key else []), *COUNTS, "base_failed", "kept", *MEASURES, "reasons")


def keep_fluent(docs: DataFrame, byte_level: str, byte_fallback: str, pattern: str, **options: float) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns."""
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key())
    kept = judge(keyed, byte_level, byte_fallback, pattern, key=key, **options).where("kept").select(key).distinct()
    return keyed.join(kept, key, "left_semi").select(*docs.columns)
