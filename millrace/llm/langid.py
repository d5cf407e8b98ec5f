"""Operator 3: language identification by Bayesian evidence fusion.

Four kinds of evidence give log-probabilities for each language, and their sum the posterior:

* the text: a naive Bayes model over hashed letter trigrams, with counts of all rows by declared language. Trigrams
  overlap threefold, so their log-likelihood counts for a third;
* the declared (markup) language: how often rows whose text speaks for a language declare each language, or none;
* the address: priors of the host, smoothed by those of its suffix, smoothed by those of the whole table;
* no language at all: a text whose trigrams fit its best language worse than nearly all rows of that language and
  length do, or that has no letters, is more likely of an unknown language, which takes its share of the posterior.

Everything is counted over the whole table by grouped aggregation. Every declared language is modelled, by ``BUCKETS``
numbers. A table that declares more than ``max_languages`` is refused, so that the model's size has a bound and no
language is left out in silence; hosts can be many and meet their rows by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, pieces, row_key, text_or_empty

BUCKETS = 1 << 14
FULL_CLASS = 20  # rows of one language and length that make a band of fits
NONE = "-"  # no declared language

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams (words padded by spaces) and each text's bounds in them."""
    raw = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b"  ", np.uint8)].astype(np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 2)))
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    codes = ((a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(2654435761)) >> np.uint32(18)
    real = b != 32  # with a letter in the middle
    before = np.concatenate(([0], np.cumsum(real)))
    return codes[real].astype(np.int64), before[np.minimum(starts, len(real))]


def declared_language(col: Column) -> Column:
    """The primary subtag in lower case, or NONE."""
    tag = F.lower(F.regexp_extract(F.coalesce(col.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,8})", 1))
    return F.when(tag == "", NONE).otherwise(tag)


def host_and_suffix(address: Column) -> tuple[Column, Column]:
    """Host of a URL or bare host name, and its last label if it has several."""
    text = F.lower(F.coalesce(address.cast("string"), F.lit("")))
    host = F.regexp_extract(text, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return host, F.regexp_extract(host, r"\.([^.]+)$", 1)


def count_trigrams(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Trigram counts (languages x BUCKETS) of ``rows`` (text, declared)."""
    number = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def held() -> Iterator[pa.RecordBatch]:
            for language, own in sums.items():
                bucket = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), language, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(own[bucket])], ["language", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for part in pieces(batch, "text"):
                codes, bounds = trigrams(part.column(0).cast(pa.large_binary()).to_pylist())
                kind = np.array([number.get(x, -1) for x in part.column(1).to_pylist()])
                where = np.repeat(kind, np.diff(bounds))
                for k in np.unique(kind[kind >= 0]).tolist():
                    sums[k] = sums.get(k, 0) + np.bincount(codes[where == k], minlength=BUCKETS)
                if len(sums) > 256:
                    yield from held()
        yield from held()

    found = rows.select("text", "declared").mapInArrow(run, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    got = found.toArrow()  # BUCKETS rows for each language at most
    counts = np.zeros((len(languages), BUCKETS))
    counts[got["language"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return counts


def likelihoods(rows: DataFrame, counts: np.ndarray, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``rows`` with ``n_trigrams`` and ``logs``, the text's tempered log-likelihoods."""
    table = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)) / 3
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                codes, bounds = trigrams(part.column("text").cast(pa.large_binary()).to_pylist())
                logs = np.empty((part.num_rows, len(shared.value)))
                for k, own in enumerate(shared.value):
                    sums = np.concatenate(([0.0], np.cumsum(own[codes])))
                    logs[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * logs.shape[1])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(offsets, pa.array(logs.ravel()))], [*kept, "n_trigrams", "logs"])

    schema = rows.select(*kept).schema.add("n_trigrams", T.LongType()).add("logs", T.ArrayType(T.DoubleType()))
    return rows.select(*kept, "text").mapInArrow(run, schema)


def least_fits(texts: DataFrame, size: int, reach: float = 3.0) -> list[list[float]]:
    """For each language and each power of two of trigrams: the mean log-probability of a trigram at which a text is as
    likely of an unknown language. It lies ``reach`` interquartile ranges under the first quartile of the rows that
    speak for the language, at least halfway from there to chance, and never under chance. Classes of few rows take the next full one's, shorter texts with a
    wider band; languages without a full class have chance alone."""
    fit = F.array_max("logs") * 3 / F.col("n_trigrams")
    quartiles = F.percentile_approx(fit, [0.25, 0.75], 10_000)
    rows = texts.where("by_text is not null").groupBy("by_text", F.floor(F.log2("n_trigrams")).cast("int").alias("length")).agg(F.count("*").alias("n"), quartiles.alias("q"))
    full: list[dict[int, list[float]]] = [{} for _ in range(size)]
    for r in rows.where(F.col("n") >= FULL_CLASS).collect():  # 40 for each language at most
        full[r["by_text"] - 1][r["length"]] = r["q"]
    chance = -float(np.log(BUCKETS))
    cuts = [[chance] * 40 for _ in range(size)]
    for own, known in zip(cuts, full, strict=True):
        for k in range(40 if known else 0):
            near = min(known, key=lambda c: (abs(c - k), c))
            low, high = known[near]
            own[k] = max(chance, min((low + chance) / 2, low - reach * (high - low) * 2 ** (max(0, near - k) / 2)))
    return cuts


def _spread(counts: DataFrame, by: list[str], size: int) -> DataFrame:
    """``by`` columns and ``n``, an array of counts by language, of ``counts`` (by, by_text, n)."""
    listed = counts.groupBy(*by, "by_text").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("by_text", "n"))).alias("m"))
    return listed.select(*by, F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("n"))


def identify(docs: DataFrame, key: str, declared: Column, address: Column, text: str = "text", least_posterior: float = 0.6, accepted: list[str] | None = None, max_languages: int = 1024, strength: float = 20.0) -> DataFrame:
    """A row for each row of ``docs``: its ``key`` column, language, posterior, text_language (by the text alone),
    declared, n_trigrams and kept.

    A row is kept if its posterior reaches ``least_posterior`` and its language is one of ``accepted`` (all if None).
    Without letters in its text (null, empty) the declared language and the host decide alone which language is
    likeliest, but an unknown one is as likely as all of them together. Null declared
    languages and addresses are evidence of their own kind. Without any declared language in the table every row is
    "und" and none is kept. More than ``max_languages`` declared ones are a ValueError. Equal rows are judged one by
    one; ties go to the language declared most often. Other columns don't matter, whatever their names; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    host, suffix = host_and_suffix(address)
    rows = docs.select(F.col(key).alias("row_key"), text_or_empty(text).alias("text"), declared_language(declared).alias("declared"), host.alias("host"), suffix.alias("suffix"))
    said = rows.where(F.col("declared") != NONE).groupBy("declared").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "declared").limit(max_languages + 1).collect()
    languages = [r["declared"] for r in said]
    size = len(languages)
    if size > max_languages:
        raise ValueError(f"over {max_languages} declared languages; give a cleaner declared column or a larger max_languages")
    if not size:
        return rows.select(F.col("row_key").alias(key), F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_language"), "declared", F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("kept"))
    slim = materialise(likelihoods(rows, count_trigrams(rows, languages), ["row_key", "declared", "host", "suffix"]), "likelihoods")
    best = lambda c: F.array_position(c, F.array_max(c)).cast("int")
    texts = slim.withColumn("by_text", F.when(F.col("n_trigrams") > 0, best(F.col("logs"))))

    place_of = {x: k for k, x in enumerate([*languages, NONE])}
    shares = np.full((size, size + 1), 0.5)  # what rows of a language declare: each language, or none
    for r in texts.where("by_text is not null").groupBy("by_text", "declared").agg(F.count("*").alias("n")).collect():  # languages squared at most
        shares[r["by_text"] - 1, place_of[r["declared"]]] += r["n"]
    said_logs = np.log(shares / shares.sum(1, keepdims=True))
    prior = shares.sum(1) / shares.sum()
    # two tables of at most ``max_languages`` rows with as many numbers
    evidence = spark.createDataFrame([(x, said_logs[:, k].tolist()) for x, k in place_of.items()], "declared string, declared_logs array<double>")
    names = spark.createDataFrame([(k + 1, x, cuts) for k, (x, cuts) in enumerate(zip(languages, least_fits(texts, size), strict=True))], "place int, name string, cuts array<double>")
    whole = F.array(*[F.lit(float(x)) for x in prior])

    seen = texts.where("by_text is not null").groupBy("host", "suffix", "by_text").agg(F.count("*").alias("n"))
    smooth = lambda n, upper: F.zip_with(n, upper, lambda x, p: (x + strength * p) / (F.aggregate(n, F.lit(0).cast("long"), lambda a, b: a + b) + strength))
    suffixes = _spread(seen, ["suffix"], size).select("suffix", smooth(F.col("n"), whole).alias("suffix_prior"))
    suffixes = materialise(suffixes, "suffixes")
    hosts = materialise(_spread(seen, ["host", "suffix"], size).join(suffixes, "suffix").select("host", "suffix", smooth(F.col("n"), F.col("suffix_prior")).alias("host_prior")), "hosts")

    joined = texts.join(hosts, ["host", "suffix"], "left").join(suffixes, "suffix", "left").join(F.broadcast(evidence), "declared", "left")
    place = F.coalesce("host_prior", "suffix_prior", whole)
    total = F.transform(F.arrays_zip(F.col("logs").alias("t"), F.col("declared_logs").alias("d"), place.alias("p")), lambda x: x["t"] + x["d"] + F.log(x["p"]))
    scored = joined.withColumn("total", total).withColumn("top", F.array_max("total")).withColumn("winner", best(F.col("total")))
    scored = scored.join(F.broadcast(names.select(F.col("place").alias("winner"), F.col("name").alias("language"))), "winner")
    scored = scored.join(F.broadcast(names.select(F.col("place").alias("by_text"), F.col("name").alias("by_text_name"), "cuts")), "by_text", "left")
    cut = F.element_at("cuts", F.floor(F.log2("n_trigrams")).cast("int") + 1)
    unknown = F.when(F.col("by_text").isNull(), 1.0).otherwise(F.exp(F.least(F.col("n_trigrams") * cut / 3 - F.array_max("logs"), F.lit(500.0))))
    posterior = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))) / (1 + unknown)
    found = scored.select(F.col("row_key").alias(key), "language", posterior.alias("posterior"), F.coalesce("by_text_name", F.lit("und")).alias("text_language"), "declared", "n_trigrams")
    kept = F.col("posterior") >= least_posterior
    if accepted is not None:
        kept = kept & F.col("language").isin(accepted)
    return found.withColumn("kept", kept)


def keep_identified(docs: DataFrame, declared: str = "lang", address: str = "source", **options: object) -> DataFrame:
    """The rows of ``docs`` that ``identify`` keeps, with their columns; ``docs`` has the columns ``declared`` and
    ``address``. Equal rows go or stay together."""
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key("doc_id", text_or_empty(), declared, address))
    bad = identify(keyed, key, F.col(declared), F.col(address), **options).where("not kept").select(key).distinct()
    return keyed.join(materialise(bad, "rejected"), key, "left_anti").select(*docs.columns)
