"""Operator 6: benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers, names and units become typed placeholders that carry their value (``§d=12``, ``§n=paris``, ``§u=km``); the
rest is lower-cased words without punctuation. Windows of ``width`` template words (placeholders without values) of
documents meet those of the benchmark by hash. Matching windows that keep one distance between their places in
document and item are one alignment; in it every slot value of the item must always stand for the same value of the
document; two of the item's may have become one. A re-parameterised question passes that, a chance likeness of
templates doesn't. Windows with few literal words say too little as templates and are met with their values instead.
A document is contaminated by an item if aligned, consistent windows make ``min_share`` of the item's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, row_key, text_or_empty

#: Units that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz gram grams ton tons ml l liter liters "
    "litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year "
    "years hz khz mhz ghz w kw mw kwh j kj cal kcal v a pa bar k c f degree degrees percent dollar dollars cent cents euro "
    "euros pound pounds meter meters metre metres kilometer kilometers kilogram kilograms usd eur gbp million billion thousand"
).split()
# each pattern begins with what is rare, so that most places of a text cost one comparison
NAME = r"(\p{Lu}(?<=[\p{L}\p{N},] .)\p{Ll}[\p{L}\p{M}]*)"
NUMBER = r"(\p{N}(?<![\p{L}\p{N}§=].)[\p{N}.,:/]*[\p{L}%°]*)"
UNIT = r"(§D=\S+ )(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{N}])"


def canonical(text: Column) -> Column:
    """Words of a text, with values in placeholders, as one string."""
    text = F.translate(text, "§=", "  ")
    text = F.regexp_replace(text, NAME, "§N=$1")
    text = F.regexp_replace(text, NUMBER, "§D=$1")
    text = F.regexp_replace(text, UNIT, "$1§U=$2")
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}§=\s]+", ""))


def words(canon: Column) -> Column:
    return F.array_remove(F.split(canon, r"\s+"), "")


def template(word: Column) -> Column:
    """A word of a canonical text without its value: the first two characters of a placeholder."""
    return F.when(word.startswith("§"), F.substring(word, 1, 2)).otherwise(word)


def templates(canon: Column) -> Column:
    """``template`` of all words of a canonical text."""
    return F.regexp_replace(canon, r"=\S*", "")


def window_hashes(tokens: Column, size: int) -> Column:
    """The hash of each window of ``size`` words, in order; none in shorter texts."""

    def hashes(own: Column) -> Column:
        starts = F.when(F.size(own) >= size, F.sequence(F.lit(1), F.size(own) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.xxhash64(F.slice(own, k, size)))

    # as a lambda's variable the words are made once for a text; named as they are, they would be made again for each window
    return F.element_at(F.transform(F.array(tokens), hashes), 1)


def windows(rows: DataFrame, key: str, kinds: list[tuple[int, bool]]) -> DataFrame:
    """(key, size, whole, place, hash) of every window of each kind (size, whole) in the texts of ``rows``: templates of
    words, or with their values for ``whole`` kinds; places count from 0. A text is canonicalised once for all kinds."""
    canon = rows.select(key, canonical(F.col("text")).alias("canon"))
    tokens = canon.select(key, words(F.col("canon")).alias("valued"), words(templates(F.col("canon"))).alias("plain"))
    made = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(w).alias("whole"), window_hashes(F.col("valued" if w else "plain"), s).alias("hashes")) for s, w in kinds])
    return tokens.select(key, F.explode(made).alias("k")).select(key, "k.size", "k.whole", F.posexplode("k.hashes").alias("place", "hash"))


def benchmark_windows(benchmark: DataFrame, width: int, min_literal: int) -> DataFrame:
    """(item_id, item_windows, size, place, hash, item_words, whole) of windows with literal words. An item shorter than
    ``width`` is one window. ``whole`` windows have under ``min_literal`` of them, and their hash covers the values."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), canonical(text_or_empty()).alias("canon")).select("item_id", words(F.col("canon")).alias("tokens"))
    items = items.where(F.size("tokens") > 0).withColumn("size", F.least(F.size("tokens"), F.lit(width)))
    places = items.withColumn("place", F.explode(F.sequence(F.lit(1), F.size("tokens") - F.col("size") + 1)))
    rows = places.select("item_id", "size", "place", F.expr("slice(tokens, place, size)").alias("item_words"))
    plain = F.transform("item_words", template)
    literal = F.size(F.filter("item_words", lambda w: ~w.startswith("§")))
    rows = rows.where(literal > 0).withColumn("whole", literal < min_literal).withColumn("hash", F.xxhash64(F.when(F.col("whole"), F.col("item_words")).otherwise(plain)))
    total = rows.groupBy("item_id").agg(F.countDistinct("place").alias("item_windows"))
    return rows.join(total, "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str, width: int = 8, min_literal: int = 4, min_share: float = 0.3) -> DataFrame:
    """(key, doc_id, item_id, item_windows, matched_windows, share, exact) for each row of ``docs`` (doc_id, text,
    ``key``) and each item that contaminates it; ``exact`` if all slots hold the item's own values.

    Windows meet by hash, and count only if their words are then found to be the same. Null texts and items without literal words match nothing. Items are told apart by item_id; equal ones
    each match. Equal rows of ``docs`` are one.
    """
    bench = materialise(benchmark_windows(benchmark, width, min_literal), "benchmark")
    sizes = sorted(tuple(r) for r in bench.select("size", "whole").distinct().collect())  # twice ``width`` at most
    own = docs.select(F.col(key), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    met_by = ["size", "whole", "hash"]
    hashes = bench.select(*met_by).distinct()
    every = windows(own.select(key, "text"), key, sizes or [(width, False)])
    met = materialise(every.select(key, "place", *met_by).join(hashes, met_by, "left_semi").distinct(), "met")
    # only documents with enough matches are looked at again, for the values in their windows; their keys are stored, so
    # that Spark knows the table's size and deals out the texts only where it is too large to send around
    places = bench.select(*met_by, "item_id", "item_windows", F.col("place").alias("item_place"))
    enough = met.join(places, met_by).groupBy(key, "item_id").agg((F.countDistinct("item_place") >= min_share * F.max("item_windows")).alias("enough"))
    suspects = materialise(enough.where("enough").select(key).distinct(), "suspects")
    texts = own.join(suspects, key, "left_semi").dropDuplicates([key]).select(key, "doc_id", words(canonical(F.col("text"))).alias("tokens"))
    seen = met.join(texts, key).select(key, "doc_id", *met_by, F.col("place").alias("at"), F.expr("slice(tokens, place + 1, size)").alias("doc_words"))
    same = F.forall(F.arrays_zip("item_words", "doc_words"), lambda x: F.when(F.col("whole"), x["item_words"]).otherwise(template(x["item_words"])) == F.when(F.col("whole"), x["doc_words"]).otherwise(template(x["doc_words"])))
    pairs = seen.join(bench, met_by).where(same).withColumn("diagonal", F.col("at") + 1 - F.col("place"))
    slot = F.filter(F.arrays_zip("item_words", "doc_words"), lambda x: x["item_words"].startswith("§"))
    group = [key, "doc_id", "item_id", "item_windows", "diagonal"]
    aligned = pairs.select(*group, "place", F.transform(slot, lambda x: F.struct(x["item_words"].alias("i"), x["doc_words"].alias("d"))).alias("slots"))
    aligned = aligned.groupBy(*group).agg(F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.collect_set("place").alias("places"))
    aligned = aligned.where(F.size("slots") == F.size(F.array_distinct(F.col("slots.i"))))
    found = aligned.groupBy(*group[:-1]).agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("matched_windows"), F.min(F.forall("slots", lambda x: x["i"] == x["d"])).alias("exact"))
    share = F.col("matched_windows") / F.col("item_windows")
    return found.withColumn("share", share).where(F.col("share") >= min_share).select(key, "doc_id", "item_id", F.col("item_windows").cast("long").alias("item_windows"), "matched_windows", "share", "exact")


def leaks(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """``contaminated`` without the key: a row for each document and item. Empty tables give no rows; other columns,
    whatever their names, are ignored."""
    return contaminated(docs.select("doc_id", "text").withColumn("row_key", row_key()), benchmark, "row_key", **options).drop("row_key")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with their columns."""
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key())
    bad = contaminated(keyed.select("doc_id", "text", key), benchmark, key, **options).select(key).distinct()
    return keyed.join(materialise(bad, "leaks"), key, "left_anti").select(*docs.columns)
