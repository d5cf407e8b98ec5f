"""The ten training-data operators as queries over the test tables, with their contracts' parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents, table

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), vocabulary(BYTE_BPE), end_id=0, capacity=1024)


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .fertility import judge

    return judge(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import identify

    return identify(documents(spark, sf_dir), "doc_id", F.col("lang"), F.col("source"))


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_texts

    return score_texts(documents(spark, sf_dir), states=8, rounds=4, n_words=4096, n_endings=4096)


def op5_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orcids import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary(BYTE_BPE), end_id=2)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), width=8, min_literal=4, min_share=0.3)


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import captures_of, entries_of, match

    pages = table(spark, sf_dir, "pages")
    return match(captures_of(pages), entries_of(table(spark, sf_dir, "events"), pages))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=3, distance=3)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import delete_copies

    return delete_copies(documents(spark, sf_dir), min_words=50, report=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derive

    return derive(table(spark, sf_dir, "pages"))


def pages_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language identification of web pages: markup language, host and suffix of the address."""
    from pyspark.sql import functions as F

    from .langid import identify
    from .warc import page_texts

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return identify(page_texts(pages), "page_id", F.col("markup_language"), F.col("url"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pages_langid": pages_langid} | {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import urlfilter

    return {"op7_url_lists": urlfilter.SQL}
