"""The corpus pipeline: documents are identified by language, freed of copied passages and near copies, held against
the benchmark, and packed. Every stage but the last returns the columns of documents.

Null or empty texts name no language and go in the first stage. Rows without an id are judged like others and packed
under a null id; of rows with equal id and text one stays. Very long texts are taken whole; extra columns come along,
whatever their names, and are left behind by packing. Empty documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import mark, materialise, sweep, table
from millrace.llm.decontam import remove_contaminated
from millrace.llm.langid import keep_identified
from millrace.llm.linededup import delete_copies
from millrace.llm.packing import pack_documents
from millrace.llm.queries import BYTE_BPE, vocabulary
from millrace.llm.similar import keep_one_similar

Docs = DataFrame


def language(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Operator 3: documents without a certain language go."""
    return keep_identified(docs, "lang", "source")


def lines(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Operator 9: later copies of passages of 50 words or more are cut out of their documents."""
    return delete_copies(docs, min_words=50)


def near_copies(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Operator 8: of documents with a Jaccard similarity of 0.8 or more on 5-word shingles, found through the Gray-order
    index of their SimHashes, one stays."""
    return keep_one_similar(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Operator 6: documents that hold a benchmark item, re-parameterised or not, go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), width=8, min_literal=4, min_share=0.3)


def packing(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    """Operator 1: sequences of 1024 tokens at most."""
    return pack_documents(docs, vocabulary(BYTE_BPE), end_id=0, capacity=1024)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]

#: Trigram models, SimHash and byte-level BPE are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; each result is written as Parquet and read again, and what the
    stage needed on its way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = mark()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
            sweep(spark, before, keep=docs)
    return docs
