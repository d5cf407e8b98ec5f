"""Operator 5: token ids in ORC files, ascending by document id.

ORC holds the ids as an integer column in run-length encoding (version 2 packs them to the bits they need), in
stripes with row indexes, and Bloom filters on ``doc_id``. Readers take stripes in parallel and skip stripes and
row groups by minimum, maximum and Bloom filter. Texts, which are smaller than their ids, are dealt out by ranges of
document id and sorted; each task then encodes its own range and writes one file, with the running count of ids as
a column. The numbers of a file's first ids follow from the files' totals alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table_path, text_or_empty
from .wordcoder import coder

FILE_SCHEMA = "doc_id long, file_no int, ids_before long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, bounds = coder(vocabulary).encode(part.column(1).to_pylist())
                n = part.num_rows
                ends = bounds[1:] + np.arange(1, n + 1)
                ids = np.insert(ids, bounds[1:], end_id).astype(np.int32)
                starts = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.full(n, file_no, dtype=np.int32)),
                        pa.array(before + starts),
                        pa.array(ends - starts),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids)),
                    ],
                    ["doc_id", "file_no", "ids_before", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    # rows that share an id (or have none) spread over ranges by their texts' hashes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("salt", F.xxhash64("text"))
    return rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text").mapInArrow(run, FILE_SCHEMA)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Write ``docs`` (doc_id, text) to ORC files under ``path``. Null text counts as empty; rows with a null doc_id
    come first, rows with equal doc_id are ordered by a hash of the text; other columns are ignored. An empty table gives files
    without rows."""
    encoded(docs, vocabulary, end_id).write.options(**ORC_OPTIONS).orc(path)


def with_start(rows: DataFrame, group: int = 1000) -> DataFrame:
    """``rows`` of the files, without their ids, and ``start``: the number of ids of all documents before each. Files
    are summed up in groups, so that no task holds more than ``group`` files or all groups."""
    files = rows.groupBy("file_no").agg(F.max(F.col("ids_before") + F.col("n_tokens")).alias("n")).withColumn("part", F.floor(F.col("file_no") / group))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    upper = parts.select("part", before(Window.orderBy("part")).alias("upper"))  # a row for each ``group`` files
    base = files.select("part", "file_no", before(Window.partitionBy("part").orderBy("file_no")).alias("lower")).join(upper, "part")
    return rows.join(base.select("file_no", (F.col("upper") + F.col("lower")).alias("base")), "file_no").withColumn("start", F.col("base") + F.col("ids_before")).drop("base")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: doc_id, file_no, ids_before (in the file), n_tokens, ids."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def ids_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Look up documents: the filter reaches the files, so stripes without these ids are not read."""
    return read_ids(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files; ids are read once and never dealt out."""
    names = ["doc_id", "file_no", "ids_before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], [*names, "n_tokens", "ids_crc32"])

    rows = read_ids(spark, path).select(*names, "ids")
    slim = materialise(rows.mapInArrow(run, "doc_id long, file_no int, ids_before long, n_tokens long, ids_crc32 long"), "digests")
    return with_start(slim).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to ORC in the shared folder, read the files, and return the digests of what was read."""
    spark = docs.sparkSession
    path = table_path(spark, "ids") + ".orc"
    write_ids(docs, path, vocabulary, end_id)
    return digests(spark, path)
