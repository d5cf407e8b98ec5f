"""Shared plumbing of the training-data operators: tables in the shared folder, sizes, column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_dir


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/millrace-{tag}-{uuid.uuid4().hex}"


#: Folders made by ``materialise`` in this process, oldest first.
_MADE: list[str] = []


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, tag)
    _MADE.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/millrace-" in folder:
            delete_path(df.sparkSession, folder)


def mark() -> int:
    """How many tables have been made so far."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Delete the tables made after ``mark`` gave ``since``, except those that ``keep`` reads."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()} if keep is not None else set()
    for path in [p for p in _MADE[since:] if p.rsplit("/", 1)[-1] not in kept]:
        delete_path(spark, path)
        _MADE.remove(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(*columns: Column | str) -> Column:
    """A 128-bit key of one row, as text: the MD5 of its ``columns``, each with its length, so that nothing else than
    equal values has equal keys. By default doc_id and text, null text counting as empty."""

    def part(c: Column) -> Column:
        return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    given = columns or ("doc_id", text_or_empty())
    return F.md5(F.concat(*[part((F.col(c) if isinstance(c, str) else c).cast("string")) for c in given]))


#: Bits of ``key_marks``, whatever the number of keys.
MARKS = 1 << 23


def key_marks(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of a column of keys (as by ``row_key``): true for all of ``keys.key`` and, as it knows ``MARKS`` bits only,
    for some others. Where few rows are to be joined by key, those it tells apart needn't be dealt out."""

    def place(key: Column) -> Column:
        return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % MARKS

    # bits are numbered from 1
    at = place(F.col("key")) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    found = {r["bucket"]: bytes(r["bits"]) for r in parts}
    marks = np.frombuffer(b"".join(found.get(k + 1, bytes(4096)) for k in range(MARKS >> 15)), np.uint8)

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((marks[at >> 3] >> (at & 7)) & 1 == 1)

    return lambda key: marked(place(key))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def pieces(batch: pa.RecordBatch, column: str, rows: int = 300, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and ``size`` bytes of a string ``column``; a longer value is alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right"))
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
