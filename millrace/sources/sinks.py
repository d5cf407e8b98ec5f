"""Sinks: keyed upserts, deletes, versioned rewrites, status write-back, schema checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; of several new ones the last by
    ``order``. Rows of ``new`` with a null key are skipped."""
    fresh = new.dropna(subset=keys)
    if order:
        latest = Window.partitionBy(*keys).orderBy(F.desc(order))
        fresh = fresh.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*old.columns))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write a new version beside the old ones; what is being read is never overwritten. The pointer comes last."""
    path = f"{base}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    df.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").json(f"{base}/pointers")
    return path


def latest_version(spark: SparkSession, base: str) -> DataFrame:
    version = spark.read.schema("version int").json(f"{base}/pointers").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{base}/v{version:06d}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a plain local session (tests) may lack it; it then gets a temporary folder, as there is one machine.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    where = where or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what reads it often makes it once."""
    path = f"{shared_dir(df.sparkSession)}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_status(manifest: DataFrame, results: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """``manifest`` with ``column`` from ``results`` (key, status) where there is one; the last of equal keys counts."""
    last = results.groupBy(key).agg(F.max_by("status", F.struct("seq", "status")).alias("_status"))
    return manifest.join(last, key, "left").withColumn(column, F.coalesce("_status", column)).drop("_status")


def pending(manifest: DataFrame, before: tuple[str, str] | None, column: str, done: str, redo: bool = False) -> DataFrame:
    """Rows that passed the stage ``before`` and still miss this one; a missing status counts as not done."""
    rows = manifest.where(F.col(before[0]).eqNullSafe(F.lit(before[1]))) if before else manifest
    return rows if redo else rows.where(~F.col(column).eqNullSafe(F.lit(done)))


def schema_problems(df: DataFrame, expected: StructType, vector: str | None = None, dim: int | None = None) -> list[str]:
    """All differences from ``expected`` at once, and rows whose vector has another size than ``dim``."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = [f"missing column {f.name}" for f in expected.fields if f.name not in have]
    problems += [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in expected.fields if f.name in have and have[f.name] != f.dataType]
    if vector and vector in have and (n := df.where(F.size(vector) != dim).count()):
        problems.append(f"{n} rows whose {vector} has not {dim} numbers")
    return problems


def filled(parsed: DataFrame, manifest: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """``parsed`` with ``columns`` from ``manifest`` where it has none of its own."""
    extra = manifest.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns])
    joined = parsed.join(extra, key, "left")
    own = lambda c: F.coalesce(c, f"_m_{c}") if c in parsed.columns else F.col(f"_m_{c}")
    return joined.withColumns({c: own(c) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def unseen(rows: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by ``order``, that ``seen`` doesn't have."""
    first = Window.partitionBy(key).orderBy(order)
    return rows.join(seen.select(key), key, "left_anti").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
