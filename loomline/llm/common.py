"""Shared helpers: the shared work folder, staged tables, range lookup and row classes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that the line and shingle operators know, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local session that has none gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(found)
    if "://" not in found and not found.startswith("file:"):
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(path(old), path(new)):
        raise OSError(f"cannot rename {old} to {new}")


def stage(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders by the columns ``by``, and read it back: the lineage ends there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.partitionBy(*(by or [])).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a staged table that nothing reads any more."""
    if df is not None and getattr(df, "_staged_path", None):
        remove(df.sparkSession, df._staged_path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows while jobs run in the block: rows of sets or texts are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _UPPER.lower())


def text_of(col: Column) -> Column:
    """The text as string, null as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def range_index(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are <= key, by a search in two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds[step - 1 :: step]])
    fine = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds])
    block = F.size(F.filter(coarse, lambda b: b <= key))
    return (block * step + F.size(F.filter(F.slice(fine, block * step + 1, F.lit(step)), lambda b: b <= key))).cast("int")


def give_back() -> None:
    """Return freed memory of this Python process to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
