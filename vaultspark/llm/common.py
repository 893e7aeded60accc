"""Shared helpers: reading tables, durable cuts of a plan, and empty-safe Arrow mapping."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # a word of the contracts, for Java, RE2 and Python alike


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one is set only in local mode (tests); elsewhere it must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="vaultspark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a written table deleted when the session's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def give_back() -> None:
    """Returns freed memory of this Python worker to the machine: idle workers live on beside their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The write is a job of its own, run while the plan that uses it is still being built.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


LOCAL = 200_000  # rows of a few numbers that one task holds at most: some MB


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast only if a count proves it small."""
    return F.broadcast(df) if df.count() <= LOCAL else df


def gathered(df: DataFrame) -> DataFrame:
    """A table of cut() in one partition, if a count proves it small: what groups and joins it then needs no exchange."""
    return df.coalesce(1) if df.count() <= LOCAL else df


def discard(*frames: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more: what was made of them has been written since."""
    for df in frames:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
