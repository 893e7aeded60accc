"""Session factory used by the bench, the tests and interactive work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for derived tables that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="vaultspark-scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, written now and deleted when the session's JVM ends: it is computed once, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = scratch(spark, f"tables/{uuid.uuid4().hex}")
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt to all cores by keys where its files are smaller than one split; else as it is.

    For costly work on each row: a file of a single row group is one task, however many cores there are. By the size
    that Catalyst knows from the files, without a job. Tables of more than a split are never shuffled for this.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(spark.sparkContext.defaultParallelism, *keys) if size < split else df


def where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of df that satisfy a costly condition, tested where df is: a filter would be pushed below what dealt() has done."""
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_met")).drop("_met")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("vaultspark")
    for key, value in {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="vaultspark-checkpoints-"),
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
