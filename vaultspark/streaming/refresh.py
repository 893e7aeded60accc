"""Keeping an index fresh from a stream of documents: each micro-batch is one patch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaultspark.operators import index


def newest(docs: DataFrame, key: str, text: str, version: str, deleted: str | None) -> DataFrame:
    """(key, text, gone) of the newest version of each document: the largest `version` counts, a null one least.

    Of rows of one version a deletion counts before a text, and then the larger text. A null text is empty, a null
    `deleted` is no deletion.
    """
    gone = F.coalesce(F.col(deleted).cast("boolean"), F.lit(False)) if deleted else F.lit(False)
    row = F.struct(F.col(version).alias("version"), gone.alias("gone"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    last = docs.groupBy(F.col(key).alias("id")).agg(F.max(row).alias("last"))
    return last.select(F.col("id").alias(key), F.col("last.text").alias(text), F.col("last.gone").alias("gone"))


def patch(docs: DataFrame, folder: str, version: str, deleted: str | None = None, key: str = "doc_id", text: str = "text", fingerprint: str = "") -> None:
    """Takes the newest versions of documents into the index, and out of it what is deleted.

    Versions are compared within the batch; a batch is taken to hold nothing older than what earlier ones brought.
    """
    last = newest(docs, key, text, version, deleted).persist()
    try:
        here, gone = last.filter(~F.col("gone")).select(key, text), last.filter("gone").select(F.col(key).alias("id"))
        if index.manifest(docs.sparkSession, folder) is None:
            index.build(here, folder, key, text, fingerprint)
        else:
            index.patch(docs.sparkSession, folder, here, gone, key, text, fingerprint)
    finally:
        last.unpersist()


def follow(stream: DataFrame, folder: str, checkpoint: str, version: str, deleted: str | None = None, key: str = "doc_id", text: str = "text", fingerprint: str = "", once: bool = True) -> StreamingQuery:
    """Patches the index from a streaming DataFrame. A batch that is run again after a failure replaces its own documents."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: patch(batch, folder, version, deleted, key, text, fingerprint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
