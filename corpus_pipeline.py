"""A corpus pipeline over `documents`: toxicity, line dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import bpe, line_dedup, mixing, simhash, toxicity
from vaultspark.llm.common import shared_root, table, until_exit


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; nothing else does. Null and empty texts are scored like others."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs.select(F.struct("*").alias("row"), "text"), model)
    return rows.filter(F.col("score") < 0.5).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go from the texts, equal ones of any length but empty; every document stays, its n_chars following its text."""
    kept = line_dedup.dedup(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in five-word shingles (Jaccard 0.8 or more) the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of op1 over what is left, a row for each copy taken."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digest of the bytes that they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(docs, path, pattern, keep=("doc_id", "source"))
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("SimHash near-dedup", drop_near_duplicates), ("mixing", mix_sources), ("byte-level BPE", tokenize)]

#: A trained network and hashed orders are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_root(spark)}/pipeline/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        until_exit(spark, path)
        docs = spark.read.parquet(path)
    return docs
