"""Counts by facet, health checks, review queues, and evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.operators.filters import review_reasons


def facets(entries: DataFrame, fields: list[str]) -> DataFrame:
    """(facet, value, n) of every field's values in one pass; null and empty values are no value."""
    shown = F.lit(None).cast("string")
    for f in fields:
        shown = F.when(F.grouping(f) == 0, F.lit(f)).otherwise(shown)
    value = F.coalesce(*[F.col(f).cast("string") for f in fields])
    rows = entries.groupingSets([[F.col(f)] for f in fields], *fields).agg(shown.alias("facet"), value.alias("value"), F.count("*").alias("n"))
    return rows.select("facet", "value", "n").filter("value is not null and value <> ''")


def totals(entries: DataFrame) -> DataFrame:
    """One row: entries, readable, unreadable, complete, attachments, with_attachments."""
    bad = F.col("parse_error").isNotNull()
    size = F.coalesce(F.size("attachments"), F.lit(0))
    return entries.agg(F.count("*").alias("entries"), F.count_if(~bad).alias("readable"), F.count_if(bad).alias("unreadable"), (F.count_if(bad) == 0).alias("complete"), F.sum(F.greatest(size, F.lit(0))).alias("attachments"), F.count_if(size > 0).alias("with_attachments"))


def without_type(entries: DataFrame, typed: Column, others: Column, type_column: str = "type") -> DataFrame:
    """(type, n) without the type filter, only where nothing matches with it."""
    hits = entries.filter(others)
    found = hits.agg(F.count_if(typed).alias("typed"))
    return hits.groupBy(F.col(type_column).alias("type")).agg(F.count("*").alias("n")).join(F.broadcast(found.filter("typed = 0")), how="cross").select("type", "n")


def review_queue(entries: DataFrame) -> DataFrame:
    """(id, created_at, reasons) of entries that need a look, oldest first, those without a time before all."""
    rows = entries.withColumn("reasons", review_reasons()).filter(F.size("reasons") > 0)
    return rows.select("id", "created_at", "reasons").orderBy(F.col("created_at").asc_nulls_first(), "id")


def health(checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(name, status, n): one row for each check; a check is its name, the offending rows, and `warn` or `error`."""
    out = None
    for name, offending, level in checks:
        row = offending.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.when(F.col("n") > 0, F.lit(level)).otherwise("ok").alias("status"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5, group: str | None = None) -> DataFrame:
    """recall_at_k (any hit), mrr and queries, by `group` of relevant if given, with a total (null group).

    ranked: (query_id, id, rank); relevant: (query_id, id). Queries with no ranked hit count as zero.
    """
    asked = relevant.select("query_id", *([group] if group else [])).distinct()
    first = ranked.filter(F.col("rank") <= k).join(relevant.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    joined = asked.join(first, "query_id", "left")
    keyed = joined.rollup(group) if group else joined.groupBy()
    return keyed.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def retrieval_report(asked: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int = 5, group: str | None = None) -> DataFrame:
    """answerable, recall_at_k, precision, mrr, unanswerable, correct_empty, by `group` of asked if given, with a total.

    asked: (query_id) of all queries; ranked: (query_id, id, rank); relevant: (query_id, id). Precision is the share
    of what was returned up to k that is relevant; correct_empty counts queries without a relevant entry that
    returned nothing. Rates of no queries, and the precision of nothing returned, are null.
    """
    good = relevant.select("query_id", "id").distinct().withColumn("good", F.lit(1))
    top = ranked.filter(F.col("rank") <= k).join(good, ["query_id", "id"], "left")
    per = top.groupBy("query_id").agg(F.count("*").alias("returned"), F.sum(F.coalesce("good", F.lit(0))).alias("hits"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"))
    answerable = good.select("query_id").distinct().withColumn("has", F.lit(True))
    rows = asked.select("query_id", *([group] if group else [])).distinct().join(per, "query_id", "left").join(answerable, "query_id", "left")
    rows = rows.withColumn("has", F.coalesce("has", F.lit(False))).withColumn("returned", F.coalesce("returned", F.lit(0)))
    keyed = rows.rollup(group) if group else rows.groupBy()
    return keyed.agg(
        F.count_if("has").alias("answerable"),
        F.round(F.avg(F.when(F.col("has"), F.col("first").isNotNull().cast("double"))), 6).alias("recall_at_k"),
        F.round(F.sum("hits") / F.sum("returned"), 6).alias("precision"),
        F.round(F.avg(F.when(F.col("has"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)))), 6).alias("mrr"),
        F.count_if(~F.col("has")).alias("unanswerable"),
        F.count_if(~F.col("has") & (F.col("returned") == 0)).alias("correct_empty"),
    )


def pending_attachments(found: DataFrame, most: int = 64) -> DataFrame:
    """(sha256, duplicate_count, ...) of what waits in an inbox: of the newest `most` files one for each digest, oldest first.

    found: (name, added_at, sha256, ...). The oldest of equal files stands for all.
    """
    rest = [c for c in found.columns if c not in ("sha256", "added_at", "name")]
    chosen = found.orderBy(F.desc("added_at"), F.desc("name")).limit(most)
    one = chosen.groupBy("sha256").agg(F.min(F.struct("added_at", "name", *rest)).alias("x"), F.count("*").alias("duplicate_count"))
    return one.select("sha256", "duplicate_count", "x.*").orderBy("added_at", "name")


def import_report(states: DataFrame, most: int = 50) -> DataFrame:
    """(state, n, first): how many rows of (original_id, state) each state has, and the first `most` ids, sorted."""
    distinct = states.select("state", "original_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy("state").orderBy("original_id"))).filter(F.col("place") <= most)
    lists = distinct.groupBy("state").agg(F.array_sort(F.collect_list("original_id")).alias("first"))
    return states.groupBy("state").agg(F.count("*").alias("n")).join(lists, "state")


def revision(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def snapshot_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a digest that does not depend on the rows' order. Digests of rows are summed in 256 buckets, then joined in order."""
    own = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]), 256)
    buckets = rows.select(own.alias("d")).groupBy(F.substring("d", 1, 2).alias("b")).agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(30,0)")).alias(f"s{i}") for i in range(8)])
    line = F.concat_ws(":", "b", "n", *[f"s{i}" for i in range(8)])
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
