"""Valid time: relations in force at an instant, counts, and supersession chains. Only the interval decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions.instants import holds_at, instant


def split_as_of(entries: DataFrame, as_of: str, column: str = "relations") -> DataFrame:
    """entries with `in_force` and `not_in_force`, the two parts of the relations array."""
    at = instant(F.lit(as_of))
    test = lambda r: holds_at(instant(r["valid_from"]), instant(r["valid_until"]), at)
    return entries.withColumn("in_force", F.filter(column, test)).withColumn("not_in_force", F.filter(column, lambda r: ~test(r)))


def counts_at(edges: DataFrame, at: Column, start: str = "valid_from", stop: str = "valid_until") -> DataFrame:
    """(recorded, temporal, in_force, not_in_force) of edges whose bounds are comparable with `at`: one pass."""
    holds = holds_at(F.col(start), F.col(stop), at)
    return edges.agg(
        F.count("*").alias("recorded"), F.count_if(F.col(start).isNotNull() | F.col(stop).isNotNull()).alias("temporal"), F.count_if(holds).alias("in_force"), F.count_if(~holds).alias("not_in_force")
    )


def edges(entries: DataFrame, key: str = "id", column: str = "relations") -> DataFrame:
    """(source, position, predicate, target, valid_from, valid_until, superseded_by) of every relation; bounds in microseconds."""
    rows = entries.select(F.col(key).alias("source"), F.posexplode(column).alias("position", "r"))
    return rows.select("source", "position", "r.predicate", "r.target", instant(F.col("r.valid_from")).alias("valid_from"), instant(F.col("r.valid_until")).alias("valid_until"), "r.superseded_by")


def contradictions(all_edges: DataFrame) -> DataFrame:
    """(source, predicate, target, problem): supersessions that contradict their intervals, cycles aside.

    A successor must be asserted by the same source under the same predicate, start when or after its
    predecessor ends, and not be itself.
    """
    old = all_edges.filter("superseded_by is not null")
    new = all_edges.select("source", "predicate", F.col("target").alias("successor"), F.col("valid_from").alias("next_from"))
    met = old.join(new, (old["source"] == new["source"]) & (old["predicate"] == new["predicate"]) & (old["superseded_by"] == new["successor"]), "left")
    own = F.col("superseded_by") == F.col("target")
    problems = F.array_compact(
        F.array(
            F.when(own, F.lit("superseded by itself")),
            F.when(~own & F.col("successor").isNull(), F.lit("successor is not asserted")),
            F.when(F.col("valid_until").isNull(), F.lit("no valid_until")),
            F.when(~own & F.col("successor").isNotNull() & F.col("next_from").isNull(), F.lit("successor has no valid_from")),
            F.when(~own & (F.col("next_from") < F.col("valid_from")), F.lit("successor starts before")),
            F.when(~own & (F.col("next_from") < F.col("valid_until")), F.lit("overlaps successor")),
        )
    )
    return met.select(old["source"], old["predicate"], old["target"], F.explode(problems).alias("problem"))


def cycles(all_edges: DataFrame) -> DataFrame:
    """(source, predicate, target) of relations on a supersession cycle.

    Every relation has at most one successor, so pointers are doubled: after k rounds they reach 2^k steps, and
    what has not run off a chain by then and comes back to itself is a cycle. There are as many rounds as the
    longest possible chain needs.
    """
    step = all_edges.filter("superseded_by is not null").groupBy("source", "predicate", "target").agg(F.min("superseded_by").alias("next"))
    reach = step.withColumn("low", F.least("target", "next"))
    n = step.groupBy("source", "predicate").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, int(n).bit_length())):
        ahead = reach.select("source", "predicate", F.col("target").alias("next"), F.col("next").alias("far"), F.col("low").alias("far_low"))
        reach = reach.join(ahead, ["source", "predicate", "next"]).select("source", "predicate", "target", F.col("far").alias("next"), F.least("low", "far_low").alias("low"))
    # Whoever still has a pointer is on a cycle or leads into one; those on it are met from within.
    return reach.select("source", "predicate", F.col("next").alias("target")).distinct()


def successor_intervals(events: DataFrame, by: list[str], at: str, order: list[str]) -> DataFrame:
    """events with valid_from and valid_until: each row holds until the next of its group."""
    from pyspark.sql import Window

    return events.withColumn("valid_from", F.col(at)).withColumn("valid_until", F.lead(at).over(Window.partitionBy(*by).orderBy(*order)))
