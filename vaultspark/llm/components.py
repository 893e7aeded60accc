"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import LOCAL, cut, discard, gathered


HUB, HUBS = 1000, 100_000  # links of a hub at least, and the share of all links that makes one


def _with_least(rows: DataFrame, hub: int | None) -> DataFrame:
    """rows (a, b) with `low`, the smallest b of a.

    With `hub`, nodes of more rows than that are joined by broadcast, so their rows never meet in one task; there
    are 2 x HUBS of them at most. The rows of other nodes are joined by shuffle.
    """
    least = rows.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    if hub is None:
        return rows.join(least.select("a", "low"), "a")
    hubs, others = least.filter(F.col("n") > hub).select("a", "low"), least.filter(F.col("n") <= hub).select("a", "low")
    rest = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti")
    return rest.join(others, "a").unionByName(rows.join(F.broadcast(hubs), "a"))


def _large(edges: DataFrame, hub: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = _with_least(both, hub).filter("b > a")
    return joined.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame, hub: int | None) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = _with_least(down, hub).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """(links, a sum over them, links of the busiest node)."""
    ends = edges.select(F.xxhash64("a", "b").alias("h"), F.explode(F.array("a", "b")).alias("node"))
    by_node = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.col("h") % (1 << 40)).alias("h"))
    row = by_node.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("top")).first()
    return (row["n"] or 0) // 2, row["h"], row["top"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (a, b: long); component is the smallest id reachable.

    Self-links, repeated and reversed links are fine; rows with a null end are ignored; no links give no rows.
    Every round is written to the shared folder; a graph that a count proves small is followed in one task. Minima are made by map-side aggregates; a hub's rows are joined
    by broadcast, see _with_least.
    """
    now = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    read = gathered(now)
    before = _state(read)
    for _ in range(rounds):
        if before[0] == 0:
            break
        hub = max(HUB, before[0] // HUBS)
        some = hub if before[2] > hub and before[0] > LOCAL else None
        last, now = now, cut(_small(_large(read, some), some))
        read = now.coalesce(1) if before[0] <= LOCAL else now  # rounds make no more links than there were nodes and links
        after = _state(read)
        discard(last)
        if after[:2] == before[:2]:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = read.groupBy("a").agg(F.min("b").alias("b"))
    roots = read.select("b").distinct()
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("id"), F.col("b").alias("component")))


def contracted(named: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) after more links: named (id, component) as components gives it, edges (a, b) new ones.

    Only links between components are followed, so the graph is as small as what the new links join.
    """
    named, edges = gathered(named), gathered(edges)
    sided = edges.join(named.toDF("a", "ca"), "a", "left").join(named.toDF("b", "cb"), "b", "left")
    between = cut(sided.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct())
    if between.isEmpty():
        return named
    moved = cut(components(between)).toDF("c", "to")
    fresh = moved.select(F.col("c").alias("id"), F.col("c").alias("component")).join(named, "id", "left_anti")
    return cut(named.unionByName(fresh).join(moved, F.col("component") == F.col("c"), "left").select("id", F.coalesce("to", "component").alias("component")))


PIVOTS, MORE = 4, 8  # pivots of a key in the first round, and how many times as many in each further one
AHEAD = 1  # rounds before those, in which a member meets one pivot of all its keys
CROWD = 2000  # members of a key, about, from which its pivots are broadcast, so that no task gets all its members
WIDE, SALTS = 20_000, 16  # rows with bitmaps that the driver broadcasts at most: some MB. Lots of a crowd where there are more


def pivoted(hot: DataFrame, near: DataFrame, verified: Callable[[DataFrame], DataFrame], fits: Column) -> DataFrame:
    """near (id, component) after all links between members of one k of hot (k, id, n) that verified(a, b) lets pass.

    First every member is compared with one pivot, the same for members of the same keys, which connects most of a
    crowd of near copies by a pair for each. Then, round after round, some members of a key, its pivots, are compared
    with every member of another component that they fit (a condition on n and the pivot's pn), and leave; keys of
    one component only are done. Members of the largest component go first, as what one of them found may be what
    all others are alike to. In the end all have met, or are connected: a crowd never has all its pairs compared.
    """

    def open_keys(seed: int) -> DataFrame:
        """(k, id, n, c, out, h) of keys with several components: the component, whether it is not the key's largest, a hash."""
        named = cut(gathered(hot).join(gathered(near), "id", "left").select("k", "id", "n", F.coalesce("component", "id").alias("c")))
        parted = named.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("k")
        top = named.groupBy("k", "c").agg(F.count("*").alias("many")).groupBy("k").agg(F.max(F.struct("many", "c")).alias("x")).select("k", F.col("x.c").alias("top"))
        out = cut(named.join(parted, "k", "left_semi").join(top, "k").select("k", "id", "n", "c", (F.col("c") != F.col("top")).alias("out"), F.xxhash64(F.lit(seed), "id").alias("h")))
        discard(named)
        return out

    def pivots_of(now: DataFrame, lots: int) -> DataFrame:
        now = gathered(now)
        first = now.groupBy("k", F.pmod("h", F.lit(lots)).alias("lot")).agg(F.min(F.struct("out", "h", "id", "n", "c")).alias("p"), F.count("*").alias("many"))
        return cut(first.select("k", F.col("p.id").alias("p"), F.col("p.n").alias("pn"), F.col("p.c").alias("pc"), F.col("p.h").alias("ph"), (F.col("many") * lots > CROWD).alias("crowd")))

    def sided_with(now: DataFrame, pivots: DataFrame) -> DataFrame:
        """Members with each pivot of their keys, joined by shuffle. As rows multiply here, the members of crowds are spread over tasks.

        The driver broadcasts WIDE pivots at most; of more than that, each of SALTS lots of members gets a copy by shuffle.
        """
        met, crowd = now.join(pivots.filter("not crowd"), "k"), pivots.filter("crowd")
        count = crowd.count()
        if count == 0:
            return met
        if count <= WIDE:
            crowded = now.join(F.broadcast(crowd.select("k").distinct()), "k", "left_semi").repartition(F.col("id"))
            return met.unionByName(crowded.join(F.broadcast(crowd), "k"))
        copies = crowd.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        return met.unionByName(now.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(copies, ["k", "salt"]).drop("salt"))

    def meet(pairs: DataFrame) -> DataFrame:
        return contracted(near, verified(pairs.select(F.greatest("p", "id").alias("a"), F.least("p", "id").alias("b")).distinct()))

    if hot.isEmpty():
        return near
    for seed in range(AHEAD):
        now = open_keys(seed)
        pivots = pivots_of(now, 1)
        sided = gathered(now).join(pivots, "k").filter((F.col("pc") != F.col("c")) & fits)
        near = meet(sided.groupBy("id").agg(F.min(F.struct("ph", "p")).alias("m")).select("id", "m.p"))
        discard(now, pivots)
    lots = PIVOTS
    while not hot.isEmpty():
        now = open_keys(AHEAD)
        pivots = pivots_of(now, lots)
        near = meet(sided_with(now, pivots).filter((F.col("pc") != F.col("c")) & fits))
        hot = cut(gathered(now).select("k", "id", "n").join(pivots.select("k", F.col("p").alias("id")), ["k", "id"], "left_anti"))
        discard(now, pivots)
        lots *= MORE
    return near
