"""Operator 11: Merkle manifest of a dataset, with coordinate lookup proofs.

Rows are leaves of one tree for each group, and the groups' roots are leaves of a tree on top. Runs of `fanout`
consecutive nodes, the last one shorter, become their digest until one node remains. Trees are built by blocks of
BLOCK levels: what is left of a block is a leaf of the next storey, so ten thousand million leaves take six short
jobs, a block is one bounded row, and no task sees a whole tree. A storey's nodes are a written table of coordinates
(tree, block, level, at). For a proof each leaf explodes the coordinates of its siblings, which follow from its index
and the size of its group, joins the node table, orders what it finds and concatenates; the way on from the block's
root is the proof of that root in the storey above, found once for a block and not for each of its leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.llm.common import cut, small

BLOCK = 6  # levels of a block: 64 leaves at a fan-out of two, whose proofs take six coordinates each
_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: `-` for a null, else the value's size in UTF-8 bytes, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(start: Column, path: Column) -> Column:
    """Root that a leaf's digest leads to along its proof."""
    return F.aggregate(path, start, lambda acc, step: digest(step["left"], acc, step["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a proof: level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _numbered(df: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with its place `pos` from 0 within its group, (group, n)): sorted ranges, whose sizes are summed up before them."""
    rows = df.withColumn("tie", F.monotonically_increasing_id())  # rows that are equal otherwise are spread, too
    by = [group, *order, "tie"]
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("line", F.monotonically_increasing_id()))
    lot = F.shiftright("line", 33)  # the range partition; its lines count up from 0
    runs = placed.groupBy(F.col(group).alias("run_group"), lot.alias("lot")).agg(F.min("line").alias("first"), F.count("*").alias("size"))
    runs = cut(runs)  # as many rows as ranges and groups together
    before = F.coalesce(F.sum("size").over(Window.partitionBy("run_group").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = runs.select("run_group", "lot", (before - F.col("first")).alias("shift"))
    found = placed.join(small(shift), F.col(group).eqNullSafe(F.col("run_group")) & (lot == F.col("lot")))
    sizes = runs.groupBy(F.col("run_group").alias(group)).agg(F.sum("size").alias("n"))
    return found.withColumn("pos", F.col("line") + F.col("shift")).drop("run_group", "lot", "shift", "line"), sizes


def _levels(fanout: int, n: str = "n") -> Column:
    """Levels above the leaves of a block in a tree of n leaves: all where the tree goes on, else until one node remains."""
    return sum(((F.col(n) > fanout**k).cast("int") for k in range(BLOCK)), F.lit(0))


def _nodes(members: DataFrame, fanout: int) -> DataFrame:
    """(tree, n, block, level, at, digest) for members (tree, n, pos, digest); `at` counts from the block's first node of that level."""
    width = fanout**BLOCK
    blocks = members.groupBy("tree", "n", F.expr(f"pos div {width}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("own"))
    blocks = blocks.select("tree", "n", "block", F.col("own.digest").alias("level0"))

    def joined(below: str) -> Column:
        runs = F.sequence(F.lit(0), F.expr(f"int((size({below}) - 1) div {fanout})"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * fanout + 1, fanout), ""), 256))

    for k in range(1, BLOCK + 1):
        blocks = blocks.withColumn(f"level{k}", F.when(F.col("n") > fanout ** (k - 1), joined(f"level{k - 1}")))
    levels = blocks.select("tree", "n", "block", F.posexplode(F.array(*[f"level{k}" for k in range(BLOCK + 1)])).alias("level", "nodes"))
    return levels.select("tree", "n", "block", "level", F.posexplode("nodes").alias("at", "digest"))


def _siblings(fanout: int) -> Column:
    """Coordinates (level, at, left) of the siblings of leaf `off` of a block: from its index and the size n of its tree."""

    def on(k: int) -> Column:
        own = F.expr(f"off div {fanout**k}")
        first = F.expr(f"off div {fanout ** (k + 1)} * {fanout}")
        last = F.expr(f"(n - 1) div {fanout**k} - block * {fanout ** (BLOCK - k)}")  # of the tree's level, counted from the block's first
        places = F.filter(F.sequence(first, first + fanout - 1), lambda at: (at != own) & (at <= last))
        found = F.transform(places, lambda at: F.struct(F.lit(k).alias("level"), at.alias("at"), (at < own).alias("left")))
        return F.when(F.col("n") > fanout**k, found).otherwise(F.array().cast("array<struct<level:int,at:bigint,left:boolean>>"))

    return F.flatten(F.array(*[on(k) for k in range(BLOCK)]))


def _paths(members: DataFrame, nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, pos, block, path): the proof of each member up to its block's root."""
    width = fanout**BLOCK
    own = members.select("tree", "n", "pos", F.expr(f"pos div {width}").alias("block"), F.expr(f"pos % {width}").alias("off"))
    asked = own.select("tree", "n", "pos", "block", F.explode_outer(_siblings(fanout)).alias("s"))
    asked = asked.select("tree", "n", "pos", "block", F.col("s.level").alias("level"), F.col("s.at").alias("at"), F.col("s.left").alias("left"))
    table = nodes.select("tree", "block", "level", F.col("at").cast("long").alias("at"), "digest")
    met = asked.join(table, ["tree", "block", "level", "at"], "left")
    found = met.groupBy("tree", "n", "pos", "block").agg(F.sort_array(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("level", "at", "left", "digest")))).alias("s"))

    def side(k: Column, left: bool) -> Column:
        mine = F.filter("s", lambda x: (x["level"] == k) & (x["left"] == left))
        return F.array_join(F.transform(mine, lambda x: x["digest"]), "")

    steps = F.transform(F.sequence(F.lit(0), _levels(fanout) - 1), lambda k: F.struct(side(k, True).alias("left"), side(k, False).alias("right")))
    return found.select("tree", "pos", "block", F.when(_levels(fanout) > 0, steps).otherwise(F.array().cast(_STEP)).alias("path"))


def forest(members: DataFrame, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """((tree, digest) of each root, (tree, pos, path) of each leaf) for leaves (tree, n, pos, digest).

    `pos` counts from 0 to n - 1 within a tree. Node tables are written, one for each storey; a storey has one row for
    fanout ** BLOCK of the one below it.
    """
    width = fanout**BLOCK
    most = members.agg(F.max("n")).first()[0] or 0
    storeys, roots = [], None
    while True:
        nodes = cut(_nodes(members, fanout))
        storeys.append((members, nodes))
        tops = nodes.filter(F.col("level") == _levels(fanout))
        done = tops.filter(F.col("n") <= width).select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if most <= width:
            break
        most = -(-most // width)
        members = tops.filter(F.col("n") > width).select("tree", F.expr(f"(n - 1) div {width} + 1").alias("n"), F.col("block").alias("pos"), "digest")
    above = None
    for members, nodes in reversed(storeys):
        paths = _paths(members, nodes, fanout)
        if above is not None:
            over = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("on"))
            paths = paths.join(over, ["tree", "block"], "left").withColumn("path", F.concat("path", F.coalesce("on", F.array().cast(_STEP))))
        above = paths.select("tree", "pos", "path")
    return roots, above


def manifest(rows: DataFrame, leaf: Column, key: str = "doc_id", group: str = "lang", keep: tuple[Column, ...] = (), fanout: int = 2) -> DataFrame:
    """(key, group, the columns of keep, leaf, subroot, root, path): each row's place in the manifest, with its proof.

    `leaf` is the digest of a row, as leaf() makes it. Leaves of a group ascend by key, nulls first, then by digest;
    groups ascend as UTF-8 bytes, a null group first. `path` holds a struct of the siblings to the left and to the
    right for each level, from the leaf to `root`; a level on which a node is alone has two empty texts. Rows that
    repeat are leaves of their own; texts of any length are hashed whole and don't travel. Other columns, whatever
    their names, take part only through `leaf` and `keep`. An empty table gives no rows. Some jobs run while the
    plan is built: they write the leaves in order and the node tables to the shared folder.
    """
    own = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), leaf.alias("digest"), F.struct(F.lit(0).alias("none"), *keep).alias("kept"))
    placed, sizes = _numbered(own, "g", ["k", "digest"])
    ranked, _ = _numbered(sizes.withColumn("all", F.lit(0)), "all", ["g"])
    trees = small(cut(ranked.select(F.col("g").alias("tree_group"), F.col("pos").alias("tree"), "n")))
    leaves = cut(placed.join(trees, F.col("g").eqNullSafe(F.col("tree_group"))).drop("tree_group"))
    subroots, paths = forest(leaves.select("tree", "n", "pos", "digest"), fanout)
    subroots = cut(subroots)
    top, ways = forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(subroots.count()).cast("long").alias("n"), F.col("tree").alias("pos"), "digest"), fanout)
    root = top.first()  # one row, or none of an empty table
    ways = ways.join(subroots.withColumnRenamed("tree", "pos"), "pos").select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("on"))
    found = leaves.join(paths, ["tree", "pos"]).join(small(cut(ways)), "tree")
    kept = [F.col(f"kept.`{f.name}`") for f in leaves.schema["kept"].dataType.fields[1:]]
    return found.select(
        F.col("k").alias(key), F.col("g").alias(group), *kept, F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), F.concat("path", "on").alias("path")
    )
