"""Operator 7: near-duplicate vectors by a PCA-ordered, tiled comparison.

Equal vectors are one class first, so copies cost one comparison. The classes are rotated to the axes of largest
variance, which changes no cosine, and laid out in stripes of the first axis, sorted by the second: tiles of some
thousand neighbours, groups of some tiles. Groups whose boxes in the leading axes are too far apart to hold a pair
never meet. Groups that may are sent to one task, where tiles are compared dimension by dimension: after 8, 16 and
32 leading ones, what the rest can add is bounded by the product of the two suffix norms (Cauchy-Schwarz), and
pairs that cannot reach the threshold stop there. What is left is summed in double precision over all dimensions
of the original vectors.

A pair of tiles returns sums (links by class) and a spanning forest of its links, never all pairs, so the output
is linear in what meets whatever the size of a crowd of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import cut
from vaultspark.llm.components import components
from vaultspark.llm.vectors import unit, usable

TILE, TILES = 2048, 8  # vectors in a tile, tiles in a group: a group of 64 doubles is 8 MB
STEPS = (8, 16, 32)  # leading dimensions after which the bound is looked at
BOX = 8  # leading axes of a group's box
STRIPE = 0.15  # width of a stripe of the first axis
SLACK = 1e-5  # far more than the error of float32


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """(width, width) rotation, axes of largest second moment first. The sums are made by partition."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                v = unit(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                total += v.T @ v
        r, c = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total.ravel())], names=["r", "c", "x"])

    sums = classes.select("v").mapInArrow(moments, "r int, c int, x double").groupBy("r", "c").agg(F.sum("x").alias("x")).collect()
    second = np.zeros((width, width))
    for row in sums:  # width x width numbers, whatever the table's size
        second[row["r"], row["c"]] = row["x"]
    return np.ascontiguousarray(np.linalg.eigh(second)[1][:, ::-1])


class Tile:
    """Vectors, rotated, with the norms of what follows each step."""

    def __init__(self, ids: np.ndarray, ns: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        self.ids, self.ns, self.unit = ids, ns, unit(vectors)
        turned = self.unit @ axes
        self.turned = turned.astype(np.float32)
        self.rest = {s: np.sqrt((turned[:, s:] ** 2).sum(axis=1)).astype(np.float32) for s in STEPS if s < turned.shape[1]}


def near_pairs(a: Tile, b: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), sorted by i, of the pairs with cosine >= threshold; i < j if the tiles are the same."""
    least, rows, cols = np.float32(threshold - SLACK), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(0, len(a.ids), 512):
        part = slice(start, start + 512)
        dots, done, i, j = None, 0, None, None
        for step in a.rest:
            more = slice(done, step)
            if i is None:  # many pairs are left: whole matrices
                product = a.turned[part, more] @ b.turned[:, more].T
                dots = product if dots is None else dots + product
                left = dots + np.outer(a.rest[step][part], b.rest[step]) >= least
                if np.count_nonzero(left) * 8 < left.size:
                    i, j = np.nonzero(left)
                    dots = dots[i, j]
            else:
                dots = dots + np.einsum("ij,ij->i", a.turned[part][i, more], b.turned[j, more])
                left = dots + a.rest[step][part][i] * b.rest[step][j] >= least
                i, j, dots = i[left], j[left], dots[left]
            done = step
        if i is None:
            i, j = np.nonzero(left if dots is not None else np.ones((len(a.ids[part]), len(b.ids)), bool))
        i = i + start
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 65536):
            p, q = i[k : k + 65536], j[k : k + 65536]
            near = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= threshold
            rows.append(p[near])
            cols.append(q[near])
    return np.concatenate(rows), np.concatenate(cols)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes, the smallest node that links (i, j) connect it to."""
    label = np.arange(n)
    by_j = np.argsort(j, kind="stable")
    sides = []
    for here, there in ((i, j), (j[by_j], i[by_j])):
        order = np.argsort(here, kind="stable")
        here, there = here[order], there[order]
        starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]]) if len(here) else np.empty(0, np.int64)
        sides.append((here[starts], there, starts))
    while True:
        before = label.copy()
        for nodes, there, starts in sides:
            if len(starts):
                label[nodes] = np.minimum(label[nodes], np.minimum.reduceat(label[there], starts))
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links are other vectors with cosine >= threshold.

    Null, zero and non-finite vectors link with nothing, nor do vectors of another length than the table's usual
    one, which have no cosine with the others; rows with a null key come back with a null component and kept
    false. Equal vectors link with each other. Keys are taken to be unique; a repeated key's rows count as one
    vector each. An empty table gives no rows; extra columns, whatever their names, are ignored.
    """
    rows = cut(usable(df, key, vector).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("v")))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    everything = df.select(F.col(key).cast("long").alias("key"))
    if width is None:
        return everything.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.col("key").isNotNull().alias("kept"))
    width = width["w"]
    rows = rows.filter(F.size("v") == width)
    classes = cut(rows.groupBy("h", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    axes, box = principal_axes(classes, width), min(BOX, width)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead = unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)) @ axes[:, :box]
                ends = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * box)
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(lead[:, 0] / STRIPE).astype(np.int32)), pa.array(lead[:, min(1, box - 1)]), pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), *batch.columns], names=["stripe", "y", "lead", "id", "n", "v"])

    laid = classes.select("id", "n", "v").mapInArrow(placed, "stripe int, y double, lead array<double>, id bigint, n bigint, v array<double>")
    ranged = laid.repartitionByRange(max(1, -(-classes.count() // (TILES * TILE))), "stripe", "y", "id").sortWithinPartitions("stripe", "y", "id")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the tile and the group of every row: numbers are the first ids in them."""
        stripe, filled, tiles, tile, group = None, 0, 0, 0, 0
        for batch in batches:
            at = 0
            own = batch.column(0).to_numpy()
            while at < batch.num_rows:
                if own[at] != stripe or filled == TILE:
                    tiles = 0 if own[at] != stripe or tiles == TILES else tiles
                    tile = batch.column(3)[at].as_py()
                    group = tile if tiles == 0 else group
                    stripe, filled, tiles = own[at], 0, tiles + 1
                stop = min(int(np.searchsorted(own, stripe, side="right")), at + TILE - filled)
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x, np.int64)) for x in (group, tile)] + part.columns, names=["g", "t", *batch.schema.names])
                filled, at = filled + stop - at, stop

    made = cut(ranged.mapInArrow(tiled, "g bigint, t bigint, stripe int, y double, lead array<double>, id bigint, n bigint, v array<double>"))
    ends = [x for k in range(box) for x in (F.min(F.col("lead")[k]), F.max(F.col("lead")[k]))]
    boxes = cut(made.groupBy("g", "stripe").agg(F.array(*ends[0::2]).alias("low"), F.array(*ends[1::2]).alias("high")))
    # Unit vectors with a cosine of c are sqrt(2 - 2 c) apart, and no nearer in any of their axes.
    apart = max(0.0, 2 - 2 * threshold) + SLACK
    reach = int(np.ceil(apart**0.5 / STRIPE))
    other = boxes.select(F.col("g").alias("h"), F.col("stripe").alias("near"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gap = F.aggregate(F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda p, q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda s, d: s + d * d)
    spread = boxes.withColumn("near", F.explode(F.sequence(F.col("stripe") - reach, F.col("stripe") + reach)))
    pairs = cut(spread.join(other, "near").filter((F.col("g") <= F.col("h")) & (gap <= apart)).select("g", "h"))
    # Both groups of a pair go to one task, the first one's vectors first.
    sides = pairs.select("g", "h", F.explode(F.array(F.struct(F.col("g").alias("of"), F.lit(0).alias("side")), F.struct(F.col("h").alias("of"), F.lit(1).alias("side")))).alias("s")).select("g", "h", "s.of", "s.side").filter("side = 0 or g <> h")
    met = sides.join(made.select(F.col("g").alias("of"), "t", "id", "n", "v"), "of").select("g", "h", "side", "t", "id", "n", "v")
    met = met.repartition(F.col("g"), F.col("h")).sortWithinPartitions("g", "h", "side", "t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, firsts, waiting = None, [], []

        def links(a: Tile, b: Tile) -> Iterator[pa.RecordBatch]:
            i, j = near_pairs(a, b, threshold, a is b)
            if not len(i):
                return
            ids, ns = (a.ids, a.ns) if a is b else (np.concatenate([a.ids, b.ids]), np.concatenate([a.ns, b.ns]))
            j = j if a is b else j + len(a.ids)
            sums = np.bincount(i, weights=ns[j], minlength=len(ids)) + np.bincount(j, weights=ns[i], minlength=len(ids))
            got, root = np.flatnonzero(sums), forest(i, j, len(ids))
            tied = got[root[got] != got]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[got], ids[tied]]), pa.array(np.r_[np.full(len(got), -1), ids[root[tied]]]), pa.array(np.r_[sums[got].astype(np.int64), np.zeros(len(tied), np.int64)]), pa.array(np.arange(len(got) + len(tied)) >= len(got))],
                names=["a", "b", "n", "is_link"],
            )

        def full() -> Iterator[pa.RecordBatch]:
            """Compares the tile that is whole now with the first group's tiles."""
            g, h, side, _ = now
            tile = Tile(*(np.concatenate([w[c] for w in waiting]) for c in range(3)), axes)
            waiting.clear()
            for one in firsts if side or g == h else ():
                yield from links(one, tile)
            if g == h:
                yield from links(tile, tile)
            if not side:
                firsts.append(tile)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
            ids, ns = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
            v = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist()
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                here = tuple(keys[a].tolist())
                if here != now:
                    if now is not None:
                        yield from full()
                        if here[:2] != now[:2]:
                            firsts.clear()
                    now = here
                waiting.append((ids[a:b], ns[a:b], v[a:b]))
        if now is not None:
            yield from full()

    found = cut(met.mapInArrow(compare, "a bigint, b bigint, n bigint, is_link boolean"))
    counts = found.filter("not is_link").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    groups = components(found.filter("is_link").select("a", "b"))
    by_class = classes.join(counts, "id", "left").join(groups, "id", "left").select("h", "v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    by_row = rows.join(by_class, ["h", "v"]).select("id", "n_links", "component_id")
    joined = everything.join(by_row.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), F.col("key") == F.col("id"), "left")
    component = F.coalesce("component_id", "key")
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(False)).alias("kept"))
