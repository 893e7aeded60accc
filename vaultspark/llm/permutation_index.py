"""Operator 10: approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Vectors are posted under the nearest of a few coarse
pivots, their cell; large cells are cut by hash. In a cell, every pivot has an inverted file: the places at which
the cell's vectors rank it, absent ones counted as just past the end of the prefix. A query is sent to the cells
of its own nearest coarse pivots only, adds up from the files of its prefix the differences of places, which is
the footrule distance of the two prefixes, and reranks the best by cosine in double precision on the original
vectors. The cells' best are merged.

How many cells a query visits is learned: neighbours within a bounded sample tell how far down a query's list of
cells the cell of a neighbour stands. Clustered vectors need few cells, isotropic ones most of them. A share of a
cell is reranked; as long as the further half of what was reranked still changes the query's best, twice as many
follow, so a crowd of near copies, which footrule hardly tells apart, is reranked whole.

Pivots come from the same sample (the rows of smallest hash); every row is posted. Equal vectors are posted once
with their smallest ids, enough for the answer however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.llm.common import cut
from vaultspark.llm.vectors import unit, usable

SAMPLE, SAMPLE_BYTES = 4096, 32_000_000  # rows that pivots and probes are learned from, at most, and their bytes
PIVOTS = 512  # reference vectors, at most
PREFIX = 256  # nearest pivots kept of a vector
CELL, SHARD = 2048, 4096  # vectors of a cell, about, while there are pivots for cells; and of a part of a large cell
COVERED = 0.99  # share of neighbours in the sample whose cell a query visits
SHARE, LEAST = 0.06, 64  # of a cell that a query reranks first
QUERIES = 64  # queries that are compared with a cell together


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(n, prefix) pivot numbers, nearest first, ties to the smaller number."""
    return np.argsort(-(unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :prefix]


def probes(sample: np.ndarray, coarse: np.ndarray, k: int, covered: float | None = None) -> int:
    """Cells to visit so that `covered` of the k nearest neighbours of sampled vectors are in one of them."""
    if len(coarse) < 2 or len(sample) < 2:
        return len(coarse)
    asked = sample[-256:]
    score = asked @ sample.T
    score[score > 1 - 1e-9] = -2  # itself
    near = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    cell = nearest_pivots(sample, coarse, 1)[:, 0]
    place = np.argsort(nearest_pivots(asked, coarse, len(coarse)), axis=1)
    found = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(found[int(np.ceil((COVERED if covered is None else covered) * len(found))) - 1]) + 1


class Shard:
    """Inverted files over some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.ids, self.unit, self.pivots = ids, unit(vectors), pivots
        order = nearest_pivots(vectors, pivots, prefix)
        self.prefix = order.shape[1]
        #: The file of each pivot: a place for every vector.
        self.files = np.full((len(pivots), len(vectors)), self.prefix, np.int16)
        self.files[order, np.arange(len(vectors))[:, None]] = np.arange(self.prefix, dtype=np.int16)[None, :]

    def footrule(self, queries: np.ndarray) -> np.ndarray:
        """(queries, vectors) footrule distances over the queries' prefixes."""
        order = nearest_pivots(queries, self.pivots, self.prefix)
        total = np.zeros((len(queries), len(self.unit)), np.int32)
        for place in range(self.prefix):
            total += np.abs(self.files[order[:, place]] - np.int16(place))
        return total

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, cosines) of the k best that each query's reranking finds, ties to the smaller id."""
        n, asked = len(self.unit), unit(queries)
        first = min(n, max(LEAST, int(np.ceil(SHARE * n))))
        far = self.footrule(queries)
        for q in range(len(queries)):
            done, most = np.empty(0, np.int64), first
            rows, score = done, np.empty(0)
            while True:
                order = np.argpartition(far[q], most - 1)[:most]
                order = order[np.lexsort((order, far[q][order]))]
                half = order[len(order) // 2 :]
                fresh = order[~np.isin(order, done)] if len(done) else order
                done = order
                rows, score = np.concatenate([rows, fresh]), np.concatenate([score, np.einsum("ij,j->i", self.unit[fresh], asked[q])])
                best = np.lexsort((self.ids[rows], -score))[:k]
                if most == n or not np.isin(rows[best], half).any():
                    break
                most = min(n, 2 * most)
            yield q, rows[best], score[best]


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest index rows found for each query, its own id left out.

    Score is the cosine in double precision; ties go to the smaller id. All candidates if there are fewer than
    k. Vectors that are null, zero or not finite take no part on either side, nor do those of another length than
    the index's usual one, which have no cosine with the others. Rows that repeat an id of the index stand for
    one candidate by vector, repeated query ids for one query (the first by vector). An empty side gives no rows;
    extra columns, whatever their names, are ignored.
    """
    spark = index.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = cut(usable(index, key, vector).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return empty
    width = width["w"]
    rows = rows.filter(F.size("v") == width)
    # The k + 1 smallest ids of equal vectors are all that an answer can hold; salted, as copies may be many.
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    within = Window.partitionBy("v", "salt").orderBy("id")
    few = salted.withColumn("n", F.dense_rank().over(within)).filter(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(smallest(F.collect_set("id")).alias("ids"))
    classes = cut(classes.withColumn("id", F.element_at("ids", 1)))
    total = classes.count()
    sampled = classes.select("v").orderBy(F.xxhash64("v")).limit(max(2, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).collect()
    sample = unit(np.array([r["v"] for r in sampled]))
    pivots = sample[: max(1, min(PIVOTS, total // 2))]
    prefix, coarse = max(1, min(PREFIX, len(pivots) // 2)), pivots[: max(1, min(len(pivots), round(total / CELL)))]
    visited = probes(sample, coarse, k)

    def posted(df: DataFrame, most: int) -> DataFrame:
        """(cell, id, v): every vector under the `most` nearest coarse pivots."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = nearest_pivots(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), coarse, most)
                    for place in range(cells.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(cells[:, place].astype(np.int32)), batch.column(0), batch.column(1)], names=["cell", "id", "v"])

        return df.select("id", "v").mapInArrow(run, "cell int, id bigint, v array<double>")

    asked = cut(usable(queries, key, vector).filter(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v")))
    homes = cut(posted(classes, 1))
    lots = F.broadcast(homes.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).alias("lots")))  # a row for each cell: PIVOTS at most
    own = homes.join(lots, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int").alias("lot"), F.lit(0).alias("kind"), "id", "v")
    sent = posted(asked, visited).join(lots, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("lots").cast("int") - 1)).alias("lot"), F.lit(1).alias("kind"), "id", "v")
    # A part of a cell and the queries that visit it meet in one task, the part's vectors first.
    met = own.unionByName(sent).repartition(F.col("cell"), F.col("lot")).sortWithinPartitions("cell", "lot", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        vectors: list[tuple] = []
        waiting: list[tuple] = []

        def joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            out = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            parts.clear()
            return out

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if not waiting:
                return
            ids, asked_for = joined(waiting)
            if shard is None:
                if not vectors:
                    return
                shard = Shard(*joined(vectors), pivots, prefix)
            for a in range(0, len(ids), QUERIES):
                q, r, s = zip(*shard.search(asked_for[a : a + QUERIES], k + 1))
                sizes = [len(x) for x in r]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a : a + QUERIES][list(q)], sizes)), pa.array(shard.ids[np.concatenate(r)]), pa.array(np.concatenate(s))], names=["query_id", "id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, lot, kind, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            v = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (lot[1:] != lot[:-1]) | (kind[1:] != kind[:-1])]).tolist()
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if (cell[a], lot[a]) != now:
                    yield from answers()
                    now, shard = (cell[a], lot[a]), None
                    vectors.clear()
                (waiting if kind[a] else vectors).append((ids[a:b], v[a:b]))
                if kind[a] and sum(len(x[0]) for x in waiting) >= 8 * QUERIES:
                    yield from answers()
        yield from answers()

    found = met.mapInArrow(search, "query_id bigint, id bigint, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    named = best.join(classes.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
