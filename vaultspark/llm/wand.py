"""Operator 12: ranked lexical search by WAND over document shards.

One scan counts the terms of the queries in every document. What it finds is dealt to shards; a shard holds posting
lists of terms with the largest impact of each. A query walks a shard in windows of documents, keeping the k best so
far. A document is a pivot if the maxima of the lists that it is in sum to the k-th best score at least: all others
can't enter and are skipped. Lists whose maxima together stay below it can't make a pivot by themselves, so they are
never walked, only looked up for pivots, strongest first, until what is left can't lift a document any more. All pivots
of a window are told in one numpy step; the threshold rises from window to window, and from shard to shard of a task.
The shards' heaps are merged in the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.llm.common import cut, give_back

SHARD = 1 << 20  # postings of a shard, about
BLOCK_BYTES = 4 << 20  # bytes of query texts that are searched in one scan; a larger query set takes more scans
FIRST_WINDOW = 256  # documents; each next window is twice as wide
#: Term characters are 0-9, A-Z as a-z, and all that is not ASCII; in UTF-8 that is every byte from 0x80.
_BYTES = bytes(c | 0x20 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def norm(length: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 100 - 90 + 90 * length * documents // total


def impact(weights: np.ndarray, tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * norms))


class Shard:
    """Posting lists of some documents, which are in the order of their keys: positions, impacts, and each list's maximum."""

    def __init__(self, size: int, docs: np.ndarray, ids: np.ndarray, impacts: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.size, self.docs, self.impacts = size, docs[order], impacts[order]
        self.ids, self.starts = np.unique(ids[order], return_index=True)
        self.maxima = np.maximum.reduceat(self.impacts, self.starts) if len(ids) else np.zeros(0, np.int64)
        self.ends = np.append(self.starts[1:], len(ids))
        self.floors: dict[tuple[int, int], int] = {}
        self.scored = 0  # documents that were scored to the end

    def _floor(self, at: int, k: int) -> int:
        """The k-th largest impact of a list: k documents score that much by its term alone."""
        if (at, k) not in self.floors:
            own = self.impacts[self.starts[at] : self.ends[at]]
            self.floors[at, k] = int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else 0
        return self.floors[at, k]

    def search(self, query: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the k best documents of the shard for sorted term ids, of those that score `least` or more; ties to the earlier."""
        at = np.searchsorted(self.ids, query)
        at = at[(at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == query)] if len(self.ids) else at[:0]
        at = at[self.maxima[at] > 0]
        at = at[np.argsort(self.maxima[at], kind="stable")]  # weakest first
        lists = [(self.docs[a:b], self.impacts[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]
        maxima = self.maxima[at]
        reach = np.cumsum(maxima)  # what a document in the first lists alone can score
        least = max([least, *(self._floor(i, k) for i in at.tolist())])
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, width = 0, FIRST_WINDOW
        while low < self.size:
            high = min(self.size, low + width)
            weak = int(np.searchsorted(reach, least))  # lists that can't make a pivot by themselves
            if weak == len(lists):
                break
            parts = []
            for docs, impacts in lists[weak:]:
                a, b = np.searchsorted(docs, (low, high))
                parts.append((docs[a:b] - low, impacts[a:b]))
            docs, impacts = (np.concatenate(x) for x in zip(*parts))
            bound = np.bincount(docs, weights=np.repeat(maxima[weak:], [len(p[0]) for p in parts]), minlength=high - low)
            met = np.bincount(docs, weights=impacts, minlength=high - low)  # sums below 2**53: exact
            pivots = np.flatnonzero((bound > 0) & (bound + (reach[weak - 1] if weak else 0) >= least))
            scores = met[pivots].astype(np.int64)
            for k_list in range(weak - 1, -1, -1):  # weak lists, strongest first
                live = scores + reach[k_list] >= least
                pivots, scores = pivots[live], scores[live]
                docs, impacts = lists[k_list]
                where = np.minimum(np.searchsorted(docs, pivots + low), len(docs) - 1)
                scores = scores + np.where(docs[where] == pivots + low, impacts[where], 0)
            self.scored += len(pivots)
            live = scores >= least
            best_at, best = np.concatenate([best_at, pivots[live] + low]), np.concatenate([best, scores[live]])
            order = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[order], best[order]
            if len(best) == k:
                least = max(least, int(best[-1]))
            low, width = high, 2 * width
        return best_at, best


def _count(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, length, ids, tfs) of every document with a term: its size in terms, and how often it holds those of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.get
        for batch in batches:
            lengths, sizes, ids, tfs = [], [], [], []
            for t in batch.column(1):
                words = terms(t.as_py() or b"")
                found = Counter(filter(None, map(known, words)))
                lengths.append(len(words))
                sizes.append(len(found))
                ids.append(np.fromiter(found.keys(), np.int32, len(found)))
                tfs.append(np.fromiter(found.values(), np.int64, len(found)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            nested = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((ids, pa.int32()), (tfs, pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *nested], ["key", "length", "ids", "tfs"])
            yield out.filter(pc.greater(out.column(1), 0))
            give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, f"key {kind}, length bigint, ids array<int>, tfs array<bigint>")


def _heaps(counts: DataFrame, queries: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(query, key, score): the k best of what each task has read."""
    sent = counts.sparkSession.sparkContext.broadcast((queries, weights))  # one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = sent.value
        heaps: list[list[tuple]] = [[] for _ in queries]

        def shard(rows: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(rows)
            table = table.take(pc.sort_indices(table, [("key", "ascending")], null_placement="at_start")).combine_chunks()
            keys, (ids, tfs) = table.column("key"), (table.column(c).combine_chunks() for c in ("ids", "tfs"))
            sizes = np.diff(ids.offsets.to_numpy())
            docs = np.repeat(np.arange(len(keys)), sizes)
            ids, tfs = ids.flatten().to_numpy(), tfs.flatten().to_numpy()
            lengths = table.column("length").to_numpy()
            here = Shard(len(keys), docs, ids, impact(weights[ids], tfs, norm(lengths, documents, total)[docs]))
            for heap, query in zip(heaps, queries):
                at, score = here.search(query, k, -heap[-1][0] if len(heap) == k else 1)
                for p, s in zip(at.tolist(), score.tolist()):
                    name = keys[p].as_py()
                    heap.append((-s, name is not None, name))
                heap.sort()
                del heap[k:]

        rows, size, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field("key").type
            step = max(1, batch.num_rows * SHARD // max(1, len(batch.column("ids").flatten())))
            for a in range(0, batch.num_rows, step):
                rows.append(batch.slice(a, step))
                size += len(rows[-1].column("ids").flatten())
                if size >= SHARD:
                    shard(rows)
                    rows, size = [], 0
        if rows:
            shard(rows)
        if kind is not None:
            found = [(q, x[2], -x[0]) for q, heap in enumerate(heaps) for x in heap]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], ["query", "key", "score"])
        give_back()

    kind = counts.schema["key"].dataType.simpleString()
    return counts.mapInArrow(run, f"query int, key {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): the k best documents with a score above 0 for each row of items, best first, ties to the smaller key.

    Each row of items is a query of its own, with each of its terms once; rows of items that repeat give repeated
    rankings. Rows of docs are documents of their own, too, a null key before all others. Null, empty and term-free
    texts are no documents and no queries; texts of any length are counted whole. Empty tables give no rows. Other
    columns, whatever their names, are not looked at.

    Items are searched in blocks of about BLOCK_BYTES bytes of text (one item is never split), and each block takes
    one scan of docs; what a block's terms need is broadcast. Counts are written to the shared folder and statistics
    are collected (one number a term of the block) while the plan is built.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("t"))
    blocks = -(-(asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES)
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r["item"] is not None, r["item"], r["t"] or b""))
        vocabulary: dict[bytes, int] = {}
        queries = [np.unique([vocabulary.setdefault(w, len(vocabulary) + 1) for w in terms(r["t"] or b"")]).astype(np.int32) for r in rows]
        counts = cut(_count(docs, key, text, vocabulary))
        size = counts.agg(F.count("*").alias("documents"), F.sum("length").alias("total"), F.sum(F.size("ids").cast("long")).alias("postings")).first()
        if not size["postings"]:
            continue
        weights = np.zeros(len(vocabulary) + 1, np.int64)
        for r in counts.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
            weights[r["id"]] = weight(size["documents"], r["count"])
        hits = counts.filter(F.size("ids") > 0).repartition(-(-size["postings"] // SHARD))
        heaps = _heaps(hits, queries, weights, size["documents"], size["total"], k)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_first())
        best = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"query int, item {asked.schema['item'].dataType.simpleString()}")
        found = best.join(F.broadcast(names), "query").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    kinds = f"{item} {asked.schema['item'].dataType.simpleString()}, rank int, {key} {docs.schema[key].dataType.simpleString()}, score bigint"
    return out if out is not None else spark.createDataFrame([], kinds)
