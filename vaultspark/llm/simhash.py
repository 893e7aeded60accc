"""Operator 5: near-duplicate documents by SimHash, with candidates from the perfect binary Golay code.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in r <= 5 bits differ in at
most two bits in each of two segments (if two segments differed in three or more, r would be six or more).
The [23, 12, 7] Golay code is perfect: every 23-bit word decodes to one codeword. A segment's keys are the
codewords that it and its one-bit neighbours decode to (one or six); words within two bits share one, since
they share a neighbour. So every pair of fingerprints within the radius shares a key of two segments, and
pairs are verified by counting bits. For r <= 3 two segments differ by at most one bit each, and then one
side needs its own codewords only, which is what makes candidates rare.

Groups of equal keys are read in key order from a sorted partition. Inside a group, links are followed
breadth-first and each fingerprint is reported once, so n fingerprints that are all near each other give
n - 1 links and not n(n - 1) / 2; what was reached is never compared again.

Before two sets of shingles are compared, their sketches are: counts in equal ranges of the hash, whose smaller
ones sum up to no fewer than the sets share.

`keep_one` needs every pair of some Jaccard similarity, which no radius vouches for and a forest of unverified
links does not keep together. What fingerprints miss comes from an exact prefix filter: of n shingles in one
global order, sets as similar as t share one of their first n - ceil(t n) + 1. The order is by hash, shingles
that a sample finds in many documents last; it decides the cost and never the result. Few documents under a
shingle are paired out; many are compared with a few pivots a round, which then leave, until all that is left
under the shingle is connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import cut, discard, give_back, small
from vaultspark.llm.components import components, contracted, pivoted

#: Generator polynomial of the [23, 12, 7] Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GOLAY = 0b101011100011
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # (shift, bits), padded with zeros to 23
PAIRS = ((0, 1), (0, 2), (1, 2))
HOT = 16  # documents under a shingle that are still paired out
SAMPLE, OFTEN, LATE = 64, 3, 50_000  # shingles in OFTEN of every SAMPLE-th document come late in the order, LATE at most


def _remainders() -> np.ndarray:
    """Remainder of x^i modulo the generator, for i < 23."""
    out, now = [], 1
    for _ in range(23):
        out.append(now)
        now <<= 1
        if now >> 11:
            now ^= GOLAY
    return np.array(out, dtype=np.uint32)


class _Golay:
    """Decoding by syndrome: all patterns of up to three errors have different syndromes, 2048 in all."""

    def __init__(self):
        rem = _remainders()
        self.low, self.high = (self._table(rem[a:b]) for a, b in ((0, 12), (12, 23)))
        self.error = np.zeros(2048, dtype=np.uint32)
        bits = 1 << np.arange(23, dtype=np.uint32)
        for i in range(23):
            self.error[rem[i]] = bits[i]
            for j in range(i):
                self.error[rem[i] ^ rem[j]] = bits[i] | bits[j]
                for k in range(j):
                    self.error[rem[i] ^ rem[j] ^ rem[k]] = bits[i] | bits[j] | bits[k]

    @staticmethod
    def _table(rem: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << len(rem), dtype=np.uint32)
        for i, r in enumerate(rem):
            out[1 << i : 2 << i] = out[: 1 << i] ^ r
        return out

    def index(self, words: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword nearest to each 23-bit word."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11


_CODE: list[_Golay] = []


def golay_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(n,) own index and (n, bits + 1) sorted indices of the word and its one-bit neighbours; repeats are -1."""
    if not _CODE:
        _CODE.append(_Golay())
    words = words.astype(np.uint32)
    flips = np.concatenate([np.zeros(1, np.uint32), 1 << np.arange(bits, dtype=np.uint32)])
    near = _CODE[0].index(words[:, None] ^ flips[None, :]).astype(np.int64)
    own = near[:, 0].copy()
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return own, near


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    import xxhash

    hash_of = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hash_of(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[size - 1 :].tolist()
    return np.array([hash_of(text[a:b], 42) for a, b in zip(starts.tolist(), ends)], dtype=np.uint64)


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only


def _bits(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; no hashes: 0."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_ = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(set_.view(np.uint64)[0]) if len(hashes) else 0


def _prefix(rows: np.ndarray, similarity: float, late: np.ndarray) -> np.ndarray:
    """Those of a sorted set of shingles of which a set as similar shares one: hashes in order, `late` ones last."""
    last = late[np.minimum(np.searchsorted(late, rows), len(late) - 1)] == rows if len(late) else np.zeros(len(rows), bool)
    rows = np.concatenate([rows[~last], rows[last]])
    return rows[: len(rows) - math.ceil(similarity * len(rows) - 1e-9) + 1]


BUCKET = 4  # shingles in a bucket of a sketch, about


def _sketch(hashes: np.ndarray) -> bytes:
    """How many different shingles fall into each of 2^k buckets of equal hash range, BUCKET or up to twice as many in each: one byte a count.

    Empty where a count does not fit, which says nothing about the set.
    """
    level = max(0, (len(hashes) // BUCKET).bit_length() - 1)
    counts = np.bincount((hashes >> np.uint64(1)) >> np.uint64(63 - level), minlength=1 << level) if len(hashes) else np.zeros(1, np.int64)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


RANGES = 10  # bits: 1024 ranges, so that a page's few hundred shingles leave most of them empty


def _ranges(hashes: np.ndarray) -> np.ndarray:
    """Which of 1 << RANGES equal ranges of the hash hold a shingle, as 64-bit words."""
    held = np.zeros(1 << RANGES, np.uint8)
    held[(hashes >> np.uint64(64 - RANGES)).astype(np.int64)] = 1
    return np.packbits(held, bitorder="little").view(np.int64)


def may_overlap(n: Column, bits: Column, m: Column, other: Column, similarity: float) -> Column:
    """False only for sets that cannot be similar: every range that one holds and the other does not is a shingle not shared."""
    alone = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)
    return F.least(n - alone(bits, other), m - alone(other, bits)) * (1 + similarity) >= similarity * (n + m) - 1e-9


def overlap(x: bytes, y: bytes, n: int) -> int:
    """No fewer than the shingles that two sets share, from their sketches; at most n, the smaller set's size."""
    if not x or not y:
        return n
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(a) > len(b):
        a, b = b, a
    return min(n, int(np.minimum(a, b.reshape(len(a), -1).sum(axis=1)).sum()))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, similarity: float | None = None, late: np.ndarray | None = None) -> DataFrame:
    """(key, fp long, digest long) of every row, repeats included; null texts count as empty.

    With `similarity`, also (n int, prefix array<long>, sketch binary, bits array<long>): how many different
    shingles, those that _prefix gives, and what _sketch and _ranges give.

    Words are runs of anything but ASCII white space, after lower-casing A-Z; fewer words than `size` form
    one shingle. `digest` is XXH64 of the words joined by spaces, to tell equal texts from equal fingerprints.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, fp bigint, digest bigint" + (", n int, prefix array<bigint>, sketch binary, bits array<bigint>" if similarity else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fp, digest, n, prefix, sketch, bits = [], [], [], [], [], []
            for t in batch.column(1):
                words = _words(t.as_py())
                hashes = _shingle_hashes(words, size)
                fp.append(_bits(hashes))
                if similarity:
                    rows = np.unique(hashes)
                    n.append(len(rows))
                    prefix.append(_prefix(rows, similarity, late).view(np.int64))
                    sketch.append(_sketch(rows))
                    bits.append(_ranges(rows))
                digest.append(xxhash.xxh64_intdigest(b" ".join(words), 42))
            as_long = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fp, digest)]
            more = [pa.array(n, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(bits, pa.list_(pa.int64()))] if similarity else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *as_long, *more], names=[key, "fp", "digest", "n", "prefix", "sketch", "bits"][: 3 + len(more)])
            give_back()

    return df.select(key, text).mapInArrow(run, schema)


def _keys(classes: DataFrame, radius: int) -> DataFrame:
    """(k, id, fp, own) with one row for each key of each class; `own` tells the keys any partner of which counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                fps = batch.column(1).to_numpy(zero_copy_only=False)
                own, near = zip(*(golay_indices((fps.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << n) - 1), n) for s, n in SEGMENTS))
                keys, rows, alone = [], [], []
                for p, (i, j) in enumerate(PAIRS):
                    r, a, b = np.nonzero((near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0))
                    keys.append(np.int64(p) << 24 | near[i][r, a] << 12 | near[j][r, b])
                    rows.append(r)
                    mine = keys[-1] == (np.int64(p) << 24 | own[i][r] << 12 | own[j][r])
                    alone.append(mine if radius <= 3 else np.ones(len(r), bool))
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(ids[rows]), pa.array(fps[rows]), pa.array(np.concatenate(alone))], names=["k", "id", "fp", "own"])

    return classes.select("id", "fp").mapInArrow(run, "k int, id bigint, fp bigint, own boolean")


def _forest(fps: np.ndarray, reach: int) -> tuple[list[int], list[int]]:
    """Links (i, j) of a spanning forest of the fingerprints within `reach` bits."""
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        todo = [rest[0]]
        rest = rest[1:]
        while todo and len(rest):
            now = todo.pop()
            near = np.bitwise_count(fps[rest] ^ fps[now]) <= reach
            if near.any():
                met = rest[near]
                rest = rest[~near]
                left += [now] * len(met)
                right += met.tolist()
                todo += met.tolist()
    return left, right


def _near(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal k of sorted batches. Runs of two go through numpy together."""
    names = ["a", "b"]

    def links(k: np.ndarray, ids: np.ndarray, fps: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(k)])
        owners = np.add.reduceat(own.astype(np.int64), starts) if len(k) else starts
        two = starts[(sizes == 2) & (owners > 0)]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= reach]
        a, b = [ids[two]], [ids[two + 1]]
        for s, n in zip(starts[(sizes > 2) & (owners > 0)].tolist(), sizes[(sizes > 2) & (owners > 0)].tolist()):
            i, j = _forest(fps[s : s + n], reach)
            a.append(ids[s : s + n][i])
            b.append(ids[s : s + n][j])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)

    for k, ids, fps, own in _runs(batches):
        yield links(k, ids, fps.view(np.uint64), own)  # bitwise_count of a signed number counts its absolute value


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, dealt anew so that no run of equal values of the first goes on past a piece."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        if held and now[0][-1] == held[0][0][-1]:  # the run goes on past this batch
            held.append(now)
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        yield [np.concatenate([h[i] for h in held] + [x[:last]]) for i, x in enumerate(now)]
        held = [[x[last:] for x in now]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def links(classes: DataFrame, radius: int = 3, reach: int | None = None) -> DataFrame:
    """Links (a > b, both ids) that connect exactly what links of at most `radius` bits connect (radius up to 5).

    classes: (id long, fp long), one row per distinct fingerprint. The links span: within a key group only a
    forest is given. With `reach` above `radius`, links of up to `reach` bits that share a key come too.
    """
    if radius > 5:
        raise ValueError("two Golay segments vouch for at most 5 differing bits")
    reach = radius if reach is None else reach
    keyed = _keys(classes, radius).repartition(F.col("k")).sortWithinPartitions("k")
    return keyed.mapInArrow(lambda batches: _near(batches, reach), "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp, component_id) of every row: component_id is the smallest key reachable by links of <= radius bits.

    Texts without words have fingerprint zero and link like any other; null texts count as empty; an empty
    table gives no rows; extra columns, whatever their names, are ignored; texts of any length count whole. Rows that repeat a key are kept as rows; null keys get
    the component of the equal fingerprints. Equal fingerprints are one class before anything is compared.
    """
    docs = df.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text"))  # own names, whatever those of df
    prints = cut(fingerprints(docs, "doc_key", "doc_text", size).select("doc_key", "fp"))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_key").alias("id")))
    found = components(links(classes.filter("id is not null"), radius))
    named = classes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp").select(F.col("doc_key").alias(key), "fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 5, reach: int = 14) -> DataFrame:
    """Rows of df without near-duplicates: of each group the row with the smallest key stays.

    Documents link if the Jaccard similarity of their sets of `size`-word shingles is `similarity` or more, and
    every such pair ends in one group: candidates are fingerprints within `radius` bits, or `reach` where they share
    a key, and then all that an exact prefix filter leaves and that is not connected yet. Equal word sequences
    always link. Documents without words are one group. Columns stay as they are, whatever their names; rows with a
    null key stay; of rows that repeat a key one stays. Texts of any length count whole. Similarity is that of sets of
    32-bit hashes of shingles: equal hashes of different shingles shift it by about n / 2 ** 32 for n shingles.
    """
    docs = df.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text"))  # own names, whatever those of df
    prints = cut(fingerprints(docs, "doc_key", "doc_text", size, similarity, _often(docs, "doc_key", "doc_text", size)))
    classes = cut(prints.groupBy("fp", "digest").agg(F.min("doc_key").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits")).filter("id is not null"))
    maybe = cut(links(classes, radius, reach))
    met = cut(_met(classes, similarity))
    pairs, hot = met.filter("k is null").select("a", "b").distinct(), met.filter("k is not null").select("k", F.col("a").alias("id"))
    hot = cut(hot.join(classes.select("id", F.struct("n", "bits").alias("n")), "id").select("k", "id", "n"))
    sketches = classes.select("id", "n", "sketch")

    @F.arrow_udf("boolean")
    def may_be_alike(n: pa.Array, m: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for n_, m_, x_, y_ in zip(n.to_pylist(), m.to_pylist(), x.to_pylist(), y.to_pylist()):
            out.append(overlap(x_, y_, min(n_, m_)) * (1 + similarity) >= similarity * (n_ + m_) - 1e-9)
        return pa.array(out, pa.bool_())

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            p, q = (v.values.to_numpy(zero_copy_only=False) for v in (p, q))
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= similarity * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    def verified(some: DataFrame) -> DataFrame:
        """Pairs of `some` that are similar. Sketches, of some bytes for each document, rule most others out before sets are read."""
        some = cut(some)
        if some.isEmpty():
            return some
        sided = small(some).join(sketches.toDF("a", "n", "x"), "a").join(sketches.toDF("b", "m", "y"), "b")
        left = cut(sided.filter(may_be_alike("n", "m", "x", "y")).select("a", "b"))
        if left.isEmpty():
            return left
        ends = cut(left.select(F.col("a").alias("end")).union(left.select("b")).distinct())
        sets = cut(shingle_sets(docs.join(small(ends), F.col("doc_key") == F.col("end"), "left_semi"), "doc_key", "doc_text", size).groupBy(F.col("doc_key").alias("id")).agg(F.first("shingles").alias("shingles")))
        sided = small(left).join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        out = cut(sided.filter(alike("x", "y")).select("a", "b"))
        discard(some, left, ends, sets)
        return out

    near = cut(components(verified(maybe)))
    sided = pairs.join(maybe, ["a", "b"], "left_anti").join(near.toDF("a", "ca"), "a", "left").join(near.toDF("b", "cb"), "b", "left")
    near = contracted(near, verified(sided.filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")))
    found = pivoted(hot, near, verified, may_overlap(F.col("pn.n"), F.col("pn.bits"), F.col("n.n"), F.col("n.bits"), similarity))
    losers = found.filter("id <> component").select("id")
    gone = prints.join(classes.withColumnRenamed("id", "first"), ["fp", "digest"]).join(losers, F.col("first") == F.col("id"), "left").filter(F.col("doc_key").isNotNull() & ((F.col("doc_key") != F.col("first")) | F.col("id").isNotNull())).select(F.col("doc_key").alias("gone_key")).distinct()
    return df.join(gone, df[key] == gone["gone_key"], "left_anti")


def _often(df: DataFrame, key: str, text: str, size: int) -> np.ndarray:
    """Sorted hashes of shingles that a sample of the documents holds often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_shingle_hashes(_words(t.as_py()), size)).view(np.int64))], names=["k"])

    some = df.filter(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0).select(text).mapInArrow(run, "k bigint")
    often = some.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "k").limit(LATE)
    return np.sort(np.array([r["k"] for r in often.collect()], dtype=np.int64).view(np.uint64))


def _met(classes: DataFrame, similarity: float) -> DataFrame:
    """(null, a, b, null) of classes (id, n, prefix) under one shingle; (k, id, null, n) where it has more than HOT of them."""

    def pair_out(k: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(k)])
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in range(2, HOT + 1):
            at = starts[sizes == size]
            for i in range(size if len(at) else 0):
                for j in range(i):
                    left.append(at + i)
                    right.append(at + j)
        a, b = np.concatenate(left), np.concatenate(right)
        fits = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
        a, b = ids[a[fits]], ids[b[fits]]
        many = np.repeat(sizes > HOT, sizes)
        columns = [
            pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(k[many], pa.int64())]),
            pa.array(np.r_[np.maximum(a, b), ids[many]], pa.int64()),
            pa.concat_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.nulls(int(many.sum()), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(a), pa.int32()), pa.array(n[many], pa.int32())]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["k", "a", "b", "n"])

    keyed = classes.select(F.explode("prefix").alias("k"), "id", "n").repartition(F.col("k")).sortWithinPartitions("k")
    return keyed.mapInArrow(lambda batches: (pair_out(*run) for run in _runs(batches)), "k bigint, a bigint, b bigint, n int")


def shingle_sets(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, shingles array<int>): the sorted set of 32-bit hashes of each row's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(_shingle_hashes(_words(t.as_py()), size).astype(np.uint32).view(np.int32)) for t in batch.column(1)]
            ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *rows])))], names=[key, "shingles"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, shingles array<int>")
