"""Operator 1: mixing sources to target weights by a multivariate-hypergeometric splitting tree. Native.

Documents of a source are dealt by hash into blocks of about `BLOCK` documents. A source's target is met by
whole passes over its blocks and one pass over a part of them, in permuted order; the block at the border is
filled document by document, so a target is missed by less than the smallest document left out there. How many
block draws of each source each output shard gets is settled by a binary tree over the shards: a node hands its
left half an exact number of draws, split over the sources by multivariate-hypergeometric variates (a chain of
hypergeometric ones, each by inversion from its mode), and the rest to its right half. The leaves are exact
quotas; each shard then takes the next, disjoint, run of a source's permuted blocks and is shuffled locally.

Everything follows from hashes of keys and a seed, so reruns agree. Whatever grows with the sources' rows is
summed before it is shuffled: a hot source has many blocks, and running sums go over blocks of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.llm.common import WORD, cut

BLOCK = 256  # documents in a block, about
RUN = 1024  # blocks in a block of blocks
SHARD_WORDS = 25_000_000  # words of a shard, about
LEAST_SHARDS = 8  # however few words there are, so that the tree splits at every size
SEED = 17


def _order(key: str, source: str, text: str) -> Column:
    """A document's hash: equal for rows that repeat a key; rows without a key go by their text."""
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))).otherwise(F.xxhash64(F.lit("no key"), F.col(text), F.col(source)))


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, sid, source_size, n, target) from (source, size, n): one row a source.

    Sources go by code point, null last; weights repeat. Targets share `share` times all words by weight, none
    above `most` times its source's words; what is above goes to the others by weight. In order of cap by
    weight the capped sources come first, which gives the common level in one pass.
    """
    ordered = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    known = ordered.withColumn("w", F.element_at(listed, (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("size") * F.lit(float(most)))
    every = Window.partitionBy()
    run = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = known.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    leveled = leveled.withColumn("common", F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("r"), "sid", "level"))).over(every)["level"]).drop("fits")
    return leveled.select("source", "sid", F.col("size").alias("source_size"), "n", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("w"), F.col("cap"))).alias("target"))


def _variate(total: str, good: str, drawn: str, u: str) -> str:
    """SQL: a hypergeometric variate by inversion: good ones among `drawn` of `total` of which `good` are good.

    Probabilities are walked outwards from the mode, by the ratio of neighbours; beyond twelve standard
    deviations they are below the precision of u and are not walked.
    """
    low, high = f"greatest(0L, {drawn} - ({total} - {good}))", f"least({drawn}, {good})"
    mode = f"least(greatest(cast(floor(({drawn} + 1.0D) * ({good} + 1.0D) / ({total} + 2.0D)) as bigint), {low}), {high})"
    reach = f"cast(12 * sqrt({drawn} * ({good} / greatest({total}, 1.0D))) + 12 as bigint)"
    up = f"if(m < least({high}, m + {reach}), sequence(m + 1L, least({high}, m + {reach})), cast(array() as array<bigint>))"
    down = f"if(m > greatest({low}, m - {reach}), sequence(m - 1L, greatest({low}, m - {reach})), cast(array() as array<bigint>))"
    rise = f"(s.w * ({good} - k + 1.0D) * ({drawn} - k + 1.0D) / (k * ({total} - {good} - {drawn} + k + 0.0D)))"
    fall = f"(s.w * ((k + 1.0D) * ({total} - {good} - {drawn} + k + 1.0D)) / (({good} - k + 0.0D) * ({drawn} - k)))"
    total_of = lambda seq, step: f"aggregate({seq}, named_struct('w', 1.0D, 'sum', 0.0D), (s, k) -> named_struct('w', {step}, 'sum', s.sum + {step}), s -> s.sum)"
    find = lambda seq, step, left: f"aggregate({seq}, named_struct('w', 1.0D, 'left', {left}, 'k', m), (s, k) -> if(s.left <= 0, s, named_struct('w', {step}, 'left', s.left - {step}, 'k', k)), s -> s.k)"
    # The mode has weight one; u picks a point of [0, 1 + up + down).
    body = f"transform(array(named_struct('up', {total_of(up, rise)}, 'down', {total_of(down, fall)})), t -> transform(array({u} * (1 + t.up + t.down)), point -> if(point < 1, m, if(point < 1 + t.up, {find(up, rise, 'point - 1')}, {find(down, fall, 'point - 1 - t.up')})))[0])[0]"
    return f"transform(array({mode}), m -> {body})[0]"


def split(counts: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(sid, shard, quota) from (sid, draws): exact quotas whose sums by source are its draws, and by shard all but equal."""
    node = counts.agg(F.array_sort(F.collect_list(F.struct(F.col("sid").cast("long").alias("sid"), F.col("draws").cast("long").alias("c")))).alias("counts")).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "counts")
    size = "aggregate(counts, 0L, (a, x) -> a + x.c)"
    empty = "cast(array() as array<struct<sid:bigint,c:bigint>>)"
    while shards > 1:
        shards = (shards + 1) // 2
        sized = node.withColumn("mid", F.expr("(lo + hi + 1) div 2")).withColumn("total", F.expr(size))
        half = sized.withColumn("left", F.expr("if(hi - lo < 2, total, cast(total * (mid - lo) div (hi - lo) as bigint))"))
        u = f"(pmod(xxhash64({seed}, lo, hi, x.sid), 9007199254740992L) / 9007199254740992.0D)"
        pick = _variate("a.total", "x.c", "a.left", u)
        drawn = half.withColumn(
            "lefts",
            F.expr(
                f"if(hi - lo < 2, counts, aggregate(counts, named_struct('total', total, 'left', left, 'out', {empty}),"
                f" (a, x) -> transform(array({pick}), got -> named_struct('total', a.total - x.c, 'left', a.left - got, 'out', concat(a.out, array(named_struct('sid', x.sid, 'c', got)))))[0], a -> a.out))"
            ),
        )
        rights = "zip_with(counts, lefts, (x, y) -> named_struct('sid', x.sid, 'c', x.c - y.c))"
        node = cut(drawn.select(F.explode(F.expr(f"if(hi - lo < 2, array(named_struct('lo', lo, 'hi', hi, 'counts', counts)), array(named_struct('lo', lo, 'hi', mid, 'counts', lefts), named_struct('lo', mid, 'hi', hi, 'counts', {rights})))")).alias("n")).select("n.*"))
    return node.select(F.col("lo").cast("int").alias("shard"), F.explode("counts").alias("x")).select("x.sid", "shard", F.col("x.c").alias("quota"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """(uid, source, size, source_size, target, shards array<int>): a row for each document, an entry in shards for each copy.

    Size counts words of the text (null: 0). Rows that repeat a key in a source are one document with their
    words added; rows without a key are told apart by their text. Documents without words belong to a block
    like others and are taken with it. A source without words has target 0 and takes nothing.
    """
    sizes = cut(docs.select(F.col(source).alias("source"), _order(key, source, text).alias("uid"), word_count(text).alias("size")).groupBy("source", "uid").agg(F.sum("size").alias("size")))
    per_source = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, share, most))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = per_source.withColumn("blocks", F.expr(f"shiftleft(1L, greatest(0, cast(ceil(log2(n / {BLOCK}.0D)) as int)))")).withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    named = sizes.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # Blocks are numbered by hash; an odd factor permutes the numbers, as their count is a power of two.
    rank = (F.xxhash64(F.lit(seed), "uid").bitwiseAND(F.col("blocks") - 1) * F.lit(2 * seed + 1) + F.lit(seed)).bitwiseAND(F.col("blocks") - 1)
    units = named.withColumn("rank", rank)
    blocks = cut(units.groupBy("sid", "rank").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("blocks", "full", "rest"))))
    runs = blocks.groupBy("sid", (F.col("rank") / RUN).cast("long").alias("run")).agg(F.sum("words").alias("run_words"))
    ahead = lambda by, over, c: F.coalesce(F.sum(c).over(Window.partitionBy(*over).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("ahead", ahead("run", ["sid"], "run_words")).select("sid", "run", "ahead")
    placed = blocks.withColumn("run", (F.col("rank") / RUN).cast("long")).withColumn("within", ahead("rank", ["sid", "run"], "words")).join(runs, ["sid", "run"])
    placed = placed.withColumn("left", F.col("rest") - F.col("ahead") - F.col("within")).withColumn("drawn", (F.col("left") > 0).cast("int"))
    placed = cut(placed.withColumn("border", (F.col("left") > 0) & (F.col("left") < F.col("words"))))
    # Draws of a source: whole passes, each in an order of its own, and then the part.
    passes = placed.select("sid", "rank", F.explode(F.expr("if(full + drawn > 0, sequence(0, full + drawn - 1), cast(array() as array<int>))")).alias("pass"), "blocks", "full")
    at = F.when(F.col("pass") == F.col("full"), F.col("rank")).otherwise((F.col("rank") * (2 * F.col("pass") + 3) + F.col("pass")).bitwiseAND(F.col("blocks") - 1))
    draws = passes.withColumn("d", F.col("pass") * F.col("blocks") + at)
    counted = placed.groupBy("sid").agg(F.sum(F.col("full") + F.col("drawn")).alias("draws"))
    if shards is None:
        shards = max(LEAST_SHARDS, round((per_source.agg(F.sum("target")).first()[0] or 0) / SHARD_WORDS))
    quotas = split(counted, shards, seed)
    ends = quotas.withColumn("stop", F.sum("quota").over(Window.partitionBy("sid").orderBy("shard"))).filter("quota > 0")
    dealt = ends.select("sid", "shard", F.explode(F.sequence(F.col("stop") - F.col("quota"), F.col("stop") - 1)).alias("d"))
    homes = draws.join(dealt, ["sid", "d"]).groupBy("sid", "rank").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("homes"))
    settled = placed.select("sid", "rank", "full", "left", "border").join(homes, ["sid", "rank"], "left")
    rows = units.select("sid", "rank", "uid", "source", "size", "source_size", "target").join(settled, ["sid", "rank"])
    # The border block is filled first-fit in hash order: about BLOCK documents.
    listed = rows.filter("border").groupBy("sid", "rank", "left").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), "uid").alias("h"), "uid", "size"))).alias("docs"))
    fill = "aggregate(docs, named_struct('left', left, 'out', cast(array() as array<bigint>)), (a, x) -> if(x.size <= a.left, named_struct('left', a.left - x.size, 'out', concat(a.out, array(x.uid))), a), a -> a.out)"
    filled = listed.select(F.col("sid").alias("fsid"), F.explode(F.expr(fill)).alias("fuid"))
    marked = rows.join(filled, (F.col("sid") == F.col("fsid")) & (F.col("uid") == F.col("fuid")), "left")
    kept = F.when(F.col("border") & F.col("fuid").isNull(), F.filter("homes", lambda x: x["pass"] < F.col("full"))).otherwise(F.col("homes"))
    return marked.select("uid", "source", "size", "source_size", "target", F.coalesce(F.transform(kept, lambda x: x["shard"]), F.expr("cast(array() as array<int>)")).alias("shards"))


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(key, size, source_size, target, taken, shards) for every row of docs; taken counts words, repeats included.

    Defined for null texts, keys and sources (null is a source of its own), empty tables (no rows), repeated
    rows and extra columns (ignored).
    """
    made = plan(docs, key, text, source, **how).select(F.col("uid").alias("_uid"), F.col("source").alias("_source"), "source_size", "target", "shards")
    rows = docs.select(F.col(key), F.col(source).alias("_from"), _order(key, source, text).alias("_key"), word_count(text).alias("size"))
    joined = rows.join(made, (F.col("_key") == F.col("_uid")) & F.col("_from").eqNullSafe(F.col("_source")))
    return joined.select(key, "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """Rows of docs as the mix takes them, a row for each copy, gathered by shard and shuffled within it; columns stay as they are.

    Null texts are empty, null sources are a source of their own, rows without a key are told apart by their
    text; texts of any length are whole. Rows that repeat a key in a source come together. An empty table gives
    no rows. Rows travel as one struct, so columns of any name may be there.
    """
    made = plan(docs, key, text, source, seed=seed, **how).filter(F.size("shards") > 0).select("uid", F.col("source").alias("of"), F.posexplode("shards").alias("copy", "shard"))
    rows = docs.select(F.struct("*").alias("row"), _order(key, source, text).alias("id"), F.col(source).alias("from"))
    joined = rows.join(made, (F.col("id") == F.col("uid")) & F.col("from").eqNullSafe(F.col("of")))
    shuffled = joined.withColumn("place", F.xxhash64(F.lit(seed + 2), "uid", "copy")).withColumn("part", F.pmod(F.col("place"), F.lit(16)))
    # A shard may be more than a task holds, so it is sixteen parts, each in hash order.
    return shuffled.repartition(F.col("shard"), F.col("part")).sortWithinPartitions("shard", "part", "place").select("row.*")
