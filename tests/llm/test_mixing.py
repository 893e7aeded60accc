import re
from collections import defaultdict

from vaultspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing again and again, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    caps = {s: most * sizes[s] for s in names}
    t, total = {s: 0.0 for s in names}, share * sum(sizes.values())
    free, left = set(names), total
    while free and left > 1e-9:
        each = left / sum(w[s] for s in free)
        left = 0.0
        for s in list(free):
            t[s] += each * w[s]
            if t[s] >= caps[s]:
                left += t[s] - caps[s]
                t[s] = caps[s]
                free.discard(s)
    return t


def corpus():
    docs = []
    for i in range(900):
        s = "hot" if i % 3 == 0 else ("a", "Z", "é", "𝄞", "tiny", None)[i % 6]
        if s == "tiny" and i > 100:
            s = "a"
        docs.append((i, " ".join(["w"] * (i * 37 % 90)) + (" \n" if i % 2 else ""), s, ""))
    return docs + [(2000, None, "a", ""), (2001, "", "void", ""), (None, "no key here", "a", ""), (None, "no key here", "a", "")]


def test_targets_and_taken_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "RUN", 4)
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    got = mixing.annotate(df, shards=5).collect()
    assert len(got) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums, taken = defaultdict(int), defaultdict(int)
    source = {d[0]: d[2] for d in docs}
    for _, t, s, _ in docs:
        sums[s] += size(t)
    want = filled(dict(sums))
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sums[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 2 * r.size and all(0 <= x < 5 for x in r.shards)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 89 for s in sums)  # less than a document, and none here is longer
    again = mixing.annotate(df.repartition(7), shards=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows = mixing.mix(df, shards=5)
    assert rows.columns == df.columns
    assert rows.count() == sum(len(r.shards) for r in got)
    assert mixing.annotate(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_splitting_tree_is_exact_and_spreads(spark):
    draws = [(1, 1000), (2, 50), (3, 0), (4, 7)]
    for shards in (1, 2, 7):
        rows = mixing.split(spark.createDataFrame(draws, "sid long, draws long"), shards).collect()
        by_source, by_shard = defaultdict(int), defaultdict(int)
        for r in rows:
            assert r.quota >= 0
            by_source[r.sid] += r.quota
            by_shard[r.shard] += r.quota
        assert dict(by_source) == dict(draws)
        assert sorted(by_shard) == list(range(shards)) and max(by_shard.values()) - min(by_shard.values()) <= 2


def test_hypergeometric_variate_has_the_right_mean(spark):
    from pyspark.sql import functions as F

    expr = mixing._variate("100L", "30L", "40L", "(id / 4000.0D)")
    mean = spark.range(4000).select(F.expr(expr).alias("k")).agg(F.avg("k"), F.min("k"), F.max("k")).first()
    assert abs(mean[0] - 12) < 0.02 and 0 <= mean[1] and mean[2] <= 30


def test_query_splits_at_every_size(spark):
    """The registered query draws hypergeometric variates on the smallest tables too, and meets the targets."""
    from vaultspark.llm import catalog

    got = catalog.op1_mixing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source").collect()
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in docs)
    used = defaultdict(set)
    source, sums, taken, largest = dict(docs), defaultdict(int), defaultdict(int), 0
    for r in got:
        used[source[r.doc_id]].update(r.shards)
        sums[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        largest = max(largest, r.size)
    assert {x for s in used.values() for x in s} <= set(range(mixing.LEAST_SHARDS)) and max(map(len, used.values())) > 1
    want = filled(dict(sums))
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sums[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - want[s]) <= largest for s in sums)


def test_mix_nulls_long_texts_repeats_and_clashing_names(spark):
    schema = "doc_id long, text string, source string, uid long, of string, copy int, shard int, row string, id int, place int, part int"
    rest = (1, "o", 2, 3, "r", 4, 5, 6)
    docs = [(i, "w " * (i % 7), "s" if i % 2 else None, *rest) for i in range(60)] + [(60, "long " * 50_000, "t", *rest), (61, None, "t", *rest), (1, "w", "s", *rest), (None, "no key", "s", *rest)]
    df = spark.createDataFrame(docs, schema)
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert set(got.collect()) <= set(df.collect()) and got.count() > 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.annotate(df.limit(0)).count() == 0
