import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vaultspark.llm import components as components_module
from vaultspark.llm import simhash
from vaultspark.llm.components import components


def fp_of(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_golay_keys_are_shared_within_the_radius():
    rng = np.random.default_rng(1)
    for radius in (3, 5):
        a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        b = a.copy()
        for i in range(len(b)):
            for k in rng.choice(64, radius, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(k)
        cut = lambda f: list(zip(*(simhash.golay_indices((f >> np.uint64(s)) & np.uint64((1 << n) - 1), n) for s, n in simhash.SEGMENTS)))
        (own_b, near_b), (_, near_a) = cut(b), cut(a)
        for r in range(len(a)):
            theirs = [{own_b[s][r]} if radius == 3 else set(near_b[s][r]) - {-1} for s in range(3)]
            assert any(set(near_a[i][r]) & theirs[i] and set(near_a[j][r]) & theirs[j] for i, j in simhash.PAIRS)


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    edges = rng.integers(0, 300, (220, 2)).tolist() + [[k, k + 1] for k in range(1000, 1040)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert all(want[k] == v for k, v in got.items())
    assert {k for e in edges if e[0] != e[1] for k in e} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(6)]
    docs = [(i, r.choice(base)) for i in range(20)]
    for i in range(20, 110):
        t = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice(words)
        docs.append((i, "\t ".join(t).upper() if i % 5 == 0 else " ".join(t)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE "), (205, "x " * 30_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, fp int")
    got = {x.doc_id: (x.fp % (1 << 64), x.component_id) for x in simhash.near_duplicates(df).collect()}
    fps = {i: fp_of(t) for i, t in docs}
    want = groups(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {i: v[0] for i, v in got.items()} == fps
    assert {i: v[1] for i, v in got.items()} == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_leaves_clean_rows_and_one_of_each_group(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(2000)]
    clean = [" ".join(r.choice(words) for _ in range(150)) for _ in range(12)]
    docs = list(enumerate(clean))
    for k in range(3):
        for i in range(6):
            t = clean[k].split()
            t[10 * i + 3] = "changed"
            docs.append((100 + 10 * k + i, " ".join(t)))
    docs += [(500, clean[5]), (501, None), (502, ""), (None, clean[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, id string")
    kept = [x.doc_id for x in simhash.keep_one(df).collect()]
    assert sorted(k for k in kept if k is not None) == [*range(12), 501]
    assert kept.count(None) == 1
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.keep_one(df.limit(0)).count() == 0


def shingled(words, size=5):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


def varied(r, words, text, n):
    text = list(text)
    for p in r.sample(range(len(text)), n):
        text[p] = r.choice(words)
    return text


def test_keep_one_finds_variants_by_their_original(spark, monkeypatch):
    """Variants are like the original and not like each other; the original comes last and is no root by itself."""
    monkeypatch.setattr(simhash, "HOT", 8)
    r = random.Random(3)
    words = [f"w{k}" for k in range(20_000)]
    docs = []
    for first in (0, 1000):
        original = [r.choice(words) for _ in range(300)]
        variants = [v for v in (varied(r, words, original, 6) for _ in range(200)) if jaccard(original, v) >= 0.8]
        docs += [(first + k, v) for k, v in enumerate(variants)] + [(first + 999, original)]
    docs += [(3000 + k, [r.choice(words) for _ in range(100)] + docs[0][1][:40]) for k in range(30)]  # one passage, else different
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    want = groups([i for i, _ in docs], [(i, j) for i, a in docs for j, b in docs if i < j and (i // 1000 == j // 1000) and jaccard(a, b) >= 0.8])
    assert sorted(x.doc_id for x in simhash.keep_one(df).collect()) == sorted(set(want.values())) == [0, 1000, *range(3000, 3030)]


def test_keep_one_finds_every_pair_at_the_similarity(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(20_000)]
    docs, gone = [], []
    for i in range(0, 300, 2):
        a = [r.choice(words) for _ in range(r.randint(6, 300))]
        b = varied(r, words, a, r.randint(1, min(len(a), 9)))
        docs += [(i, a), (i + 1, b)]
        gone += [i + 1] if jaccard(a, b) >= 0.8 else []
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    assert {i for i, _ in docs} - {x.doc_id for x in simhash.keep_one(df).collect()} == set(gone) and len(gone) > 40


def test_ids_of_any_size(spark):
    ids = [(1 << 62) + 5, (1 << 62) + 9, -(1 << 63), (1 << 63) - 1, 3]
    classes = spark.createDataFrame([(i, f) for i, f in zip(ids, (0, 1, 1 << 40, (1 << 40) + 1, (1 << 30) - 1))], "id long, fp long")
    found = [tuple(r) for r in simhash.links(classes, 1).collect()]
    whole = groups(ids, found)  # the last one is 30 bits from all others
    assert len({whole[i] for i in ids[:4]}) == 1 and whole[3] == 3
    df = spark.createDataFrame([(i, "one and the same text here") for i in ids], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {-(1 << 63)}


def test_sketches_never_undercount():
    rng = np.random.default_rng(11)
    for n, m in ((0, 0), (1, 1), (7, 9), (40, 33), (400, 410), (5000, 4100)):
        for shared in (0, min(n, m) // 2, min(n, m)):
            common = rng.integers(0, 1 << 64, shared, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 64, k - shared, dtype=np.uint64)])) for k in (n, m))
            bound = simhash.overlap(simhash._sketch(a), simhash._sketch(b), min(len(a), len(b)))
            assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))
    same = np.arange(300, dtype=np.uint64)  # all in one bucket: no count fits, and nothing is said
    assert simhash._sketch(same) == b"" and simhash.overlap(b"", b"x", 5) == 5


def test_ranges_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(12)
    rows, want = [], []
    for n in (0, 1, 5, 40, 300, 900):
        for share in (0.0, 0.7, 0.95, 1.0):
            common = rng.integers(0, 1 << 64, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 64, n - len(common), dtype=np.uint64)])) for _ in range(2))
            rows.append((len(a), simhash._ranges(a).tolist(), len(b), simhash._ranges(b).tolist()))
            want.append(len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)))
    df = spark.createDataFrame(rows, "n int, x array<long>, m int, y array<long>")
    got = [r[0] for r in df.select(simhash.may_overlap(F.col("n"), F.col("x"), F.col("m"), F.col("y"), 0.8)).collect()]
    assert all(g or not w for g, w in zip(got, want)) and not all(got)


def test_columns_may_have_any_helper_s_name(spark):
    """A table with a column for every name that the module uses gives what the bare table gives."""
    source = Path(simhash.__file__).read_text() + Path(components_module.__file__).read_text()
    names = sorted({n.lower() for n in re.findall(r"\b[A-Za-z_][A-Za-z_0-9]*\b", " ".join(re.findall(r'"([^"\n]*)"', source)))} - {"doc_id", "text"})
    assert {"end", "fp", "gone_key", "id", "component"} <= set(names)
    words = [f"w{k}" for k in range(300)]
    r = random.Random(4)
    base = [r.choice(words) for _ in range(80)]
    docs = [(0, " ".join(base)), (1, " ".join(base[:-2] + ["x", "y"])), (2, " ".join(base)), (3, " ".join(r.choice(words) for _ in range(60))), (4, ""), (5, None)]
    bare = spark.createDataFrame(docs, "doc_id long, text string")
    wide = bare.select("*", *[F.lit(7).alias(n) for n in names])
    assert sorted(x.doc_id for x in simhash.keep_one(wide).collect()) == sorted(x.doc_id for x in simhash.keep_one(bare).collect()) == [0, 3, 4]
    assert simhash.keep_one(wide).columns == wide.columns
    assert sorted(map(tuple, simhash.near_duplicates(wide).collect())) == sorted(map(tuple, simhash.near_duplicates(bare).collect()))
    renamed = wide.withColumnRenamed("id", "other").withColumnRenamed("doc_id", "id")
    assert sorted(x.id for x in simhash.keep_one(renamed, key="id").collect()) == [0, 3, 4]


@pytest.mark.parametrize("crowd,wide", [(5, 40), (5, 2), (10**9, 2)])
def test_pivots_are_broadcast_only_while_they_are_few(spark, monkeypatch, crowd, wide):
    """However many keys have pivots, the driver gets WIDE of their bitmaps at most; members are linked alike by broadcast, by lots and by shuffle."""
    monkeypatch.setattr(components_module, "CROWD", crowd, raising=False)
    monkeypatch.setattr(components_module, "WIDE", wide, raising=False)
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.append(df.count() if "pn" in df.columns else 0), broadcast(df))[1])
    members = [(k, k * 1000 + i) for k in range(30) for i in range(3 if k else 60)]
    hot = components_module.cut(spark.createDataFrame([(k, i, (1, [i])) for k, i in members], "k long, id long, n struct<n int, bits array<long>>"))
    near = components_module.cut(spark.createDataFrame([], "id long, component long"))
    alike = F.col("a") % 2 == F.col("b") % 2
    found = {r.id: r.component for r in components_module.pivoted(hot, near, lambda pairs: pairs.filter(alike), F.lit(True)).collect()}
    assert [found.get(i, i) for _, i in members] == [k * 1000 + i % 2 for k, i in members]
    assert max(sent, default=0) <= wide and (wide < 40 or max(sent) > 0)
