import math
import random
import re
from collections import Counter

import numpy as np

from vaultspark.llm import wand

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """Sorted (item, rank, key, score) by the definition: every document is scored for every item."""
    counts = [(key, Counter(words_of(t))) for key, t in docs if words_of(t)]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in counts:
            m, score = 100 - 90 + 90 * sum(c.values()) * n // total, 0
            for w in set(words_of(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def case(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Straße", "ÉTÉ", "naïve", "a1b2", "CO2"]
    docs = [(i, " ".join(r.choice(vocabulary[: r.choice([5, 20, 65])]) for _ in range(r.randint(0, 60)))) for i in range(n)]
    docs += [(500 + i, "tie tie gold") for i in range(25)] + [(3, docs[3][1]), (None, "tie gold"), (None, None), (700, ""), (701, " .,- \n"), (702, "w1 w2 " * 40_000), (703, "X_y-z w3/w4")]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for i in range(25)]
    items += [(100, "tie gold"), (100, "tie gold"), (101, "absent words"), (102, None), (103, ""), (None, "w1 W1 w1."), (104, "x y z"), (105, "éTé ÉTÉ")]
    r.shuffle(docs)
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, score int, key string").repartition(5), spark.createDataFrame([(*i, 2, "d") for i in items], "item_id long, text string, rank int, query string")


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_terms_are_the_contract_s():
    for t in ("Straße ÉTÉ a1_b2-C3", "\x00a\x1cb\x85c d e", "", "日本 語，テスト. x", "İI", "".join(map(chr, range(0x250)))):
        assert [w.decode() for w in wand.terms(t.encode())] == words_of(t)


def test_search_equals_brute_force(spark):
    docs, items = case(1)
    got = wand.search(*frames(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == plain(docs, items)


def test_many_small_shards_windows_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(wand, "SHARD", 300)
    monkeypatch.setattr(wand, "FIRST_WINDOW", 4)
    monkeypatch.setattr(wand, "BLOCK_BYTES", 400)
    docs, items = case(2)
    assert found(wand.search(*frames(spark, docs, items), k=4)) == plain(docs, items, 4)


def test_empty_tables(spark):
    docs, items = frames(spark, *case(3, 20))
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text = ''"), items)):
        out = wand.search(d, i)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_documents_that_cannot_enter_are_skipped():
    r = np.random.default_rng(5)
    n = 20_000
    common, rare = np.flatnonzero(r.random(n) < 0.7), np.sort(r.choice(n, 40, replace=False))
    docs, ids = np.concatenate([common, rare]), np.repeat([1, 2], [len(common), len(rare)])
    impacts = np.where(ids == 1, r.integers(1, 90, len(ids)), r.integers(5000, 9000, len(ids)))
    shard = wand.Shard(n, docs, ids, impacts)
    at, score = shard.search(np.array([1, 2, 3]), 10, 1)
    full = np.bincount(docs, weights=impacts, minlength=n).astype(np.int64)
    order = np.lexsort((np.arange(n), -full))[:10]
    assert at.tolist() == order.tolist() and score.tolist() == full[order].tolist()
    assert shard.scored < n // 20
    assert shard.search(np.array([1, 2]), 10, 10**6)[0].size == 0
