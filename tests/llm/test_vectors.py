import numpy as np
from pyspark.sql import functions as F

from vaultspark.llm import embedding_dedup, permutation_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(matrix):
    return [(i, [float(x) for x in v], 0) for i, v in enumerate(matrix)]


def data():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 16))
    base[200:260] = base[:60] + rng.standard_normal((60, 16)) * 0.15
    base[260:290] = base[5]
    base[290:300] = base[6] * np.arange(1, 11)[:, None]
    return base.astype(np.float32)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    for name, value in (("TILE", 16), ("TILES", 3), ("STEPS", (2, 4, 9)), ("BOX", 4)):
        monkeypatch.setattr(embedding_dedup, name, value)
    x = data()
    bad = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [float("inf")] + [1.0] * 15, 0), (1004, [], 0), (1005, [1.0, 2.0], 0), (1006, [None] + [1.0] * 15, 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows_of(x) + bad, SCHEMA)).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    parent = list(range(len(x)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(near)):
        a, b = find(int(a)), find(int(b))
        parent[max(a, b)] = min(a, b)
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (int(near[k].sum()), find(k), find(k) == k)
    for k, *_ in bad:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame(bad[:2], SCHEMA)).count() == 2


def test_index_recall_ties_and_odd_vectors(spark, monkeypatch):
    for name, value in (("SHARD", 64), ("CELL", 50), ("LEAST", 12), ("PIVOTS", 64), ("PREFIX", 32), ("QUERIES", 2)):
        monkeypatch.setattr(permutation_index, name, value)
    x = data()
    df = spark.createDataFrame([*rows_of(x), (5000, None, 0), (5050, [0.0] * 16, 0)], SCHEMA)
    got = permutation_index.nearest(df, df.filter("vec_id % 50 = 0 or vec_id = 5")).collect()
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = total = 0
    for q in [0, 5, 50, 100, 150, 200, 250]:
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(len(x)), -s.round(12)))[:5].tolist()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        hits += len(set(want) & {r.vec_id for r in mine})
        total += 5
    assert hits / total >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 5), key=lambda r: r["rank"])] == [260, 261, 262, 263, 264]
    assert {r.query_id for r in got} == {0, 5, 50, 100, 150, 200, 250}
    assert permutation_index.nearest(spark.createDataFrame([], SCHEMA), df).count() == 0
    few = spark.createDataFrame(rows_of(x[:3]), SCHEMA)
    assert permutation_index.nearest(few, few.filter("vec_id = 0")).count() == 2


def recall(spark, x, queries, k=5):
    """Share of the true k best that the index finds; ties in the score count as equal."""
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in permutation_index.nearest(df, df.filter(F.col("vec_id").isin(queries)), k).collect():
        got.setdefault(r.query_id, []).append(r.score)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in queries:
        s = u @ u[q]
        s[q] = -9
        least = np.sort(s)[-k]
        hits += sum(v >= least - 1e-12 for v in got[q])
    return hits / (k * len(queries))


def test_recall_where_a_third_are_jittered_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32))
    x[::3] = x[0] + rng.standard_normal((1000, 32)) * 0.02
    assert recall(spark, x, list(range(0, 3000, 75))) >= 0.9


def test_clustered_vectors_need_few_cells_and_keep_recall(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24)) * 3
    x = centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 24)) * 0.4
    monkeypatch.setattr(permutation_index, "CELL", 60)
    seen, learned = [], permutation_index.probes

    def spy(sample, coarse, k):
        seen.append((learned(sample, coarse, k), len(coarse)))
        return seen[-1][0]

    monkeypatch.setattr(permutation_index, "probes", spy)
    assert recall(spark, x, list(range(0, 3000, 60))) >= 0.9
    assert seen[0][1] == 50 and seen[0][0] <= 20


def test_recall_on_the_table(spark):
    """Every query of the registered kind over a whole table, against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").filter("embedding is not null").collect()
    x = np.array([r.embedding for r in sorted(rows, key=lambda r: r.vec_id)])
    assert recall(spark, x, list(range(0, len(x), 50))) >= 0.9


def test_footrule_and_files_equal_the_definition():
    rng = np.random.default_rng(6)
    pivots = permutation_index.unit(rng.standard_normal((20, 8)))
    x, q = rng.standard_normal((30, 8)), rng.standard_normal((4, 8))
    shard = permutation_index.Shard(np.arange(30), x, pivots, 7)
    order = lambda v: [int(p) for p in np.argsort(-(permutation_index.unit(v[None]) @ pivots.T)[0], kind="stable")[:7]]
    for i in range(4):
        for j in range(30):
            theirs = order(x[j])
            assert shard.footrule(q)[i, j] == sum(abs(place - (theirs.index(p) if p in theirs else 7)) for place, p in enumerate(order(q[i])))


def test_repeated_rows_and_clashing_names(spark):
    x = data()[:60]
    rows = [(i, [float(c) for c in v], 1, 2, 3, 4, 5) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *rows[:9]], "vec_id long, embedding array<float>, id int, v int, h int, cell int, lot int")
    once = df.dropDuplicates(["vec_id"])
    for run in (lambda d: permutation_index.nearest(d, d.filter("vec_id % 20 = 0")), lambda d: embedding_dedup.near_duplicates(d).select("vec_id", "component_id").distinct()):
        assert sorted(map(str, run(df).collect())) == sorted(map(str, run(once).collect()))


def test_pairs_equal_brute_force_at_every_density():
    rng = np.random.default_rng(8)
    for spread in (0.02, 0.3, 0.45, 1.0):
        x = rng.standard_normal(64) + rng.standard_normal((700, 64)) * spread
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        made = [embedding_dedup.Tile(np.arange(len(p)), np.ones(len(p)), p, axes) for p in (x[:600], x[600:])]
        for a, b in ((made[0], made[0]), tuple(made)):
            near = a.unit @ b.unit.T >= 0.9
            want = np.argwhere(np.triu(near, 1) if a is b else near)
            got = np.stack(embedding_dedup.near_pairs(a, b, 0.9, a is b), axis=1)
            assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, want.tolist()))


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(9)
    for n, m in ((1, 0), (50, 20), (50, 49), (200, 5000)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        root = embedding_dedup.forest(i, j, n)
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        assert root.tolist() == [find(k) for k in range(n)]
