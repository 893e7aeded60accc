import random

import pytest

from vaultspark.llm import line_dedup


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(r, s, k):
    for _ in range(k):
        i, x = r.randrange(len(s) + 1), r.random()
        s = s[:i] + r.choice("abß") + s[i + (x < 0.5) :] if x < 0.7 else s[:i] + s[i + 1 :]
    return s


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_distance_equals_the_matrix(spark, t):
    r = random.Random(5)
    rows = [("", ""), ("", "a"), ("ab", ""), ("x" * 300, "x" * 299 + "y")]
    for _ in range(150):
        a = "".join(r.choice("abcß \U0001f389") for _ in range(r.randint(0, 40)))
        rows.append((a, changed(r, a, r.randint(0, 4))))
    df = spark.createDataFrame(rows, "a string, b string")
    assert [x[0] for x in df.select(line_dedup.within("a", "b", t)).collect()] == [lev(a, b) <= t for a, b in rows]


@pytest.mark.parametrize("t,n,hot", [(1, 120, 4), (2, 50, 24), (2, 80, 3), (3, 60, 2)])
def test_equals_brute_force_with_hot_keys(spark, monkeypatch, t, n, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(5)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(20, 45))) for _ in range(6)]
    docs = [(d, "\n".join(changed(r, r.choice(base), r.randint(0, 3)) for _ in range(r.randint(0, 4)))) for d in range(n)]
    docs += [(9000, None), (None, base[0]), (9001, ""), (9002, base[1] + "\n" + base[1] + "\nshort\nshort"), (9003, "\n".join([base[2]] * 2))]
    df = spark.createDataFrame([(d, x, "c", 7) for d, x in docs], "doc_id long, text string, doc string, n int")
    got = {x.doc: list(x.dropped) for x in line_dedup.duplicate_lines(df, threshold=t).collect()}
    lines = sorted((d, i, l) for d, x in docs if x is not None and d is not None for i, l in enumerate(x.split("\n")) if l)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            x, y = lines[i][2], lines[j][2]
            near = min(len(x), len(y)) >= line_dedup.MIN_CHARS and abs(len(x) - len(y)) <= t and lev(x, y) <= t
            if find(i) != find(j) and (x == y or near):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {}
    for i, (d, no, _) in enumerate(lines):
        if find(i) != i:
            want.setdefault(d, []).append(no)
    assert got == want
    kept = {x.doc_id: x.text for x in line_dedup.dedup(df, threshold=t).collect()}
    for d, x in docs:
        drop = set(want.get(d, []))
        assert kept[d] == (None if x is None else "\n".join(l for i, l in enumerate(x.split("\n")) if i not in drop))


def test_empty_table_and_report(spark):
    df = spark.createDataFrame([(1, "a line that is long enough\nx"), (2, "a line that is long enough"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in line_dedup.report(df).collect()) == [(1, 2, 0), (2, 1, 1), (3, 0, 0)]
    assert line_dedup.report(df.limit(0)).count() == 0 and line_dedup.dedup(df.limit(0)).count() == 0


def test_stage_drops_equal_short_lines(spark):
    """Short lines go if they are equal, stay if they are one edit apart; empty lines always stay."""
    import corpus_pipeline

    docs = [(1, "Les.\n\nshort\nshort"), (2, "Les.\n\nLet.\nx"), (3, "x\nshort\n"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    assert got == {1: ("Les.\n\nshort", 11), 2: ("\nLet.\nx", 7), 3: ("", 0), 4: (None, None), 5: ("", 0)}


def test_rows_that_repeat_a_key_are_documents_of_their_own(spark):
    rows = [(1, "a unique line that nothing repeats", "m"), (1, "this line is repeated elsewhere", "m"), (2, "this line is repeated elsewhere", "m"), (2, "this line is repeated elsewhere", "m"), (3, "x " * 200_000, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, dropped string")
    got = sorted((r.doc_id, r.text[:40]) for r in line_dedup.dedup(df).collect())
    assert got == [(1, rows[0][1]), (1, rows[1][1]), (2, ""), (2, ""), (3, rows[4][1][:40])]
    assert line_dedup.dedup(df).columns == df.columns
