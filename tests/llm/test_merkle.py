import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vaultspark.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, plus=0):
    values = [row[c] if c != "n_chars" or row[c] is None else row[c] + plus for c in FIELDS]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves, fanout):
    """(root, siblings to the left and right of each leaf by level) by the definition."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            first = i // fanout * fanout
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def plain(rows, fanout=2):
    """Sorted (doc_id, leaf, subroot, root, path) of rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below, roots = [], []
    for g in names:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        root, paths = plain_tree([plain_leaf(r) for r in own], fanout)
        below.append([(r, path, root) for r, path in zip(own, paths)])
        roots.append(root)
    if not roots:
        return []
    root, over = plain_tree(roots, fanout)
    out = [(r["doc_id"], plain_leaf(r), sub, root, path + up) for rows, up in zip(below, over) for r, path, sub in rows]
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string, digest int, level int, block int, n int, kept int, path int, line int"
REST = tuple(range(9))


def table(spark, n=150, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", None, "é"]), r.choice(["en", "en", "en", "de", None, "", "é", "z"]), r.choice([None, i, -i]), r.choice([None, "", "t" * i, "ünï 🙂"]), *REST) for i in range(n)]
    rows += [rows[3], rows[3], rows[3][:4] + ("other", *REST), (None, "s", "en", 1, "x", *REST), (None, "s", "en", 1, "x", *REST), (None,) * 5 + REST, (9_000_000, "s", "xx", 2, "long " * 200_000, *REST)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def leaf():
    return merkle.leaf(*[F.col(c) for c in FIELDS])


@pytest.mark.parametrize("fanout,block", [(2, 6), (2, 2), (3, 1), (5, 2)])
def test_manifest_equals_the_definition(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    docs = table(spark)
    got = merkle.manifest(docs, leaf(), fanout=fanout).select("doc_id", "leaf", "subroot", "root", "path").collect()
    got = sorted([(*r[:4], [tuple(s) for s in r[4]]) for r in got], key=repr)
    assert got == plain(docs.collect(), fanout)


def test_proofs_lead_to_the_root_unless_a_row_was_changed(spark):
    docs = table(spark, 60, 2)
    claimed = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    found = merkle.manifest(docs, leaf(), keep=(claimed.alias("claimed"), F.col("n_chars"), F.col("pos"), F.col("level")))
    rows = found.select("*", merkle.fold(F.col("leaf"), F.col("path")).alias("same"), merkle.fold(F.col("claimed"), F.col("path")).alias("other"), merkle.proof_digest(F.col("path")).alias("proof")).collect()
    assert len(rows) == docs.count() and {(r["pos"], r["level"]) for r in rows} == {(0, 3)}
    for r in rows:
        assert r["same"] == r["root"] and (r["other"] == r["root"]) == (r["n_chars"] is None)
        assert r["proof"] == h(*[left + right for left, right in r["path"]])


def test_tables_of_no_row_one_row_and_one_group(spark):
    docs = table(spark)
    empty = merkle.manifest(docs.limit(0), leaf())
    assert empty.columns == ["doc_id", "lang", "leaf", "subroot", "root", "path"] and empty.count() == 0
    one = merkle.manifest(docs.filter("doc_id = 7"), leaf()).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
    same = docs.filter("lang = 'en'").limit(5)
    assert sorted((r["leaf"], r["subroot"]) for r in merkle.manifest(same, leaf()).collect()) == sorted((x[1], x[2]) for x in plain(same.collect()))


def test_rows_that_all_repeat(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "same")] * 700, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs, leaf()).collect()
    assert sorted([tuple(s) for s in r["path"]] for r in got) == sorted(x[4] for x in plain(docs.collect()))
