import base64
import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from vaultspark.llm import line_dedup, mixing, toxicity

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, _score int, _doc int, doc int, row int, dropped string, id int, k int, gone_key int, uid int, copy int"
REST = (1, 2, 3, 4, "d", 5, 6, 7, 8, 9)


def rows_of(docs):
    """Documents with what tables can hold: nulls, empty and very long texts, repeated rows, clashing column names."""
    body = "a passage of some words that says one thing and then says another thing about it"
    return [*docs, (None, None, None, None, None, *REST), (9001, "", "en", "s", 0, *REST), (9002, None, "en", None, None, *REST), (9003, "long text " * 30_000, "en", "s", 1, *REST), (9004, body, "en", "s", 1, *REST), (9004, body, "en", "s", 1, *REST), (9005, body, None, "t", 1, *REST), (None, body, "en", "t", 1, *REST)]


@pytest.fixture(scope="module")
def odd(spark):
    docs = [tuple(r) + REST for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id < 60").collect()]
    return spark.createDataFrame(rows_of(docs), ODD).cache()


def joined(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :] and len(b) - len(a) == 1


def plain_lines(docs):
    """Texts after line dedup, by neighbours through one deleted character."""
    lines = sorted((d, n, t, line) for d, t in {(d, t) for d, t in docs if d is not None and t is not None} for n, line in enumerate(t.split("\n")) if line)
    first, links, variants = {}, [], defaultdict(set)
    for x in lines:
        first.setdefault(x[3], x)
    for line in first:
        if len(line) >= line_dedup.MIN_CHARS and len(line) < 3000:
            for v in {line, *(line[:i] + line[i + 1 :] for i in range(len(line)))}:
                variants[v].add(line)
    for some in variants.values():
        some = sorted(some)
        links += [(a, b) for i, a in enumerate(some) for b in some[:i] if within_one(a, b)]
    group = joined(list(first), links)
    keep = {}
    for line, x in first.items():
        keep[group[line]] = min(keep.get(group[line], x), x)
    gone = {x[:3] for x in lines if keep[group[x[3]]][:3] != x[:3]}
    return [(d, t if d is None or t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (d, n, t) not in gone)) for d, t in docs]


def plain_keep_one(docs):
    """Smallest keys of groups alike in five-word shingles."""
    def shingles(t):
        words = (t or "").encode().lower().split()
        return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {}
    for d, t in docs:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if any(near(x, y) for x in sets[a] for y in sets[b])]
    group = joined(ids, links)
    return sorted({d for d in ids if group[d] == d})


def test_toxicity_stage_equals_single_scores(spark, odd, monkeypatch):
    model = toxicity.train(["awful grolk here"] * 4 + ["a passage of words"] * 4, [1] * 4 + [0] * 4, epochs=30)
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: model)
    df = odd.unionByName(spark.createDataFrame([(9100, "this grolk is awful grolk here", "en", "s", 1, *REST)], ODD))
    got = P.drop_toxic(spark, df, SF)
    want = [r for r in df.collect() if toxicity._sigmoid(model.scores([r.text]))[0] < 0.5]
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want)) and 0 < len(want) < df.count()


def test_line_stage_equals_brute_force(spark, odd):
    got = P.dedup_lines(spark, odd, SF)
    want = plain_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert got.columns == odd.columns and got.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_near_dedup_stage_equals_brute_force(spark, odd):
    got = P.drop_near_duplicates(spark, odd, SF)
    rows = got.collect()
    assert got.columns == odd.columns
    assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == plain_keep_one([(r.doc_id, r.text) for r in odd.collect()])
    assert sum(r.doc_id is None for r in rows) == 2


def test_mixing_stage_takes_what_the_plan_says(spark, odd):
    got = P.mix_sources(spark, odd, SF)
    copies = defaultdict(int)
    for r in mixing.annotate(odd).collect():
        copies[r.doc_id] += len(r.shards)
    found = defaultdict(int)
    for r in got.collect():
        found[r.doc_id] += 1
    assert got.columns == odd.columns and found == {d: n for d, n in copies.items() if n}


def test_bpe_stage_equals_the_library(spark, odd):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((str(r.doc_id), r.n_tokens, str(list(r.ids)), r.decoded_sha256) for r in P.tokenize(spark, odd, SF).collect())
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), str(ids), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_take_an_empty_table(spark, odd, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf).cache()
        counts.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[5] == counts[4]
    assert docs.filter("doc_id is null or n_tokens <> size(ids)").count() == 0
