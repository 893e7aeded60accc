import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from vaultspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_tiktoken_on_random_and_long_texts(reference):
    v, r = bpe.vocabulary(PATH, P.PATTERN), random.Random(3)
    alphabet = "abcdefgehilnorst  '\n\t.!?0123456789éèßüñ漢字\x1c\x85　\U0001f389'sÄ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["", "a" * 5000, " " * 3000, "ab" * 3000, "I'll we've 'S'd", "\U0001f389" * 300, "x " * 20_000]
    for t in texts:
        ids = v.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert v.decode(ids) == t.encode()


def test_tiny_vocabulary_backtracks():
    # longest first would take "abc", but merging makes ab first and then c+d
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"cd": 257, b"bc": 258, b"abcd": 259}
    v = bpe.Vocabulary(ranks, r"[\s\S]+")
    merged = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for t in ("abcd", "abc", "bcd", "abbcd", "aabcdd", "bcbcab"):
        assert v.encode(t) == merged.encode_ordinary(t)


def test_frame_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(1, None, "z"), (2, "", "z"), (3, "der Haß  \n", "z"), (3, "der Haß  \n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in out) == [(1, ""), (2, ""), (3, rows[2][1]), (3, rows[2][1])]
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_portions_and_generations_change_nothing(reference, monkeypatch):
    v, r = bpe.Vocabulary(bpe_ranks(), P.PATTERN), random.Random(5)
    monkeypatch.setattr(bpe, "RUNS_AT_ONCE", 7)  # texts of 56 characters and more go through in portions
    monkeypatch.setattr(bpe, "MEMO_RUNS", 20)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 30)
    texts = [" ".join("".join(r.choice("aeinrst,'") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", "y" * 70]
    counts, ids = v.encode_all(iter(texts))
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == reference.encode_ordinary(t or "")
        at += n
    sizes, data = v.decode_all(ids, counts)
    assert data.tobytes() == "".join(t or "" for t in texts).encode() and sizes.tolist() == [len((t or "").encode()) for t in texts]


def bpe_ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


def test_round_trip_equals_encode_then_decode(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "der Haß  \n"), (3, "der Haß  \n"), (4, "漢字 " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(bpe, "SLICE_BYTES", 20)
    once = bpe.round_trip(df, PATH, P.PATTERN)
    twice = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).drop("text")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).collect() == []


def test_a_word_before_marks_is_encoded_once():
    import public_tokenizers

    v = bpe.Vocabulary({bytes([k]): k for k in range(256)}, public_tokenizers.PATTERN)
    text = "ab ab, ab. ab! ab.,)cd it's, ½. a_b, ab?!"
    assert v.encode(text) == list(text.encode())
    assert [k for k in v.new.number if "ab" in k] == ["ab", " ab"]
    assert [p for run in bpe.CHUNK.findall(text) for p in v.pieces.findall(run)] == v.pieces.findall(text)
