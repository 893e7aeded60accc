import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vaultspark.functions import instants, text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


def test_tokens_fold_and_split_like_the_exact_path(spark):
    rows = ["Straße GROẞ", "हिन्दी text", "a_b-c 12½", "x" * 65 + " ok", "", None, "ﬁne Ünï"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(T.tokens(F.col("t"))).collect()]
    exact = [r[0] for r in df.select(T.tokens(F.col("t"), exact=True)).collect()]
    want = [None if r is None else [w for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", r).casefold()) if len(w) <= 64] for r in rows]
    assert exact == want
    assert got[0][0] == "strasse" and got[1] == want[1] and got[3] == ["ok"]


@pytest.mark.parametrize(
    "a,b,want",
    [("mondarchiv", "mondarchv", True), ("mondarchiv", "mondarchvi", True), ("abcd", "abdc", True), ("abcd", "badc", False), ("same", "same", False), ("a", "b", True), ("", "a", True), ("abc", "cba", False), ("lamp", "lamps", True)],
)
def test_one_edit(spark, a, b, want):
    assert one(spark, T.one_edit(F.col("a"), F.col("b")), a=a, b=b) is want


def words_of(spark, column, words):
    return spark.createDataFrame([(sorted(set(words)),)], "w array<string>").select(column).first()[0]


def test_word_forms(spark):
    w = F.col("w")
    assert words_of(spark, T.word_form_terms(["lampe"], w), ["lampen", "x"]) == ["lampen"]
    assert words_of(spark, T.word_form_terms(["lampen"], w), ["lampe"]) == ["lampe"]
    assert words_of(spark, T.word_form_terms(["lamps"], w), ["lamp"]) == []  # a stem keeps five letters
    assert words_of(spark, T.word_form_terms(["gartenlampe"], w), ["garten", "lampenschirm"]) == ["garten", "lampenschirm"]
    assert words_of(spark, T.word_form_terms(["gartenlampe"], w), ["gartenbau", "lampenschirm"]) == []


def test_typos_and_components(spark):
    w = F.col("w")
    assert words_of(spark, T.typo_terms(["harbour"], w), ["harbor", "harbours", "harbuor", "zebra"]) == ["harbor", "harbours"]
    assert words_of(spark, T.typo_terms(["abcdefab"], w), ["abcdefac"]) == []  # looks like an id
    assert words_of(spark, T.typo_terms(["azure"], w, 7), ["azur", "azures"]) == []
    assert words_of(spark, T.component_terms(["harbor"], w), ["harborside", "harbors", "oldharbor"]) == ["harborside", "oldharbor"]


def test_names_titles_slugs_urls(spark):
    assert one(spark, T.title_of(F.col("t")), t="\n\n## A Heading. And more\ntext") == "A Heading."
    assert one(spark, T.slug(F.col("t")), t="Crème  Brûlée!") == "creme-brulee"
    assert one(spark, T.slug(F.col("t")), t="漢字") == "entry"
    assert one(spark, T.canonical_url(F.col("t")), t="HTTPS://Example.COM:443?b=2&utm_source=x&a=1#f") == "https://example.com/?a=1&b=2"
    assert one(spark, T.canonical_url(F.col("t")), t="https://u:p@example.com/") is None
    assert one(spark, T.canonical_url(F.col("t")), t="ftp://example.com/") is None
    assert one(spark, T.normal_tags(F.col("t")), t=[" b", "A", "a", ""]) == ["A", "b"]


def test_uuid5_equals_the_library(spark):
    import uuid

    assert one(spark, T.uuid5(F.col("t")), t="https://example.com/a") == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://example.com/a"))


def test_cosine(spark):
    assert one(spark, T.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, T.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0


@pytest.mark.parametrize("t,want", [("2026-01-01T00:00:00+02:00", 1767218400000000), ("2026-01-01T00:00:00Z", 1767225600000000), ("2026-01-01T00:00:00", None), ("2026-01-01", None), ("no", None), ("2026-01-01 00:00+02:00", 1767218400000000), ("2026-13-01T00:00:00Z", None)])
def test_instants_need_an_offset(spark, t, want):
    assert one(spark, instants.instant(F.col("t")), t=t) == want


def test_folding_on_the_driver_is_the_same(spark):
    texts = ["", "Straße ﬁn ½ ĲSSEL … ＡＢＣ ①", "plain ASCII only", "ΟΔΥΣΣΕΥΣ ς", "ŉ ǰ ΐ և ẞ ﬀ Ω K Å", "日本語 ｶﾞ ㍿", "".join(map(chr, [*range(0x20, 0x600), *range(0x1E00, 0x2200), *range(0xFB00, 0xFB20)]))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(T.fold(F.col("t")).alias("f")).collect()] == [T.fold_text(t) for t in texts]
    assert [r.w for r in df.limit(6).select(T.tokens(F.col("t")).alias("w")).collect()] == [T.tokens_of(t) for t in texts[:6]]
    assert T.tokens_of("x" * 64 + " " + "y" * 65) == ["x" * 64]
