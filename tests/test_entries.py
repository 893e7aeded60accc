import html
import json
import os

import pytest
from pyspark.sql import functions as F

from vaultspark.functions import instants, text as T
from vaultspark.operators import bm25, changes, entries, filters, graph, index, paging, ranking
from vaultspark.sources import html_meta, notes, vectors
from vaultspark.streaming import refresh


def test_folding_is_exact_but_for_composition(spark):
    chars = [chr(c) for c in range(0x20, 0x0590)] + list("ﬁﬂ…ẞẖΐ①Ａｂ½™ȷ漢字カ")
    rows = [(c, T._folded(c)) for c in chars if not ("̀" <= c <= "ͯ")]
    got = {r.c: r.f for r in spark.createDataFrame(rows, "c string, want string").select("c", T.fold(F.col("c")).alias("f")).collect()}
    assert {c: got[c] for c, want in rows if got[c] != want} == {}


def test_plain_characters_need_lower_case_only():
    import re

    for code in range(0xFFFF):
        c = chr(code)
        if re.fullmatch(f"[{T.PLAIN}]", c):
            assert T._folded(c) == c.lower().replace("ß", "ss"), hex(code)


def test_literal_finds_final_sigma_and_ligatures(spark):
    df = spark.createDataFrame([(1, "Ο ΣΊΣΥΦΟΣ"), (2, "ﬁne")], "doc_id long, text string")
    assert [r.id for r in ranking.literal(df, "Σίσυφος").collect()] == [1]
    assert [r.id for r in ranking.literal(df, "FINE").collect()] == [2]


def test_slugs_by_decomposition(spark):
    df = spark.createDataFrame([("Čeština Łódź ő",), ("ﬁn Ǆ ½",), ("--",), ("x" * 63 + " y",)], "t string")
    assert [r[0] for r in df.select(T.slug(F.col("t"))).collect()] == ["cestina-odz-o", "fin-dz-12", "entry", "x" * 63 + "-"]


def test_inline_tags_after_punctuation(spark):
    df = spark.createDataFrame([('"#alpha" and,#beta #gamma a#x /#x ##x -#x #12 #a1/b-c',)], "b string")
    assert df.select(notes.inline_tags(F.col("b"))).first()[0] == ["alpha", "beta", "gamma", "a1/b-c"]


def test_evidence_cuts_where_the_match_is(spark):
    df = spark.createDataFrame([(1, "ß" * 100 + " needle " + "x" * 300)], "doc_id long, text string")
    assert paging.evidence(df, "NEEDLE").first().excerpt == ("ß" * 100 + " needle " + "x" * 300)[41:281]


def test_intervals_and_bounds(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z", None), (None, "2026-01-01T00:00:00Z")], "a string, b string")
    got = [list(r[0]) for r in df.select(instants.interval_errors(F.col("a"), F.col("b"))).collect()]
    assert got == [[], ["valid_until without valid_from"]]
    filters.check_bounds(after="2026-01-01T13:00:00+02:00", before="2026-01-01T12:00:00+00:00")
    for bad in ({"after": "2026-01-01T12:00:00Z", "before": "2026-01-01T13:00:00+02:00"}, {"after": "2026-01-01"}, {"limit": 51}):
        with pytest.raises(ValueError):
            filters.check_bounds(**bad)
    assert filters.as_of("2026-01-01T13:00:00+02:00") == ("2026-01-01T11:00:00+00:00", True) and filters.as_of()[1] is False


def test_merge_of_an_absent_entry_changes_nothing(spark):
    e = spark.createDataFrame([("a", ["x"], ["t"], [("p", "b")]), ("b", [], [], [])], "id string, aliases array<string>, tags array<string>, relations array<struct<predicate:string,target:string>>")
    for keep, drop in (("a", "none"), ("none", "a"), ("a", "a")):
        assert graph.merge(e, keep, drop).collect() == e.collect()


def test_insert_refuses_rivals_within_a_batch(spark):
    old = spark.createDataFrame([("1", "k1")], "id string, k string")
    new = spark.createDataFrame([("3", "k2"), ("2", "k2"), ("4", None), ("5", None), ("6", "k1")], "id string, k string")
    after, refused = changes.insert(old, new, [F.col("k")])
    assert sorted(r.id for r in after.collect()) == ["1", "2", "4", "5"] and sorted(r.id for r in refused.collect()) == ["3", "6"]


def test_wordings_are_checked():
    assert ranking.wordings("") == {"q0": ""} and ranking.wordings("a", ["b"]) == {"q0": "a", "q1": "b"}
    for query, more in (("a", ["A "]), ("a", ["ﬁ", "fi"]), ("a", ["b\0"]), ("a", [" "]), ("a", ["b" * 2001]), ("a", ["b", "c", "d", "e"])):
        with pytest.raises(ValueError):
            ranking.wordings(query, more)


def test_fusion_shared_first_then_tiers_and_duplicate_ids(spark):
    scored = spark.createDataFrame([("a", "x", 2.0, "p"), ("a", "s", 1.0, "p"), ("b", "s", 5.0, "p"), ("b", "y", 4.0, "p"), ("b", "t", -2.0, "p"), ("a", "c", -1.5, "p")], "query_id string, id string, score double, path string")
    got = ranking.fuse(scored).orderBy(F.desc("tier"), F.desc("rrf"), "id").collect()
    assert [(r.id, r.tier) for r in got] == [("s", 4), ("x", 4), ("y", 4), ("c", 2), ("t", 1)]
    assert [tuple(x) for x in got[0].evidence] == [("a", "lexical"), ("b", "lexical")] and got[3].evidence[0].match_kind == "word_form"
    with pytest.raises(Exception, match="two entries"):
        ranking.fuse(scored.unionByName(spark.createDataFrame([("b", "x", 1.0, "other")], scored.schema))).collect()


def test_searchable_text_and_results(spark):
    e = spark.createDataFrame([("1", "place", "Azure", ["Blue"], ["t1", "t2"], "body <!-- web-content -->x<!-- /web-content -->", "cafe", ("de", 3), None)], "id string, type string, title string, aliases array<string>, tags array<string>, body string, place_kind string, attributes struct<lang:string,secret:int>, rating int")
    text = entries.haystack(e, {"place": ["place_kind"], "book": ["rating"]}, ["lang"]).first().text
    assert text == 'Azure\nBlue\ncafe\n{"lang":"de"}\nt1 t2\nbody x'
    assert bm25.score(entries.haystack(e, {"place": ["place_kind"]}), {"q": "cafe t2"}, "id").count() == 1
    got = json.loads(entries.compact(e.withColumn("match_kind", F.lit("typo")), "match_kind").first().result)
    assert got == {"id": "1", "type": "place", "title": "Azure", "aliases": ["Blue"], "place_kind": "cafe", "relation_count": 0, "attachment_count": 0, "match_kind": "typo"}
    assert json.loads(entries.detail(e).first().entry)["rating"] is None
    page = entries.page_of(spark.createDataFrame([("1", 2.0)], "id string, score double"), e, [F.desc("score")])
    assert page.first().title == "Azure"


def test_review_summaries(spark):
    e = spark.createDataFrame([("1", "note", "T", "2026", "unreviewed", [], "", None, "a  b\n" * 200), ("2", "note", "T", None, "active", [], "", None, None)], "id string, type string, title string, created_at string, status string, unresolved_relations array<string>, personal_note string, reviewed_at string, body string")
    (r,) = entries.review_summary(e).collect()
    assert (r.id, list(r.reasons), len(r.excerpt)) == ("1", ["unreviewed"], 240)


def test_aliases(spark):
    df = spark.createDataFrame([([" b ", "A"], "t"), (["T"], "t"), (["x", "X"], "t"), ([""], "t"), (["y" * 201], "t"), ([str(k) for k in range(65)], "t"), (None, "t")], "a array<string>, t string")
    got = df.select(entries.normal_aliases(F.col("a"), F.col("t")).alias("n"), entries.alias_errors(F.col("a"), F.col("t")).alias("e")).collect()
    assert [r.n for r in got] == [["A", "b"], None, None, None, None, None, []] and [len(r.e) for r in got] == [0, 1, 1, 1, 1, 1, 0]


@pytest.mark.parametrize("url,want", [(" HTTP://Ex.org:80#f", "http://ex.org:80/"), ("https://ex.org/a?b#c", "https://ex.org/a?b"), ("https://ex.org:8443/", None), ("https://u@ex.org/", None), ("ftp://ex.org", None), ("https://", None), ("https://[::1]/x", "https://[::1]/x"), ("https://ex.org/" + "a" * 4096, None)])
def test_fetchable_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(T.fetchable_url(F.col("u"))).first()[0] == want


A, B, C = ("kn_" + c * 32 for c in "abc")
R1, R2 = ("sha256:" + c * 64 for c in "12")


def test_sidecar_counts_present_revisions_only(spark, tmp_path):
    head = {"format": "own-1", "model": "m", "dimensions": 2}
    lines = [head, {"id": A, "revision": R1, "vector": [1, 0]}, {"id": B, "revision": R2, "vector": [0, 1]}, {"id": C, "revision": R1, "vector": [0, 1, 2]}]
    path, query = tmp_path / "side.jsonl", tmp_path / "query.json"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    query.write_text(json.dumps({**head, "vector": [1.0, 1.0]}))
    model, asked = vectors.query_vector(spark, str(query), "own-1")
    found = spark.createDataFrame([(A, R1, 1.0), (B, R1, 3.0)], "id string, revision string, score double")
    side = vectors.sidecar(spark, str(path), "own-1", model, len(asked), found)
    got = {r.id: (r.tier, r.relevance) for r in ranking.rerank(found, side, asked, "id", "vector", "revision").collect()}
    assert got == {A: (1, round(0.5**0.5, 9)), B: (0, 3.0)}  # B's vector is of an older text
    for change in ({"form": "other"}, {"model": "n"}, {"dimensions": 3}):
        with pytest.raises(vectors.VectorError):
            vectors.sidecar(spark, str(path), **{"form": "own-1", "model": "m", "dimensions": 2} | change)
    with pytest.raises(Exception, match="not of the length"):
        vectors.sidecar(spark, str(path), "own-1", "m", 2).collect()
    lines = [head, {"id": A, "revision": R1, "vector": [1, 0]}, {"id": B, "revision": R1, "vector": [3, 0], "format": "of its own"}, {"id": A, "revision": R2, "vector": [5, 0]}, {"id": A, "revision": R1, "vector": [2, 0]}]
    path.write_text("\n\n".join(map(json.dumps, lines)))
    assert sorted(map(tuple, vectors.sidecar(spark, str(path), "own-1", "m", 2).collect())) == sorted([(A, R1, [2.0, 0.0]), (A, R2, [5.0, 0.0]), (B, R1, [3.0, 0.0])])
    path.write_text("\n".join(map(json.dumps, [head, head])))
    with pytest.raises(Exception, match="no valid id"):
        vectors.sidecar(spark, str(path), "own-1", "m", 2).collect()
    for bad in ({"vector": [1]}, {"dimensions": True}, {"model": ""}, {"vector": [1, True]}):
        query.write_text(json.dumps({**head, "vector": [1.0, 1.0], **bad}))
        with pytest.raises(vectors.VectorError):
            vectors.query_vector(spark, str(query), "own-1")


def test_index_segments_verify_drop_and_state(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(k, f"word{k} lamp" + " lamp" * (k % 3)) for k in range(600)], "doc_id long, text string").cache()
    index.build(docs, folder, state="one")
    assert index.status(docs, folder, state="one") == "fresh"
    assert index.refresh(docs, folder, state="two") == "unchanged" and index.manifest(spark, folder)["state"] == "two"
    now = docs
    for k in range(index.SEGMENTS + 2):
        now = now.withColumn("text", F.when(F.col("doc_id") == k, F.lit(f"lamp harbor{k}")).otherwise(F.col("text"))).filter(F.col("doc_id") != 100 + k)
        assert index.refresh(now, folder) == "patched"
        assert len(index.manifest(spark, folder)["segments"]) <= index.SEGMENTS
    asked = {"q": "lamp harbor3 word7"}
    want = sorted(map(tuple, bm25.score(now, asked).select("id", "score").collect()))
    assert sorted(map(tuple, index.search(now, folder, asked).select("id", "score").collect())) == want
    assert index.verify(spark, folder)["number"] > index.SEGMENTS
    name = index.manifest(spark, folder)["segments"][-1]["name"]
    spark.createDataFrame([(1, 5, 7)], "id long, length long, sig long").write.mode("append").parquet(f"{folder}/segments/{name}/lengths")
    with pytest.raises(index.Corrupt):
        index.verify(spark, folder)
    assert index.drop(spark, folder) and index.status(now, folder) == "absent" and not index.drop(spark, folder)


def test_a_torn_manifest_is_passed_over(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    index.build(docs, folder)
    spark.createDataFrame([('{"body": {"format": 2, "number": 99',), ('{"body": {"format": 2, "number": 99}, "check": "x"}',)], "value string").write.mode("append").text(f"{folder}/manifests")
    assert index.manifest(spark, folder)["number"] == 1 and index.status(docs, folder) == "fresh"


def test_a_stream_patch_run_twice_gives_the_same(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    refresh.patch(spark.createDataFrame([(1, "a b", 1), (2, "c", 1)], "doc_id long, text string, at int"), folder, "at")
    again = spark.createDataFrame([(2, "b b", 2)], "doc_id long, text string, at int")
    for _ in range(2):
        refresh.patch(again, folder, "at")
    now = spark.createDataFrame([(1, "a b"), (2, "b b")], "doc_id long, text string")
    assert index.status(now, folder) == "fresh"


def test_bm25_tokenises_once_a_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    plan = bm25.score(spark.read.parquet(f"{tmp_path}/d"), {"q": "lamp harbor gold"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 0 or plan.count("1,64") <= 2 * plan.count("FileScan")


def test_of_two_writers_one_wins_and_nothing_of_the_other_stays(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(k, f"word{k} lamp") for k in range(50)], "doc_id long, text string")
    none = docs.select(F.col("doc_id").alias("id")).limit(0)
    assert index.manifest(spark, folder) is None
    index.build(docs, folder)
    seen = index.manifest(spark, folder)
    index.patch(spark, folder, docs.filter("doc_id = 1").withColumn("text", F.lit("first writer")), none)
    segments = set(os.listdir(tmp_path / "index/segments"))
    late = index._write_segment(spark, folder, *index.bm25.postings(docs.limit(1), "doc_id", "text")[:1], index.bm25.postings(docs.limit(1), "doc_id", "text")[1].join(index.signature(docs, "doc_id", "text"), "id"), none)
    with pytest.raises(index.Conflict):
        index._publish(spark, folder, [*seen["segments"], late], "", None, seen)
    assert set(os.listdir(tmp_path / "index/segments")) == segments
    assert index.manifest(spark, folder)["number"] == 2
    now = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("first writer")).otherwise(F.col("text")))
    assert index.status(now, folder) == "fresh"


def test_old_states_go_broken_ones_are_passed_and_orphans_are_vacuumed(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(k, f"word{k} lamp") for k in range(20)], "doc_id long, text string")
    for _ in range(index.KEPT + 2):
        index.build(docs, folder)
    assert len(os.listdir(tmp_path / "index/segments")) == index.KEPT
    newest = index.manifest(spark, folder)["number"]
    broken = tmp_path / f"index/manifests/{newest + 1:020d}.json"
    broken.write_text('{"body": {"format": 3}, "check": "no"}')
    assert index.manifest(spark, folder)["number"] == newest and index.status(docs, folder) == "fresh"
    index.build(docs, folder)
    assert index.manifest(spark, folder)["number"] == newest + 2
    (tmp_path / "index/segments/orphan").mkdir()
    assert index.vacuum(spark, folder) == [] and index.vacuum(spark, folder, -60) == ["orphan"]
    assert index.status(docs, folder) == "fresh"
    os.remove(broken)
    broken.mkdir()  # what is there and can't be read is an error, and no absent index
    os.rename(broken, tmp_path / f"index/manifests/{newest + 9:020d}.json")
    with pytest.raises(Exception):
        index.manifest(spark, folder)


def test_buckets_of_terms_are_the_same_on_both_sides(spark):
    terms = ["lamp", "", "straße", "日本", "x" * 64]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    assert [r.b for r in df.select(index._bucket(97).alias("b")).collect()] == [index._bucket_of(t, 97) for t in terms]


def test_import_states(spark):
    sources = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "3", "x"), ("d", "4", "x"), ("d", "5", "x"), ("e", "6", "x"), (None, "7", "x"), (None, "8", "x"), ("f", "9", "taken"), ("g", None, "x"), ("h", "1", "taken")], "original_id string, digest string, id string")
    existing = spark.createDataFrame([("a", "1"), ("b", "other"), ("c", None), ("e", "6"), ("e", "7"), ("g", "1"), (None, "7"), ("h", "1")], "original_id string, digest string")
    got = changes.import_state(sources, existing, spark.createDataFrame([("taken",), ("taken",)], "id string")).select("original_id", "digest", "state").collect()
    want = [("a", "1", "imported"), ("b", "2", "changed"), ("c", "3", "imported"), ("d", "4", "duplicate_source"), ("d", "5", "duplicate_source"), ("e", "6", "duplicate_source"), (None, "7", "no_source"), (None, "8", "no_source"), ("f", "9", "id_collision"), ("g", None, "changed"), ("h", "1", "imported")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_page_metadata_in_any_quotes_with_references(spark):
    cases = ["&#8217;", "&eacute;", "&mdash;", "&amp;amp;", "&lt;b&gt;", "&#x1F600;", "&#0;", "&#xD800;", "&#150;", "&nosuch;", "&", "a & b", "&copy 2", "&NotEqualTilde;", "&#99999999;", "tail &eacute", "", "none", "&#39;&quot;"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r.u for r in df.select(html_meta.unescape(F.col("c")).alias("u")).collect()] == [html.unescape(c) for c in cases]
    page = """<head><title>A &#8211; B</title><meta name='description' content='it is "so" &eacute;t&eacute;'><meta content=bare property=og:site_name>
    <META NAME="author" CONTENT="x > y"/><meta name="og:descriptions" content="no"><link rel='canonical' href='HTTP://a.org/p?x=1&amp;y=2'></head>"""
    r = html_meta.metadata(spark.createDataFrame([(page, "http://y.org")], "html string, url string")).first()
    assert (r.title, r.description, r.site_name, r.author) == ("A – B", 'it is "so" été', "bare", "x > y")
    assert r.canonical_url.startswith("http://a.org/p") and "amp;" not in r.canonical_url
