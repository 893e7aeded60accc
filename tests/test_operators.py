import json

import pytest
from pyspark.sql import functions as F

from vaultspark.functions import text as T
from vaultspark.operators import bm25, changes, filters, graph, index, inventory, paging, ranking, sections, temporal, validation
from vaultspark.plans import views
from vaultspark.sources import html_meta, markdown, notes

DOCS = [(1, "Azure harbor lamp. Lamp!"), (2, "old lamp"), (3, "a garden with nothing"), (4, None), (5, "harbors of gold")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").cache()


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_scan_and_postings_agree(spark, docs):
    asked = {"a": "lamp harbor", "b": "nothing", "c": "!!!"}
    scan = bm25.score(docs, asked)
    terms, lengths = bm25.postings(docs, "doc_id", "text")
    listed = bm25.score_postings(terms, lengths, asked)
    assert rows(scan, "query_id", "id") == rows(listed.select(*scan.columns), "query_id", "id")
    assert scan.count() == 3
    with pytest.raises(ValueError):
        bm25.score(docs, asked, b=2)


def test_hybrid_and_empty_queries(docs):
    assert ranking.hybrid(docs, "").count() == 5
    assert {r.id: r.score > 0 for r in ranking.hybrid(docs, "arbor").collect()} == {1: False, 5: False}
    assert ranking.hybrid(docs, "!!!").count() == 0


def test_stages_stop_at_the_first_with_hits(docs):
    stage = lambda q, keep=None: {(r.id, r.stage) for r in ranking.stages(docs, q, keep=keep).collect()}
    assert stage("lamp") == {(1, 0), (2, 0)}
    assert stage("gardens") == {(3, 1)}
    assert stage("nohting") == {(3, 2)}
    assert stage("lamp", F.col("doc_id") == 3) == set()
    assert stage(" ".join(f"gardens{k}" for k in range(20))) == set()


def test_fusion_and_rerank(spark):
    scored = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0), ("b", 2, 5.0)], "query_id string, id long, score double")
    got = {r.id: (r.rrf, r.best) for r in ranking.fuse(scored).collect()}
    assert got == {1: (round(1 / 61, 9), 2.0), 2: (round(1 / 62 + 1 / 61, 9), 5.0)}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    again = ranking.rerank(scored.filter("query_id = 'a'"), vectors, [1.0, 1.0])
    assert rows(again, "id") == [(1, 1, round(0.5**0.5, 9)), (2, 0, 1.0)]


def test_paging_sorts_and_budget(spark):
    df = spark.createDataFrame([("a", None, "xx"), ("b", 5, "yyyy"), ("c", 7, "zzz")], "id string, updated long, body string")
    assert [r.id for r in df.orderBy(*paging.order("updated_asc")).collect()] == ["a", "b", "c"]
    assert [r.id for r in df.orderBy(*paging.order("updated_desc")).collect()] == ["c", "b", "a"]
    e = paging.envelope(df, [F.asc("id")], 2)
    assert (e["total"], e["returned"], e["has_more"], e["next_offset"]) == (3, 2, True, 2)
    assert rows(paging.budget(df, [F.asc("id")], "body", 5).select("id", "granted"), "id") == [("a", 2), ("b", 3), ("c", 0)]
    with pytest.raises(ValueError):
        paging.page(df, [F.asc("id")], 51)


def test_evidence_counts_lines(docs):
    assert rows(paging.evidence(docs, "LAMP").select("id", "n", "line"), "id", "n") == [(1, 1, 1), (2, 1, 1)]


ENTRY = "id string, status string, sensitivity string, created_at string, updated_at string, tags array<string>, aliases array<string>, relations array<struct<predicate:string,target:string,valid_from:string,valid_until:string,superseded_by:string>>, attachments array<struct<sha256:string>>"
A, B = "kn_" + "a" * 32, "kn_" + "b" * 32
T1, T2 = "2026-01-01T00:00:00+00:00", "2026-06-01T00:00:00+00:00"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(A, "active", "normal", T1, T1, ["x"], ["n"], [("near", B, T1, T2, None), ("likes", "kn_gone", None, None, None)], [("d1",)]), (B, "active", "odd", "never", T1, [], [], [], [])], ENTRY)


def test_filters_on_relations_follow_time(entries):
    inside, at_end = "2026-03-01T02:00:00+02:00", T2
    assert entries.filter(filters.related(B, "near", inside)).count() == 1
    assert entries.filter(filters.related(B, "near", at_end)).count() == 0
    assert entries.filter(filters.related(B, "likes")).count() == 0
    assert entries.filter(filters.has_attachment(True)).count() == 1
    assert entries.filter(filters.window("created_at", after=T1)).count() == 1
    split = temporal.split_as_of(entries, at_end).filter(F.col("id") == A).first()
    assert (len(split.in_force), len(split.not_in_force)) == (1, 1)


def test_validation_report(spark, entries):
    edges = temporal.edges(entries)
    trash = entries.filter(F.col("id") == B)
    got = {(r.id, r.problem) for r in validation.report(entries, edges, trash, [validation.Field("sensitivity", "enum", values=("normal",))]).collect()}
    assert got == {(A, "missing target kn_gone"), (A, f"trashed target {B}"), (B, "sensitivity is not valid"), (B, "created_at is not an instant")}
    assert validation.unknown_fields(entries, ["id"])[0] == "aliases"


def test_changes_are_snapshots(entries):
    tagged = changes.tag(entries, A, [" Y", "X"], ["x"], T2).filter(F.col("id") == A).first()
    assert tagged.tags == ["Y"] and tagged.updated_at == T2
    closed = changes.supersede(entries, A, "near", B, "kn_new", T1).filter(F.col("id") == A).first()
    assert closed.relations[0].superseded_by == "kn_new" and closed.relations[0].valid_until == T2
    merged = graph.merge(entries, B, A)
    assert [r.id for r in merged.collect()] == [B] and merged.first().tags == ["x"]
    with pytest.raises(KeyError):
        changes.one(entries, "none")
    new = entries.filter(F.col("id") == A).withColumn("id", F.lit("kn_c"))
    after, refused = changes.insert(entries, new, [F.get("aliases", F.lit(0))])
    assert after.count() == 2 and refused.count() == 1


def test_migration_walks_the_ladder(spark):
    df = spark.createDataFrame([("a", 0, "t"), ("b", 2, "t"), ("c", 1, "t")], "id string, schema_version int, title string")
    got = changes.migrate(df, {1: lambda d: d.withColumn("title", F.upper("title"))}, 3)
    assert rows(got.select("id", "schema_version", "title"), "id") == [("a", 3, "T"), ("b", 3, "t"), ("c", 3, "T")]
    with pytest.raises(Exception, match="newer"):
        changes.migrate(df.withColumn("schema_version", F.lit(9)), {}, 3).collect()


def test_supersession_contradictions_and_cycles(spark):
    e = spark.createDataFrame([("s", "p", "a", 10, 20, "b"), ("s", "p", "b", 15, None, None), ("s", "p", "c", 1, 2, "d"), ("s", "p", "d", 2, 3, "c"), ("s", "q", "x", 1, 2, "x"), ("s", "p", "e", 0, None, "gone")], "source string, predicate string, target string, valid_from long, valid_until long, superseded_by string")
    got = {(r.target, r.problem) for r in temporal.contradictions(e).collect()}
    assert got == {("a", "overlaps successor"), ("x", "superseded by itself"), ("e", "successor is not asserted"), ("e", "no valid_until"), ("d", "successor starts before"), ("d", "overlaps successor")}
    assert {r.target for r in temporal.cycles(e).collect()} == {"c", "d", "x"}


def test_links_resolve_by_path_then_stem_then_unique_name(spark):
    known = spark.createDataFrame([("1", "a/one.md", ["Uno"]), ("2", "b/two.md", []), ("3", "c/two.md", [])], "id string, path string, names array<string>")
    links = spark.createDataFrame([("x", "a/one.md"), ("x", "a/one"), ("x", "uno"), ("x", "two"), ("x", "nope")], "source string, link string")
    got = {r.link: r.resolved for r in graph.resolve_links(links, known).collect()}
    assert got == {"a/one.md": "1", "a/one": "1", "uno": "1", "two": None, "nope": None}


def test_index_is_patched_rebuilt_and_equal_to_a_scan(spark, tmp_path, docs):
    folder, asked = f"file://{tmp_path}/index", {"q": "lamp harbor gold"}
    assert index.status(docs, folder) == "absent"
    assert index.refresh(docs, folder) == "rebuilt"
    assert index.refresh(docs, folder) == "unchanged"
    changed = docs.filter("doc_id <> 2").withColumn("text", F.when(F.col("doc_id") == 3, F.lit("gold lamp")).otherwise(F.col("text")))
    assert index.status(changed, folder) == "stale"
    stale = index.search(changed, folder, asked)
    want = rows(bm25.score(changed, asked), "id")
    assert rows(stale.select("query_id", "id", "score"), "id") == want
    assert index.refresh(changed, folder) == "patched"
    assert rows(index.search(changed, folder, asked).select("query_id", "id", "score"), "id") == want
    assert index.status(changed, folder, fingerprint="other") == "stale_format"


def test_facets_queue_metrics_and_digest(spark, docs):
    f = spark.createDataFrame([("a", "x"), ("a", None), ("", "x")], "t string, s string")
    assert rows(inventory.facets(f, ["t", "s"]), "facet", "value") == [("s", "x", 2), ("t", "a", 2)]
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "c", 9)], "query_id string, id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("r", "c"), ("s", "z")], "query_id string, id string")
    m = inventory.retrieval_metrics(ranked, relevant, 5).first()
    assert (m.queries, m.recall_at_k, m.mrr) == (3, round(1 / 3, 6), round(0.5 / 3, 6))
    digest = lambda df: inventory.snapshot_digest(df, "doc_id", "text").first()[0]
    assert digest(docs) == digest(docs.repartition(3)) != digest(docs.filter("doc_id > 1"))


def test_candidates(spark):
    e = spark.createDataFrame([("1", "Azure Harbor"), ("2", "azure  harbor"), ("3", "Harbor of Azure"), ("4", "Else")], "id string, title string")
    got = {(r.a, r.b) for r in graph.candidate_pairs(e, "id", "title").collect()}
    assert ("1", "3") in got and all("4" not in p for p in got)
    found = graph.candidates_of(e, {"id": "1", "names": ["azure harbor"], "words": ["azure", "harbor"]}).collect()
    assert [r.id for r in found] == ["2", "3"]


def test_sections(spark):
    d = spark.createDataFrame([(1, "intro\n# A\nx\n# B"), (2, "")], "doc_id long, text string")
    assert rows(sections.sections(d), "id", "section") == [(1, 0, None, 1, 1), (1, 1, "A", 2, 3), (1, 2, "B", 4, 4), (2, 0, None, 1, 1)]


def test_views_are_bounded(spark, docs):
    e = docs.withColumnRenamed("doc_id", "id").withColumn("type", F.lit("place"))
    saved = {"lamps": views.Search("lamp", {"type": "place"}, "relevance", 1)}
    assert views.run(saved, "lamps", e).count() == 1 and views.run(saved, "lamps", e, limit=5).count() == 2


DOC = """---
title: "A: b"   # note
tags: [x, 'y z', "q,r"]
nested:
  deep:
    - 1
    - k: v
      w: 2.5
text: |
  one
   two
empty:
---

Body
"""


def test_frontmatter_dialects():
    metadata, body = markdown.parse(DOC)
    assert metadata == {"title": "A: b", "tags": ["x", "y z", "q,r"], "nested": {"deep": [1, {"k": "v", "w": 2.5}]}, "text": "one\n two\n", "empty": None}
    assert body == "Body\n"
    assert markdown.parse(markdown.render(metadata, body)) == (metadata, body)
    for bad in ("no fence", "---\na: 1\n", "---\na: &x 1\n---\n", "---\na: 1\na: 2\n---\n", "---\n<<: {a: 1}\n---\n", "---\na: !t 1\n---\n", '---\na: {"b": 1, "b": 2}\n---\n'):
        with pytest.raises(markdown.FrontmatterError):
            markdown.parse(bad)


def test_collection_keeps_unreadable_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text('---\ntype: "place"\nattributes: {"place_kind":"cafe"}\n---\n\nHi [[b|B]] #tag `#no`')
    (tmp_path / "sub" / "b.md").write_text("nothing")
    (tmp_path / "c.txt").write_text("not read")
    got = markdown.entries(spark, str(tmp_path)).withColumn("kind", markdown.field("place_kind")).orderBy("path").collect()
    assert [(r.kind, r.parse_error is None) for r in got] == [("cafe", True), (None, False)]
    df = spark.createDataFrame([("Hi [[b#s|B]] ![[i.png]] #tag `#no`\n```\n[[x]]\n```",)], "body string")
    r = df.select(notes.wikilinks(F.col("body")).alias("l"), notes.inline_tags(F.col("body")).alias("t")).first()
    assert [(x.embed, x.target, x.section, x.display) for x in r.l] == [(False, "b", "s", "B"), (True, "i.png", "", "")] and r.t == ["tag"]


def test_html_metadata(spark):
    html = '<html lang="EN"><head><meta charset=utf-8><title> A &amp;\n b </title><link rel="canonical" href="http://X.org:80?b=1&amp;a=2"><meta property="og:type" content="article"><meta name="description" content="d &lt; e"></head>'
    r = html_meta.metadata(spark.createDataFrame([(html, "http://y.org")], "html string, url string")).first()
    assert (r.title, r.language, r.charset, r.canonical_url, r.kind, r.description, r.author) == ("A & b", "en", "utf-8", "http://x.org/?a=2&b=1", "article", "d < e", None)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert json.dumps(sorted(e.queries()))


def test_places_are_those_of_a_window(spark):
    from vaultspark.operators import ranks

    rows = [(k % 3 if k % 7 else None, (k * 37) % 11, k) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, score int, id int").repartition(6)
    got = {r.id: r.rank for r in ranks.placed(df, ["g"], [F.desc("score"), F.asc("id")]).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        want |= {x[2]: n for n, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])), 1)}
    assert got == want
    assert ranks.placed(df.limit(0), ["g"], [F.asc("id")]).count() == 0


def test_hybrid_takes_terms_and_literals_in_one_scan(spark):
    df = spark.createDataFrame([(1, "The MIT License"), (2, "mit"), (3, "submit license"), (4, "hermit licenses"), (5, None), (6, "mit-license"), (7, "xmit licensed")], "doc_id long, text string")
    got = {r.id: r.score for r in ranking.hybrid(df, "mit license").collect()}
    scored = {r.id: r.score for r in bm25.score(df, {"q": "mit license"}).collect()}
    held = {r.id for r in ranking.literal(df, "mit license").collect()}
    assert got == {**{i: 0.0 for i in held}, **scored} and 7 in held - set(scored)


def test_unfolded_places_in_lines_that_folding_lengthens(spark):
    lines = ["ßß lamp", "plain lamp", "½ﬁ lamp ß", "lamp", "İ lamp"]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    got = df.select(paging.unfolded(F.col("t"), F.position(F.lit("lamp"), T.fold(F.col("t")))).alias("p")).collect()
    assert [r.p for r in got] == [t.index("lamp") + 1 for t in lines]


VIEWS = """format_version: 1
views:
  unread_articles:
    title: "Unread articles"
    description: "Articles retained for later."
    query: ""
    type: "bookmark"
    bookmark_kind: "article"
    reading_status: "unread"
    sort: "title_asc"
    limit: 20
  well_liked:
    title: Well liked near harbors
    query: harbor
    rank: substring
    min_rating: 4
    experienced: true
    occurred_after: "2026-01-01T00:00:00+01:00"
    occurred_before: "2026-02-01T00:00:00Z"
    related_id: x
    relation_predicate: near
    as_of: "2026-01-15T00:00:00Z"
    attribute_filters: {colour: blue}
"""


def test_saved_views_take_every_filter(spark):
    saved = views.load(VIEWS)
    assert saved["unread_articles"].rank == "hybrid"
    marks = spark.createDataFrame([("1", "Unread article", "article", "unread"), ("2", "Read article", "article", "read"), ("3", "Unread tool", "tool", "unread")], "id string, title string, bookmark_kind string, reading_status string")
    assert [r.id for r in views.run(saved, "unread_articles", marks.withColumn("type", F.lit("bookmark")).withColumn("text", F.col("title"))).collect()] == ["1"]
    good = ("g", "Old HARBOR", 5, "2026-01-10T00:00:00Z", "2026-01-10T00:00:00Z", ("blue",), [("near", "x", None, None)])
    other = lambda id, **k: tuple({**dict(zip(("id", "text", "rating", "last", "at", "attributes", "relations"), good)), "id": id, **k}.values())
    rows = [good, other("a", text="lamp"), other("b", rating=3), other("c", last=None), other("d", at="2026-02-01T00:00:00Z"), other("e", at="2025-12-31T22:59:59Z"), other("f", attributes=("red",)), other("h", relations=[("near", "y", None, None), ("far", "x", None, None)]), other("i", relations=[("near", "x", "2026-01-16T00:00:00Z", None)]), other("j", at="2025-12-31T23:00:00Z")]
    df = spark.createDataFrame(rows, "id string, text string, rating int, last_experienced_at string, occurred_at string, attributes struct<colour:string>, relations array<struct<predicate:string,target:string,valid_from:string,valid_until:string>>")
    assert sorted(r.id for r in views.run(saved, "well_liked", df).collect()) == ["g", "j"]
    assert sorted(r.id for r in views.run(saved, "well_liked", df, as_of="2026-01-20T00:00:00Z").collect()) == ["g", "i", "j"]
    assert len(views.run(saved, "well_liked", df, limit=1, offset=1).collect()) == 1


@pytest.mark.parametrize("change", [{"command": "x"}, {"title": " "}, {"min_rating": 6}, {"limit": 51}, {"sort": "random"}, {"rank": "none"}, {"as_of": "2026-01-01"}, {"relation_predicate": "A b"}, {"occurred_after": "2026-02-01T00:00:00Z", "occurred_before": "2026-01-01T00:00:00Z"}])
def test_saved_views_refuse_what_is_not_allowed(change):
    with pytest.raises(ValueError):
        views.read({"v": {"title": "V"} | change})
    with pytest.raises(ValueError):
        views.read({"Bad Name": {"title": "V"}})
    with pytest.raises(ValueError):
        views.load("views:\n")
