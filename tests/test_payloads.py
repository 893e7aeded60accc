import pytest
from pyspark.sql import functions as F

from vaultspark.operators import graph, inventory, paging
from vaultspark.sources import payloads


def test_payloads_refuse_unknown_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "T", "tags": ["x"]}')
    got = payloads.payloads(spark, str(tmp_path), "title string, tags array<string>, url string").first()
    assert (got.title, got.tags, got.url) == ("T", ["x"], None)
    (tmp_path / "b.json").write_text('{"title": "T", "odd": 1, "bad": 2}')
    with pytest.raises(Exception, match="unknown fields: bad, odd"):
        payloads.payloads(spark, str(tmp_path), "title string, tags array<string>").collect()
    assert payloads.payloads(spark, str(tmp_path), "title string", closed=False).count() == 2
    for bad in ("[1]", "no json", " "):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(Exception, match="no JSON object"):
            payloads.payloads(spark, str(tmp_path), "title string, tags array<string>").select("title").collect()


def test_relation_definitions_and_arguments(spark):
    text = "version: 1\nrelations:\n  related_to:\n    symmetric: true\n  involves:\n    inverse: experienced_in\n    label: \"x\"\n  took_place_at:\n    inverse: \"hosted\"\n"
    got = {r.predicate: (r.symmetric, r.inverse) for r in payloads.relation_definitions(spark, text).collect()}
    assert got == {"related_to": (True, None), "involves": (False, "experienced_in"), "took_place_at": (False, "hosted")}
    df = spark.createDataFrame([("near:kn_a:b",), ("none",)], "v string")
    assert [r[0] and tuple(r[0]) for r in df.select(payloads.relation_argument(F.col("v"))).collect()] == [("near", "kn_a:b"), None]


def test_assets_by_path_then_only_name(spark):
    assets = spark.createDataFrame([("img/A.png",), ("img/b.png",), ("other/b.png",), ("x.pdf",)], "path string")
    links = spark.createDataFrame([("n", "IMG/a.png"), ("n", "a.png"), ("n", "b.png"), ("n", "other/B.png"), ("n", "../x.pdf"), ("n", "deep/x.pdf")], "source string, link string")
    got = {r.link: r.resolved for r in graph.resolve_assets(links, assets).collect()}
    assert got == {"IMG/a.png": "img/A.png", "a.png": "img/A.png", "b.png": None, "other/B.png": "other/b.png", "../x.pdf": None, "deep/x.pdf": "x.pdf"}


def test_one_attachment(spark):
    e = spark.createDataFrame([("1", [("a", "p"), ("b", "q")]), ("2", [("a", "r")])], "id string, attachments array<struct<id:string,path:string>>")
    assert [r.attachment.path for r in graph.attachment_of(e, "1", "a").collect()] == ["p"] and graph.attachment_of(e, "2", "b").count() == 0


def test_report_counts_empty_answers(spark):
    asked = spark.createDataFrame([("q", "x"), ("r", "x"), ("s", "y"), ("t", "y")], "query_id string, kind string")
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "c", 9), ("s", "d", 1)], "query_id string, id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("r", "c")], "query_id string, id string")
    got = {r.kind: tuple(r)[1:] for r in inventory.retrieval_report(asked, ranked, relevant, 5, "kind").collect()}
    assert got == {"x": (2, 0.5, 0.5, 0.25, 0, 0), "y": (0, None, 0.0, None, 2, 1), None: (2, 0.5, round(1 / 3, 6), 0.25, 2, 1)}


def test_retrieve_is_bounded_and_newest_are_oldest_first(spark):
    df = spark.createDataFrame([(k, k % 5, "x" * 10) for k in range(20)], "id long, at long, body string")
    assert [r.granted for r in paging.retrieve(df, [F.asc("id")], "body", 3, 25).orderBy("id").collect()] == [10, 10, 5]
    for bad in ({"limit": 11}, {"most": 0}, {"most": 100_001}):
        with pytest.raises(ValueError):
            paging.retrieve(df, [F.asc("id")], "body", **bad)
    assert [(r.at, r.id) for r in paging.newest(df, "at", "id", 5).collect()] == [(3, 18), (4, 4), (4, 9), (4, 14), (4, 19)]
