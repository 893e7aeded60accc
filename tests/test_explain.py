import json

import pytest
from pyspark.sql import functions as F

from vaultspark.operators import explain, sections

B, E = sections.BEGIN, sections.END


def runs(spark, body):
    df = spark.createDataFrame([("a", body), ("b", "other")], "id string, body string")
    return [tuple(r)[1:] for r in sections.origins(df).filter("id = 'a'").orderBy("section").collect()]


@pytest.mark.parametrize(
    "lines,want",
    [
        (["one", "two"], [(0, None, "user", False, 1, 2)]),
        (["mine", B, "## Fetched", "text", E, "after"], [(0, None, "user", False, 1, 1), (1, "Fetched", "web", True, 2, 5), (2, "Fetched", "user", False, 6, 6)]),
        (["mine", B, E, "more"], [(0, None, "user", False, 1, 4)]),
        ([B, "never closed", "## Mine?", "x"], [(0, None, "web", True, 1, 2), (1, "Mine?", "web", True, 3, 4)]),
        (["## generated SUMMARY", "old", "## Notes", "own"], [(0, "generated SUMMARY", "web", False, 1, 2), (1, "Notes", "user", False, 3, 4)]),
        (["## Generated summary", B, "x", E, "mine"], [(0, "Generated summary", "user", False, 1, 1), (1, "Generated summary", "web", True, 2, 4), (2, "Generated summary", "user", False, 5, 5)]),
        ([f"  {B} ", "x", E, "", "## A", "## A", "y"], [(0, None, "web", True, 1, 3), (1, None, "user", False, 4, 4), (2, "A", "user", False, 5, 7)]),
        ([], []),
    ],
)
def test_origins_of_sections(spark, lines, want):
    assert runs(spark, "\n".join(lines)) == want


def test_lines_end_in_any_notation(spark):
    df = spark.createDataFrame([("a", "1\r\n2\r3\x0b4 5\n"), ("b", None), ("c", "\n\n")], "id string, body string")
    got = sorted((r.id, r.no, r.line) for r in sections.lines(df).collect())
    assert got == [("a", k, str(k)) for k in range(1, 6)] + [("c", 1, ""), ("c", 2, "")]


ROW = "id string, type string, title string, aliases array<string>, tags array<string>, author string, parts array<string>, hidden string, provenance map<string,string>, body string, matched array<string>"


def entry(**own):
    row = {"id": "a", "type": "book", "title": None, "aliases": None, "tags": None, "author": None, "parts": None, "hidden": None, "provenance": None, "body": None, "matched": None} | own
    return tuple(row[n.split()[0]] for n in ROW.split(", "))


def found(spark, query, rows, **how):
    df = spark.createDataFrame(rows, ROW)
    out = explain.evidence(df, query, {"book": ["author", "parts"], "film": ["hidden"]}, **how)
    return [tuple(r) for r in out.orderBy("id", "n").collect()]


def test_fields_in_order_with_their_origins(spark):
    rows = [
        entry(title="The needle", aliases=["pin", "Needle"], tags=["needle"], author='A "needle" B', parts=["x", "needle"], hidden="needle", provenance={"title": "web", "author": "user"}, body="needle"),
        entry(id="b", title="none", body=f"Mine.\n{B}\nFetched needle {'x' * 400}\n{E}\nown needle"),
        entry(id="c", title="nothing"),
    ]
    got = found(spark, "needle", rows)
    assert [g[:4] for g in got if g[0] == "a"] == [("a", 1, "title", None), ("a", 2, "aliases", None), ("a", 3, "tags", None), ("a", 4, "attributes.author", None), ("a", 5, "attributes.parts", None)]
    assert [g[5] for g in got if g[0] == "a"] == ["web", "unknown", "unknown", "user", "unknown"]
    assert [g[4] for g in got if g[0] == "a"] == ["The needle", "['pin', 'Needle']", "['needle']", '"A \\"needle\\" B"', '["x", "needle"]']
    fetched, own = (g for g in got if g[0] == "b")
    assert (fetched[2], fetched[3], len(fetched[4]), fetched[5], fetched[6]) == ("body", 3, 240, "web", True)
    assert own == ("b", 2, "body", 5, "own needle", "user", False)


def test_excerpts_hold_the_match_whatever_folding_does(spark):
    (got,) = found(spark, "north", [entry(title="Compatibility forms", body="ß" * 300 + " ＮＯＲＴＨ here")])
    assert "ＮＯＲＴＨ" in got[4] and got[6]
    assert found(spark, "strasse 9", [entry(body="x " * 100 + "in der Straße steht")])[0][4][60:] == "Straße steht"


def test_words_count_when_ranked_and_matched_terms_always(spark):
    rows = [entry(title="old lamp", body="harbor\nlampshade", matched=["lampshade"])]
    assert [g[2:4] for g in found(spark, "lamp harbor", rows)] == [("title", None), ("body", 1)]
    assert found(spark, "lamp harbor", rows, ranked=False) == []
    assert [g[3] for g in found(spark, "zzz", rows, matched="matched")] == [2]
    assert found(spark, "", rows) == []
    assert len(found(spark, "needle", [entry(title="needle", body="\n".join(f"## needle {n}" for n in range(10)))])) == 5


def test_results_say_what_matched(spark):
    rel = "array<struct<target:string,valid_from:string,valid_until:string>>"
    rows = spark.createDataFrame([("a", "T", [("x", None, None), ("y", "2030-01-01T00:00:00Z", None)]), ("b", "U", []), ("c", "V", None)], f"id string, title string, relations {rel}")
    hits = spark.createDataFrame([("a", -1.0, ["lamps"]), ("b", 2.0, []), ("c", -3.0, ["hrabor"])], "id string, score double, terms array<string>")
    got = {r.id: json.loads(r.result) for r in explain.results(hits, rows, as_of="2026-01-01T00:00:00Z").collect()}
    assert got["a"] == {"id": "a", "title": "T", "relation_count": 1, "attachment_count": 0, "match_kind": "word_form", "matched_terms": ["lamps"], "not_in_force_relation_count": 1}
    assert got["b"] == {"id": "b", "title": "U", "relation_count": 0, "attachment_count": 0}
    assert got["c"]["match_kind"] == "typo" and got["c"]["matched_terms"] == ["hrabor"] and got["c"]["relation_count"] == 0
    fused = hits.select("id", F.lit(5.0).alias("score"), F.array(F.struct(F.lit("q0").alias("query_id"), F.lit("lexical").alias("match_kind"))).alias("evidence"))
    assert json.loads(explain.results(fused, rows).filter("id = 'b'").first().result)["query_matches"] == [{"query_id": "q0", "match_kind": "lexical"}]
