"""Registered queries on tables that are small but hold what larger ones do, against their SQL."""

import duckdb
from pyspark.sql import functions as F

from vaultspark.operators import bm25, index
from vaultspark.plans import catalog


def agrees(spark, folder, name: str) -> int:
    """Rows of a query, after they are found to be those of its SQL over the Parquet files of a folder."""
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}{'/*.parquet' if file.is_dir() else ''}')")
    want = con.execute(catalog.ORACLES[name]).fetchall()
    got = catalog.QUERIES[name](spark, str(folder)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return len(got)


def test_a_stage_keeps_its_documents_beside_those_of_earlier_stages(spark, tmp_path):
    texts = ["a pathetic thing", "Pathetic\nbody", "pahtetic", "worthless", "worthlesses", "xxxxxthless", "thless", "Erinier\nx", "eriiner", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert agrees(spark, tmp_path, "fallback_body_typo") == 2
    assert agrees(spark, tmp_path, "fallback_word_form") == 1
    assert agrees(spark, tmp_path, "fallback_component") == 2
    assert agrees(spark, tmp_path, "fallback_title_typo") == 1


def test_titles_keep_references_that_are_cut(spark, tmp_path):
    titles = ["a &amp;amp; b &lt;c&gt;", "cut &amp", "cut &lt", "&quot;x&#39;&apos;&nbsp;y&quot;", "", "no reference"]
    rows = [(k, f"<html lang='en'><head><title>{t}</title></head></html>") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert agrees(spark, tmp_path, "html_title") == 6


def test_postings_count_in_the_row_and_add_rows_of_one_key(spark, tmp_path):
    texts = ["b a b", "", None, "Straße STRASSE x" + "y" * 70, "a " * 300, "..."]
    df = spark.createDataFrame([*enumerate(texts), (0, "a c")], "doc_id long, text string")
    df.withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    assert agrees(spark, tmp_path, "term_frequencies") == 5
    terms, _ = bm25.postings(df.filter("doc_id > 0"), "doc_id", "text")
    assert "Exchange" not in terms._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in terms._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, terms.collect())) == [("a", 4, 300), ("strasse", 3, 2)]


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TASK", 100)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    index.build(docs, str(tmp_path / "i"))
    files = spark.read.parquet(str(tmp_path / "i/segments/*/postings")).groupBy(F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in files) < 2000 and sum(r["count"] for r in files) == 6000
    assert index.search(docs, str(tmp_path / "i"), {"q": "same"}).count() == 2000 and index.verify(spark, str(tmp_path / "i"))


def test_items_are_sent_to_the_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d e"), (3, None), (4, "a b c"), (5, "b c d"), (6, "a b c d")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, "a b c d e"), (2, "b c d e f"), (3, "no words at all here")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert agrees(spark, tmp_path, "retrieval_report") == 1 and agrees(spark, tmp_path, "retrieval_metrics") == 1
    ranked, relevant = catalog._by_first_words(spark.read.parquet(str(tmp_path / "documents.parquet")), items.withColumnRenamed("item_id", "query_id"))
    assert "SortMergeJoin" not in relevant._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, relevant.collect())) == [(1, 1), (1, 2), (2, 1)]
