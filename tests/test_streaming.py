from vaultspark.operators import bm25, index
from vaultspark.streaming import refresh

ROW = "doc_id long, text string, at long, gone boolean"


def test_a_followed_stream_gives_the_index_of_its_newest_documents(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path}/index"
    first = [(1, "zebra old", 1, None), (1, "apple new", 2, False), (2, "old lamp", 1, False), (3, None, 1, None), (5, "short lived", 1, False), (6, "x", 1, False), (6, None, 2, True)]
    second = [(2, "new lamp", 2, False), (4, "harbor lamp", 1, False), (5, None, 2, True), (1, "apple late", None, False), (1, "apple new", 2, False), (6, "back again lamp", 3, False)]
    for rows in (first, second):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(ROW).parquet(str(source))
        refresh.follow(stream, folder, str(tmp_path / "checkpoint"), "at", "gone").awaitTermination()
    now = spark.createDataFrame([(1, "apple new"), (2, "new lamp"), (3, ""), (4, "harbor lamp"), (6, "back again lamp")], "doc_id long, text string")
    assert index.status(now, folder) == "fresh"
    asked = {"q": "lamp harbor zebra"}
    got, want = index.search(now, folder, asked), bm25.score(now, asked)
    assert sorted(map(tuple, got.select("id", "score").collect())) == sorted(map(tuple, want.select("id", "score").collect()))


def test_of_equal_versions_a_deletion_counts_first(spark):
    df = spark.createDataFrame([(1, "b", 1, False), (1, "a", 1, True), (2, "a", 1, None), (2, "b", 1, None), (3, "x", None, None), (None, "n", 1, None)], ROW)
    assert sorted(map(tuple, refresh.newest(df, "doc_id", "text", "at", "gone").collect()), key=str) == sorted([(1, "a", True), (2, "b", False), (3, "x", False), (None, "n", False)], key=str)
