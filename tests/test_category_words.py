"""Categories by keywords, from one pass over the words."""

from corpusloom.operators import tagging as G


def test_words_are_read_once(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (2, "c"), (3, "x"), (4, None), (5, "a"), (5, "c"), (5, "c"), (6, "b"), (6, "a"), (6, "c"), (6, "c")]
    spark.createDataFrame(rows, "document_id int, term string").write.parquet(f"{tmp_path}/words")
    keywords = spark.createDataFrame([("hr", "a"), ("hr", "b"), ("finance", "c")], "key string, term string")
    got = G.category_by_keywords(spark.read.parquet(f"{tmp_path}/words"), keywords)
    assert sorted(map(tuple, got.collect())) == [(1, "hr"), (2, "finance"), (3, "user"), (4, "user"), (5, "finance"), (6, "finance")]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Scan parquet") == 1
