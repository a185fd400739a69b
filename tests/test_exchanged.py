"""What storing the library and fusing lists exchange: first chunks, plain ids, and no texts that nobody asked for."""

from pyspark.sql import functions as F

from corpusloom.operators import keyword_index as K
from corpusloom.operators import retrieval as R
from corpusloom.plans import binding as B


def planned(spark, make):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_only_first_chunks_meet_the_vectors(spark, sf_dir):
    plan = planned(spark, lambda: B.searchable(spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 2 and "Union" in plan  # first chunks and vectors


def test_chunks_are_those_of_the_windows(spark, tmp_path):
    """Blank beginnings, texts of one window, of none and of many: the first chunk has the vector, and all have their document's columns."""
    texts = ["a" * 2600, " " * 1600 + "b" * 1200, "short", " ", None, "c" * 1000 + " d", ""]
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in (0, 1, 3, 5)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["document_id"], r["chunk_index"]): r for r in B.searchable(spark, str(tmp_path)).collect()}
    plain = {(r["document_id"], r["chunk_index"]): r for r in B.chunks(spark, str(tmp_path)).collect()}
    assert {k: (r["chunk_id"], r["start"], r["content"]) for k, r in got.items()} == {k: (r["chunk_id"], r["start"], r["content"]) for k, r in plain.items()} and len(got) == 10
    assert {k: r["embedding"] for k, r in got.items() if r["embedding"] is not None} == {(i, 0): [float(i), 1.0] for i in (0, 1, 5)}
    assert all(r["title"] == f"doc_{d}" and r["doc_acl"] == r["acl"] and r["metadata"] == {"chunk_index": str(k)} for (d, k), r in got.items())


def test_postings_are_plain_ids(spark, tmp_path):
    """A row has one frequency; words that are rare in a share of 4,096 chunks don't make a row each where more chunks share one."""
    texts = spark.range(9000).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.lit("w w w"), F.concat(F.lit("x"), F.col("id") % 100), F.lit("w")).alias("content"))
    index = K.KeywordIndex(str(tmp_path), buckets=4)
    K.build(index, texts)
    ((_, place, _),) = index.generations(spark)
    rows = spark.read.parquet(f"{place}/rows")
    assert dict(rows.dtypes)["chunk_ids"] == "array<bigint>" and rows.filter("n <> size(chunk_ids)").count() == 0
    shares = rows.select("share").distinct().count()
    assert shares == K._power(9000 / K.SMALL_SHARE) and rows.count() <= 101 * shares
    assert {tuple(r) for r in rows.groupBy("term", "tf").agg(F.sum("n")).collect()} == {("w", 4, 9000)} | {(f"x{k}", 1, 90) for k in range(100)}
    assert K._power(14_000_000 / K.SHARE) <= 1024


def test_fused_lists_move_no_texts(spark):
    """The key of a text is made where its list is; who doesn't ask for texts has none exchanged."""
    ranked = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id long, content string, score double, fts_rank double, rank int")
    vector, keyword = ranked([(1, 1, "A  text", 0.9, 0.0, 1), (1, 2, "b", 0.8, 0.0, 2)]), ranked([(1, 3, "a text", 0.0, 0.5, 1), (1, 2, "b", 0.8, 0.2, 2)])
    for fused in (R.fuse_scores, R.fuse_rrf):
        found = fused(vector.drop("fts_rank"), keyword, 5)
        assert sorted((r["chunk_id"], r["content"]) for r in found.collect()) == [(1, "A  text"), (2, "b")]
        plan = planned(spark, lambda: found.select("query_id", "chunk_id"))  # noqa: B023
        assert "v_content" not in plan and "k_content" not in plan and "v_key" in plan
