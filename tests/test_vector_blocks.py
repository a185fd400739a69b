from corpusloom.operators import retrieval


def test_ties_go_by_chunk_id(spark):
    """Thirty chunks of one vector, the smallest ids last: the first ten by id come out, in whatever blocks."""
    chunks = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(30, 0, -1)] + [(99, None)], "chunk_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(7)], "query_id long, vector array<double>")
    for block in (4096, 4):
        got = retrieval.top_k_blocks(queries, chunks, 10, block).collect()
        assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in got) == [(q, k, k) for q in range(7) for k in range(1, 11)]
    assert retrieval.top_k_blocks(queries.limit(0), chunks, 10).count() == 0
