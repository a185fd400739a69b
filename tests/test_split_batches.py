"""What splitting holds in a Python worker, and how documents reach it."""

import pytest

from corpusloom.operators import chunking as C


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _pages(spark, n):
    return spark.createDataFrame([(i % 7, i // 7, f"Page {i}. It has words.") for i in range(n)], "document_id long, page_number int, text string").coalesce(1)


@pytest.mark.parametrize("mode", [C.JOINED, C.CARRIED])
def test_documents_are_rows_and_not_groups_of_pandas(spark, mode):
    pages = _pages(spark, 50).unionByName(spark.createDataFrame([(9, 1, None), (9, 2, " ")], "document_id long, page_number int, text string"))
    cut = C.split_pages(pages, lambda t: C.recursive_pieces(t, 30, 5), mode, 5)
    assert "FlatMapGroups" not in _plan(cut)
    got = sorted(map(tuple, cut.select("document_id", "chunk_index", "page_number", "start", "content").collect()))
    want = []
    for d in range(7):
        listed = [(i // 7, f"Page {i}. It has words.") for i in range(50) if i % 7 == d]
        want += [(d, k, p, a, c) for k, (p, a, c, _) in enumerate(C.placed_chunks(listed, lambda t: C.recursive_pieces(t, 30, 5), mode, 5))]
    assert got == want


def test_a_batch_is_split_some_pages_at_a_time(spark):
    class Picky:
        def __call__(self, text):
            return [text]

        def many(self, texts):
            assert len(texts) <= 256
            return [[t] for t in texts]

    assert C.split_pages(_pages(spark, 1000), Picky()).count() == 1000
    plain = C.split_pages(_pages(spark, 10), lambda t: [t])
    assert "BatchEvalPython" in _plan(plain) and "MapInPandas" not in _plan(plain)
    assert plain.count() == 10
    assert list(C.few([900_000, 200_000, 5, 2_000_000, 1])) == [(0, 1), (1, 3), (3, 4), (4, 5)] and not list(C.few([]))
