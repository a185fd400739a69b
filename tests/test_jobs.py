"""What a job says of texts that could not be split."""

from corpusloom.operators import chunking as C
from corpusloom.operators import jobs as J


def picky(text):
    if "bad" in text:
        raise ValueError("a bad page")
    return C.window_pieces(text, 10, 0)


def test_failures_are_told_and_the_rest_is_split(spark):
    rows = [("a", 1, "good text"), ("a", 2, "bad text"), ("b", 1, None), ("b", 2, "  "), ("c", 1, "all bad")]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string")
    told = sorted(map(tuple, J.split_failures(pages, picky).collect()))
    assert told == [("a", 2, "ValueError: a bad page"), ("c", 1, "ValueError: a bad page")]
    cut = C.split_pages(pages, J.guarded(picky)).collect()
    assert {(r["document_id"], r["page_number"], r["chunk_index"], r["content"]) for r in cut} == {("a", 1, 0, "good text")}
    assert J.split_failures(pages.limit(0), picky).count() == 0
