"""Nearest vectors by pivots: equal to a look at all, and blocks of other clusters are left out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vector_index as N


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    rows = np.repeat(centres, 60, axis=0) + 0.05 * rng.normal(size=(1200, 8))
    rows[5] = rows[6]
    rows[7] = 0
    return rows


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory, vectors):
    made = N.VectorIndex(str(tmp_path_factory.mktemp("vectors")))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None)]
    N.build(made, spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>"), block_rows=40)
    return made


def brute(vectors, asked, limit, seen):
    unit = N.units(__import__("pandas").Series(list(vectors)))
    out = {}
    for q, cls, v in asked:
        n = np.linalg.norm(v)
        scores = (unit @ (np.array(v) / (n or 1))).round(N.DECIMALS)
        ids = [i for i in range(len(vectors)) if seen(i, cls)]
        out[q] = sorted(((-scores[i], i) for i in ids))[:limit]
    return out


def test_equal_to_a_look_at_all(spark, index, vectors):
    asked = [(q, q % 2, vectors[q * 40].tolist()) for q in range(30)] + [(90, 0, [0.0] * 8), (91, 1, vectors[5].tolist())]
    see = lambda i, cls: cls == 0 or i % 3 == 0
    frame = spark.createDataFrame(asked, "query_id bigint, class bigint, vector array<double>")
    seen = spark.createDataFrame([(i, [c for c in (0, 1) if see(i, c)]) for i in range(1200)], "chunk_id bigint, classes array<bigint>")
    for limit in (1, 7, 2000):
        met, blocks = N.nearest_visible(index, frame, seen, limit)
        got = {}
        for r in met.collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
        want = brute(vectors, asked, limit, see)
        assert {q: sorted(s)[:limit] for q, s in got.items()} == want
        share = blocks.groupBy("read").agg(F.sum("n").alias("n")).collect()
        read = sum(r["n"] for r in share if r["read"]) / sum(r["n"] for r in share)
        assert read < 0.5 if limit < 10 else read == 1


def test_empty_tables(spark, tmp_path):
    made = N.VectorIndex(str(tmp_path))
    N.build(made, spark.createDataFrame([], "chunk_id bigint, embedding array<double>"))
    asked = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id bigint, class bigint, vector array<double>")
    met, _ = N.nearest_visible(made, asked, spark.createDataFrame([], "chunk_id bigint, classes array<bigint>"), 3)
    assert met.count() == 0


def test_what_is_below_the_bar_is_not_sent():
    some = pd.DataFrame({"query_id": [1, 2], "class": [0, 0], "unit": [[1.0, 0.0], [0.0, 1.0]], "bar": [0.9, -2.0]})
    held = pd.DataFrame({"chunk_id": [3, 2, 1], "unit": [[1.0, 0.0], [0.8, 0.6], [1.0, 0.0]], "classes": [[0], [0], [1]]})
    got = N.nearest_in(2)(some, held)
    assert sorted(zip(got["query_id"], got["chunk_id"], got["score"], strict=True)) == [(1, 3, 1.0), (2, 2, 0.6), (2, 3, 0.0)]
