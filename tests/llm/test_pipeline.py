"""The pipeline's stages against brute force, on one small table."""

from collections import Counter

import pytest

from corpusloom.llm import mixing
from tests.llm.test_operators import brute_contamination, brute_quality


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages(spark, sf_dir, outputs):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    for _, out in outputs[:-1]:
        assert out.columns == columns
    (raw, good), (_, single), (_, clean), (_, mixed), (_, sharded) = outputs
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(good) == sorted(x[0] for x in brute_quality(raw.collect()) if x[-1])
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows.items()}
    kept = set(ids(single))
    for i in set(sets) - kept:  # a document that went is like one that came before it
        assert any(len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) for j in sets if j < i)
    for i in kept:
        assert not any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert ids(clean) == sorted(d for d, *_, bad in brute_contamination([(r["doc_id"], r["text"]) for r in single.collect()], items) if not bad)
    assert Counter(ids(mixed)) == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect() if r["copies"]})
    assert ids(sharded) == ids(mixed) and {"shard", "slot"} <= set(sharded.columns)


def test_stages_of_odd_tables(spark, sf_dir, tmp_path):
    """Null, empty, long, equal and repeated rows, a column with a working name, string ids; and a table without rows."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(20_000))
    fine = " ".join(f"a{i}" for i in range(80))
    rows = [(None, None, None), ("1", "", "s"), ("2", long, "s"), ("2", long, "s"), ("3", fine, None), ("4", fine, "t"), (None, f"{fine} {fine[::-1]}", "t"), ("3", f"{long} x", "u")]
    odd = spark.createDataFrame(rows, "doc_id string, text string, source string").selectExpr("*", "'clash' as id", "1 as copy", "'x' as one", "'y' as size", "2 as shard")
    for k, docs in enumerate((odd, odd.limit(0))):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{k}-{n}")
            out = stage(spark, docs, sf_dir)
            assert set(docs.columns) <= set(out.columns)
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if k == 0 and n == 1:  # of the two long texts and of the two equal ones, one each; the other has half its words in common
                assert sorted((r["doc_id"] or "", len(r["text"])) for r in docs.collect()) == sorted([("2", len(long)), ("3", len(fine)), ("", 2 * len(fine) + 1)])
        assert (docs.count() > 0) == (k == 0)
