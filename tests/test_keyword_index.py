"""The stored keyword index: what it reads, what updates do to it, and that nothing is lost by reading less."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import keyword_index as K
from corpusloom.operators import retrieval as R

WORDS = [f"w{k}" for k in range(40)]
ODDS = [1 / (1 + k) for k in range(40)]


def corpus(seed, n, first=0):
    rng = random.Random(seed)
    return {first + i: " ".join(rng.choices(WORDS, ODDS, k=rng.randrange(1, 120))) for i in range(n)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id bigint, content string")


def flat(index, spark):
    return Counter((r["term"], r["chunk_id"], r["tf"]) for r in K.live_postings(index, spark).collect())


def brute(texts):
    return Counter((t, i, n) for i, text in texts.items() for t, n in Counter(text.split()).items())


@pytest.fixture(scope="module")
def texts():
    return corpus(1, 3000)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory, texts):
    made = K.KeywordIndex(str(tmp_path_factory.mktemp("index")), buckets=4)
    K.build(made, frame(spark, texts))
    return made


def found(spark, index, asked, limit, visible=lambda df: df):
    terms = spark.createDataFrame([(q, t) for q, words in asked.items() for t in words], "query_id int, term string")
    reads, told = K.search_plan(index, terms, visible, limit)
    pairs = {}
    for r in visible(K.candidates(index, reads)).collect():
        pairs.setdefault(r["query_id"], set()).add(r["chunk_id"])
    return pairs, {r["query_id"]: (r["postings"], r["read"]) for r in K.postings_read(told, reads).collect()}


def best(texts, words, limit, seen=lambda i: True):
    scores = {i: sum(t in words for t in text.split()) for i, text in texts.items() if seen(i)}
    return sorted((i for i, s in scores.items() if s), key=lambda i: (-scores[i], i))[:limit]


def test_what_leads_to_the_first_chunks_is_read(spark, index, texts):
    rng = random.Random(2)
    asked = {q: rng.sample(WORDS, rng.randrange(1, 6)) for q in range(30)} | {99: ["absent", "w0"], 98: ["absent"]}
    pairs, read = found(spark, index, asked, 10)
    for q, words in asked.items():
        assert set(best(texts, words, 10)) <= pairs.get(q, set()), q
    assert sum(r for _, r in read.values()) < 0.5 * sum(n for n, _ in read.values())
    # Where the query may see little, more is read, and still nothing lost.
    odd = lambda df: df.filter("chunk_id % 50 = 7")
    pairs, _ = found(spark, index, asked, 10, odd)
    for q, words in asked.items():
        assert set(best(texts, words, 10, lambda i: i % 50 == 7)) <= pairs.get(q, set())
    many, _ = found(spark, index, {1: ["w0"]}, 10_000)
    assert len(many[1]) == sum("w0" in t.split() for t in texts.values())


def test_postings_are_not_exchanged(spark, index):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    terms = spark.createDataFrame([("w1",), ("w39",)], "term string")
    ((_, rows),) = K._of_words(index, spark, terms)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "In(key" in plan and "hashpartitioning" not in plan  # buckets are picked by name
    try:  # many words: the join follows the buckets
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        K.BROADCAST_ROWS, kept = 0, K.BROADCAST_ROWS
        K.NAMED_KEYS, named = 0, K.NAMED_KEYS
        ((_, rows),) = K._of_words(index, spark, terms)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # that of the words
    finally:
        K.BROADCAST_ROWS, K.NAMED_KEYS = kept, named
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_updates_and_a_new_beginning(spark, tmp_path):
    texts = corpus(3, 300)
    index = K.KeywordIndex(str(tmp_path), buckets=4)
    K.build(index, frame(spark, texts))
    assert flat(index, spark) == brute(texts)
    for step in range(3):
        gone = [i for i in texts if i % 7 == step]
        fresh = corpus(10 + step, 40, 1000 * (step + 1)) | {i: f"again {step} w0 w0" for i in gone[:20]}
        K.update(index, spark.createDataFrame([(i,) for i in gone * 2], "chunk_id bigint"), frame(spark, fresh))
        texts = {i: t for i, t in texts.items() if i not in set(gone)} | fresh
        assert flat(index, spark) == brute(texts)
    assert [anew for *_, anew in index.generations(spark)] == [True, False, False, False]
    pairs, _ = found(spark, index, {1: ["w0", "again"], 2: ["w5"]}, 15)
    assert set(best(texts, ["w0", "again"], 15)) <= pairs[1] <= set(texts) and set(best(texts, ["w5"], 15)) <= pairs[2]
    index = K.KeywordIndex(str(tmp_path), buckets=3)  # other buckets from here on
    K.compacted(index, spark, len(texts))
    assert len(index.generations(spark)) == 1 and flat(index, spark) == brute(texts)
    # A generation that was not finished does not count, nor does one whose number was taken.
    frame(spark, {5: "never"}).write.parquet(f"{tmp_path}/generation=9-4-abc/rows")
    assert len(index.generations(spark)) == 1
    K.update(index, spark.createDataFrame([(0,)], "chunk_id bigint"), frame(spark, {}))
    assert flat(index, spark) == brute({i: t for i, t in texts.items() if i != 0})


def test_an_empty_index(spark, tmp_path):
    index = K.KeywordIndex(str(tmp_path), buckets=4)
    K.build(index, frame(spark, {}))
    assert not flat(index, spark)
    pairs, _ = found(spark, index, {1: ["w0"]}, 5)
    assert pairs == {}
    K.update(index, spark.createDataFrame([], "chunk_id bigint"), frame(spark, {1: "w0"}))
    assert found(spark, index, {1: ["w0"]}, 5)[0] == {1: {1}}


def test_candidates_are_those_of_a_whole_scan(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i // 3, i % 3, " ".join(rng.choices(WORDS, ODDS, k=40)), None, "acme", ["HR"] if i % 2 else ["User"], ["User"], "current", None, {}, {}, {}) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_index int, content string, embedding array<double>, tenant_id string, doc_acl array<string>, acl array<string>, freshness_status string, created_at date, columns map<string,string>, doc_metadata map<string,string>, metadata map<string,string>")
    queries = spark.createDataFrame([(q, " ".join(rng.sample(WORDS, 3)), ["HR"] if q % 2 else ["X"], "acme", "all", {}, None) for q in range(12)], "query_id int, query string, groups array<string>, tenant string, freshness string, filters map<string,string>, vector array<double>")
    index = K.KeywordIndex(str(tmp_path), buckets=4)
    K.build(index, chunks)
    pick = ["query_id", "chunk_id", "fts_rank", "rank"]
    told = [sorted(map(tuple, R.keyword_candidates(queries, chunks, 7, 2026, i, prune_above=n).select(*pick).collect())) for i, n in ((None, 0), (index, 0), (index, 10**9))]
    assert told[0] == told[1] == told[2] and len(told[0]) == 84
    assert R.keyword_candidates(queries.filter(F.lit(False)), chunks, 7, 2026, index).count() == 0


def test_many_searches_meet_blocks(spark, tmp_path, monkeypatch):
    """Blocks, the first of which set the others' bars, give what a whole scan gives, after updates too; no hit outside a block's best is a row."""
    for name, n in (("SHARE", 16), ("BLOCK_POSTINGS", 400), ("FIRST_BLOCKS", 2), ("BUCKET_SHARES", 4)):
        monkeypatch.setattr(K, name, n)
    monkeypatch.setattr(R, "MANY_HITS", -1)
    monkeypatch.setattr(R, "ASKED_OFTEN", 0)
    monkeypatch.setattr(R, "BROADCAST_IDS", 100)
    rng = random.Random(7)
    text = lambda: " ".join(rng.choices(WORDS, ODDS, k=40))
    row = lambda i, content: (i, i // 3, i % 3, content, None, "acme" if i % 5 else "x", ["HR"] if i % 2 else ["User"], ["User"], "current", None, {}, {}, {})
    kinds = "chunk_id long, document_id long, chunk_index int, content string, embedding array<double>, tenant_id string, doc_acl array<string>, acl array<string>, freshness_status string, created_at date, columns map<string,string>, doc_metadata map<string,string>, metadata map<string,string>"
    texts = {i: text() for i in range(400)}
    index = K.KeywordIndex(str(tmp_path), buckets=4)
    K.build(index, spark.createDataFrame([row(*x) for x in texts.items()], kinds))
    fresh = {i: text() for i in (*range(0, 400, 9), *range(500, 530))}
    K.update(index, spark.createDataFrame([(i,) for i in range(0, 400, 3)], "chunk_id bigint"), spark.createDataFrame([row(*x) for x in fresh.items()], kinds))
    now = spark.createDataFrame([row(*x) for x in ({i: t for i, t in texts.items() if i % 3} | fresh).items()], kinds)
    asked = [(q, " ".join(rng.sample(WORDS, 1 + q % 4)) if q % 9 else "w0 w1", ["HR"] if q % 2 else ["X"], "acme", "all", {}, None) for q in range(40)] + [(50, "absent", ["X"], "acme", "all", {}, None), (51, "w0", ["X"], None, "all", {}, None)]
    queries = spark.createDataFrame(asked, "query_id int, query string, groups array<string>, tenant string, freshness string, filters map<string,string>, vector array<double>")
    pick = ["query_id", "chunk_id", "fts_rank", "rank"]
    told = [sorted(map(tuple, R.keyword_candidates(queries, now, 7, 2026, i).select(*pick).collect())) for i in (None, index)]
    assert told[0] == told[1] and len(told[0]) > 250
    searches = spark.createDataFrame([(1, 1, ["w0", "w1"]), (2, 1, ["w0"])], "search bigint, class bigint, terms array<string>")
    rows = K.best_hits(index, searches, now.select(F.lit(1).cast("bigint").alias("class"), "chunk_id"), 7)
    assert rows.count() < 300 < K.n_hits(index, searches.select("search", F.explode("terms").alias("term")))[1]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_ties_in_many_blocks_are_found_once(spark, tmp_path, monkeypatch, kind):
    """Chunks of one score in many blocks: later blocks return only what comes before the best so far, by chunk_id too."""
    for name, n in (("SHARE", 8), ("BLOCK_POSTINGS", 20), ("FIRST_BLOCKS", 2)):
        monkeypatch.setattr(K, name, n)
    index = K.KeywordIndex(str(tmp_path), kind=kind, buckets=4)
    texts = spark.range(500).select(F.format_string("%04d", "id").cast(kind).alias("chunk_id"), F.when(F.col("id") % 100 == 99, "w w w").otherwise("w v").alias("content"))
    K.build(index, texts)
    searches = spark.createDataFrame([(1, 1, ["w"]), (2, 1, ["v", "w"]), (3, 2, ["w"])], "search bigint, class bigint, terms array<string>")
    odd = F.col("chunk_id").cast("int") % 2 == 1
    seen = texts.select(F.lit(1).cast("bigint").alias("class"), "chunk_id").unionByName(texts.filter(odd).select(F.lit(2).cast("bigint").alias("class"), "chunk_id"))
    got = {}
    for r in K.best_hits(index, searches, seen, 7).collect():
        got.setdefault(r["search"], []).append((-r["score"], int(r["chunk_id"])))
    threes = [(-3, i) for i in range(99, 500, 100)]
    assert [sorted(got[s])[:7] for s in (1, 2, 3)] == [threes + [(-1, 0), (-1, 1)], sorted(threes + [(-2, 0), (-2, 1)]), threes + [(-1, 1), (-1, 3)]]
    assert max(map(len, got.values())) <= 30  # of 64 blocks, most of which hold seven
