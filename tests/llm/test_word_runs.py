"""Periodic runs against a search of every period over every text."""

import hashlib
import random
import zlib

from corpusloom.llm import queries, word_runs
from tests.llm.test_operators import LONG, SCHEMA, SPACED, edge, empty  # noqa: F401


def brute_runs(words, least=12):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            a = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - a + q >= max(least, 2 * q):
                out.setdefault((a - q, i - a + q), q)
            i += i == a
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(2500):
        words = rng.choices("abcdef"[: rng.randrange(1, 7)], k=rng.randrange(120))
        for _ in range(rng.randrange(4) if words else 0):
            a, p = rng.randrange(len(words)), rng.randrange(1, 40)
            b, block = rng.randrange(a, len(words) + 1), words[a : a + p]
            words[a:b] = [block[j % len(block)] for j in range(b - a)]
        least = rng.choice((12, 12, 12, 5, 7, 20))
        assert word_runs.runs_of(words, least) == brute_runs(words, least)


def test_one_word_throughout_is_one_run():
    assert word_runs.runs_of(["a"] * 50_000) == [(0, 50_000, 1)]
    assert word_runs.runs_of([f"w{i % 10}" for i in range(50_005)]) == [(0, 50_005, 10)]
    assert word_runs.collapsed_words(["a"] * 50_000, [(0, 50_000, 1)]) == ["a"]


def test_edge_rows(spark, edge, empty):  # noqa: F811
    clashing = edge.withColumn("runs", edge["text"])
    rows = word_runs.periodic_runs(clashing).collect()
    assert len(rows) == clashing.count()
    for r in rows:
        words = SPACED.findall(r["text"] or "")
        runs = [tuple(x) for x in r["runs"]]
        assert r["n_words"] == len(words)
        if r["text"] == LONG:
            assert runs == [(0, 30_000, 977)] and r["collapsed"].split() == words[:977]
        else:
            assert runs == brute_runs(words) and r["collapsed"] == " ".join(words)
    assert word_runs.periodic_runs(empty).count() == 0
    assert set(word_runs.periodic_runs(clashing).columns) == {*clashing.columns, "runs", "collapsed"}


def test_query_on_a_small_table(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(60)))) for i in range(150)] + [(None, "a " * 20), (5000, None), (5001, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = SPACED.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
        assert tuple(got[doc_id][c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want
