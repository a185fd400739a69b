"""Ranked search against a score of every document for every item."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from corpusloom.llm import ranked_search
from tests.llm.test_operators import EDGE, edge, empty, lowered  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, limit=50):
    words = [(i, TERM.findall(lowered(t))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall(lowered(text)))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc_id, w in words:
            tf, m = Counter(w), 50 + (50 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        scores.sort()
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scores[:limit])]
    return out


def found(df):
    return [tuple(r) for r in df.collect()]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_edges(spark, edge, empty):  # noqa: F811
    items = [("a", "same text MIT license"), ("b", None), ("c", "  "), ("a", "ünï w5 w976"), ("d", "one"), ("e", "no such"), (None, "漢字 text")]
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id string, text string, rank string")
    rows = [(r[0], r[1]) for r in EDGE] + [(None, "one more text"), (None, "one more text")]
    more = edge.unionByName(spark.createDataFrame([(None, "one more text")] * 2, "doc_id bigint, text string"), allowMissingColumns=True)
    same(found(ranked_search.rank_documents(more, asked)), brute_ranks(rows, items))
    same(found(ranked_search.rank_documents(more, asked, limit=1)), brute_ranks(rows, items, 1))
    assert ranked_search.rank_documents(empty, asked).count() == 0
    assert ranked_search.rank_documents(edge, asked.limit(0)).count() == 0


def test_segments_windows_and_ties(monkeypatch):
    """Many small segments and windows, lists of all lengths, and equal documents: bounds never lose one."""
    rng = random.Random(4)
    monkeypatch.setattr(ranked_search, "WINDOW", 16)
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", 100)
    words = [f"t{k}" for k in range(60)]
    odds = [1 / (1 + k) ** 1.3 for k in range(60)]
    docs = [(i, " ".join(rng.choices(words, odds, k=rng.randrange(1, 60)))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(120)]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 14)))) for k in range(60)]
    counted = [TERM.findall(t) for _, t in docs]
    df = Counter(t for w in counted for t in set(w))
    weights = {t.encode(): math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * n + 1))) for t, n in df.items()}
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["id", "text"])
    index = list(ranked_search._segments(None, pa.int64())(iter([batch])))
    assert len(index) == 7
    asked = {k: sorted({t.encode() for t in text.split()}) for k, text in items}
    for limit in (1, 5, 50):
        out = ranked_search._searched(asked, weights, len(docs), sum(map(len, counted)), limit, pa.int64())(iter(index))
        got = [(r["item"], r["id"], r["score"]) for b in out for r in b.to_pylist()]
        same(got, [(item, i, s) for item, _, i, s in brute_ranks(docs, items, limit)])


def test_what_cannot_reach_the_bar_is_not_looked_up(monkeypatch):
    """The bar lets lists fall silent: fewer postings are added up than the item's lists hold."""
    monkeypatch.setattr(ranked_search, "WINDOW", 64)
    rare, common = np.arange(0, 40), np.arange(0, 4000)
    segment = ranked_search.Segment.__new__(ranked_search.Segment)
    segment.ids = np.arange(4000)
    segment.lists = {b"rare": (rare, np.full(40, 1000), 1000), b"common": (common, np.full(4000, 10), 10)}
    scores, ids = segment.search([b"rare", b"common"], (np.zeros(0, np.int64), segment.ids[:0]), 10)
    assert scores.tolist() == [1010] * 10 and ids.tolist() == list(range(10))
    full = (np.full(10, 2000), np.arange(10))
    assert segment.search([b"rare", b"common"], full, 10)[0].tolist() == [2000] * 10
