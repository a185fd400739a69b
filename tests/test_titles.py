"""Titles after relation phrases: any length, any punctuation, the longest one at a place."""

import random
import re

from corpusloom.operators import tagging as G


def words(text):
    return [w for w in re.split(r"[^\w-]+", text.lower()) if re.search(r"[^\W_]", w)]


def related(spark, sentences, titles, columns="document_id int, title string, date_order int"):
    said = spark.createDataFrame(sentences, "document_id int, sentence string")
    out = G.relations_by_rule(said, spark.createDataFrame(titles, columns))
    return sorted(tuple(r) for r in out.collect())


def test_titles_with_punctuation_and_of_any_length(spark):
    titles = [(1, "Rules for travel and expenses", 1), (2, "Travel, expenses", 2), (3, "Order 5/2020", 3), (4, "A – very: long (title) of, in all; twelve words \"for\" the record, 2021", 4), (5, "Travel", 5), (6, "...", 6), (7, "Příkaz č. 7", 7), (8, None, 8), (99, "Later", 200), (50, "New", 100)]
    said = {
        "This replaces Rules for travel and expenses.": {1}, "This replaces Travel, expenses.": {2}, "This replaces Order 5/2020 fully.": {3}, "It replaces order 5 2020": {3},
        "This replaces a very long title of in all twelve words for the record 2021!": {4}, "Travel replaces nothing": set(), "This replaces travel; it replaces the later one, Later.": {5},
        "Toto nahrazuje Příkaz č. 7 a Travel.": {5, 7}, "This replaces Rules for travel and expenses and travel": {1, 5}, "This replaces ...": set(), "This replaces travels": set(), "It replaces Travel-expenses": set(),
    }
    for sentence, want in said.items():
        assert {t for _, _, t in related(spark, [(50, sentence)], titles)} == want, sentence


def test_tenants_and_empty_tables(spark):
    columns = "document_id int, title string, date_order int, tenant_id string"
    titles = [(1, "Travel rules", 1, "a"), (2, "Travel", 2, "b"), (3, "x", 9, "b"), (4, "y", 9, None), (5, "Travel", 3, None)]
    assert related(spark, [(3, "This replaces Travel rules."), (4, "It amends Travel.")], titles, columns) == [(3, "replaces", 2), (4, "modifies", 5)]
    assert related(spark, [], titles, columns) == [] and related(spark, [(3, "This replaces Travel.")], [], columns) == []


def test_against_every_title_in_every_sentence(spark):
    rng = random.Random(8)
    vocabulary = "rules travel order 5/2020 (annex) of, the b-c".split()
    titles = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 13))), i) for i in range(150)]
    sentences = [(1000 + i, " ".join([*rng.choices(vocabulary, k=2), rng.choice(("replaces", "amends")), *rng.choices(vocabulary, k=rng.randrange(20))])) for i in range(80)]
    sentences += [(1000 + i, f"It modifies: {titles[i][1]}; and so on") for i in range(60)]
    want = set()
    for doc, sentence in sentences:
        kind, rest = re.search(r"(?s)\b(replaces|modifies|amends)\b(.*)$", sentence).groups()
        rest = words(rest)
        spans = [(i, i + len(words(t)), d) for d, t, _ in titles for i in range(len(rest) - len(words(t)) + 1) if words(t) and rest[i : i + len(words(t))] == words(t)]
        for a, b, d in spans:
            if not any(x <= a and y >= b and y - x > b - a for x, y, _ in spans):
                want.add((doc, "replaces" if kind == "replaces" else "modifies", d))
    got = related(spark, sentences, [*titles, *{(d, "none such", d) for d, _ in sentences}])
    assert got == sorted(want) and len(want) > 60
