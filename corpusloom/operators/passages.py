"""Where a passage stands among a page's words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_form, strip

#: Characters by which a phrase and a page first meet: as many as one 64-bit number holds.
SEED = 8


def _grams(text: str) -> np.ndarray:
    """The SEED characters that begin at each place of an ASCII text, as one number each."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) < SEED:
        return np.empty(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, SEED)).view(np.uint64)[:, 0]


def first_places(text: str, phrases: Iterable[str]) -> dict[str, int]:
    """Where each phrase first stands in a text of ASCII characters; phrases that are empty or not there are left out.

    Text and phrases meet by equality of the phrases' first and last SEED characters. The rarer
    end names the places, which are compared whole. So a page is read once for all its passages.
    """
    asked = {p for p in phrases if p}
    ends = {p: _grams(p)[[0, -1]] for p in asked if len(p) >= SEED}
    out = {p: at for p in asked if len(p) < SEED and (at := text.find(p)) >= 0}
    if not ends:
        return out
    grams = _grams(text)
    at = np.flatnonzero(np.isin(grams, np.unique(np.concatenate(list(ends.values())))))
    at = at[np.argsort(grams[at], kind="stable")]  # a gram's places stay in order
    for phrase, pair in ends.items():
        (h0, t0), (h1, t1) = np.searchsorted(grams[at], pair, "left"), np.searchsorted(grams[at], pair, "right")
        places = at[h0:h1] if h1 - h0 <= t1 - t0 else at[t0:t1] - (len(phrase) - SEED)
        here = next((p for p in places.tolist() if p >= 0 and text.startswith(phrase, p)), None)
        if here is not None:
            out[phrase] = here
    return out


def _levels(chunks: pd.DataFrame, words: pd.DataFrame) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The level and the word ranges of each chunk of one page."""
    words = words.sort_values("word_index", kind="stable")
    text = "".join(words["w"])
    indexes, ends = words["word_index"].to_numpy(), words["w"].str.len().cumsum().to_numpy()
    asked: list[list[str]] = [[w] if w else [] for w in chunks["whole"]]
    found: list[tuple[str, list[tuple[int, int]]]] = [("none", [])] * len(asked)
    for level, column in (("whole", None), ("sentences", "sentences"), ("ten words", "ten"), ("five words", "five")):
        open_ = [i for i, (known, _) in enumerate(found) if known == "none"]
        if column:
            values = chunks[column].tolist()
            for i in open_:
                asked[i] = list(values[i]) if column == "sentences" else [values[i]] if values[i] else []
        places = first_places(text, {p for i in open_ for p in asked[i]})
        for i in open_:
            here = [(places[p], places[p] + len(p) - 1) for p in asked[i] if p in places]
            if here:
                first, last = (np.searchsorted(ends, np.array(side) + 1) for side in zip(*here, strict=True))
                found[i] = level, list(zip(indexes[first].tolist(), indexes[last].tolist(), strict=True))
    return iter(found)


def locate(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, document_id, page_number, level, ranges): whole text, else its sentences, else its first ten words, else its first five.

    A step is looked for only where the one before found nothing. Chunks of pages without
    words are left out. A page's words and its chunks meet once, so a long page is neither
    copied nor searched for each of its chunks.
    """
    on_page = ["document_id", "page_number"]
    text = strip(F.regexp_replace("content", r"(?U)\s+", " "))
    parts = F.filter(F.transform(F.split("text", "[.!?]"), strip), lambda s: F.length(s) > 10)
    rows = chunks.select("chunk_id", *on_page, text.alias("text")).select("*", F.split("text", " ").alias("tokens"))
    first = lambda n, least: F.when(F.size("tokens") >= least, normal_form(F.array_join(F.slice("tokens", 1, n), " ")))
    asked = rows.select("chunk_id", *on_page, normal_form(F.col("text")).alias("whole"), F.coalesce(F.transform(parts, normal_form), F.array().cast("array<string>")).alias("sentences"), first(10, 5).alias("ten"), first(5, 3).alias("five"))
    there = words.select(*on_page, F.col("word_index").cast("int").alias("word_index"), F.coalesce(normal_form(F.col("word")), F.lit("")).alias("w"))
    columns = ["chunk_id", *on_page, "level", "firsts", "lasts"]

    def run(page: pd.DataFrame, of_page: pd.DataFrame) -> pd.DataFrame:
        if page.empty or of_page.empty:
            return pd.DataFrame(columns=columns)
        found = [(level, [r[0] for r in ranges], [r[1] for r in ranges]) for level, ranges in _levels(page, of_page)]
        return page[["chunk_id", *on_page]].assign(**dict(zip(columns[3:], zip(*found, strict=True), strict=True)))

    kinds = [f"{c} {asked.schema[c].dataType.simpleString()}" for c in columns[:3]]
    met = asked.dropna(subset=on_page).groupBy(*on_page).cogroup(there.dropna(subset=on_page).groupBy(*on_page))
    out = met.applyInPandas(run, ", ".join([*kinds, "level string, firsts array<int>, lasts array<int>"]))
    return out.select(*columns[:4], F.transform(F.arrays_zip("firsts", "lasts"), lambda r: F.struct(r["firsts"].alias("first_word"), r["lasts"].alias("last_word"))).alias("ranges"))


def matched_words(located: DataFrame, words: DataFrame) -> DataFrame:
    """The words (with chunk_id) inside the ranges that ``locate`` gives, each once a chunk."""
    ranges = located.select("chunk_id", "document_id", "page_number", F.explode("ranges").alias("r"))
    at = ranges.select("chunk_id", "document_id", "page_number", F.explode(F.sequence("r.first_word", "r.last_word")).alias("word_index")).distinct()
    return at.join(words, ["document_id", "page_number", "word_index"])


def boxes(matched: DataFrame) -> DataFrame:
    """One box per line of matched words (chunk_id, block_no, line_no, x0, y0, x1, y1)."""
    return matched.groupBy("chunk_id", "block_no", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
