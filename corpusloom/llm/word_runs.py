"""Periodic runs of words by an online sparse dynamic programme over diagonals.

A run of period q is a diagonal: words i and i - q are the same for as many i in a row as the
run is longer than q. Going through a text, every earlier occurrence of what is read lengthens
the match of its lag by one; a lag that finds no match ends, and its run is reported there and
then. A run has ``max(q, least - q)`` matches at least, so an occurrence is one of as many
words in a row (``least / 2`` words for lags below ``least``, then twice as many for lags up to
twice as long, and so on): frequent words alone start no diagonal. Within a stretch of period
p a multiple of p is no smallest period, so those lags are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, bare, packed, unpacked

_WORD = re.compile(SPACED_WORD)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _paired(names: np.ndarray, apart: int) -> np.ndarray:
    """Names of the pairs (i, i + apart); -1 for a pair that occurs once, or part of which does."""
    out = np.full(max(0, len(names) - apart), -1, np.int64)
    there = np.flatnonzero((names[: len(out)] >= 0) & (names[apart:] >= 0))
    if len(there):
        pairs = names[there] * (names.max() + 1) + names[there + apart]
        _, name, n = np.unique(pairs, return_inverse=True, return_counts=True)
        again = n[name] > 1
        out[there[again]] = name[again]
    return out


def _of_length(words: np.ndarray, length: int) -> np.ndarray:
    """Names of ``length`` words from each place on; -1 where they occur once."""
    names, have = words, 1
    while have < length:
        step = min(have, length - have)
        names, have = _paired(names, step), have + step
    return names


def _earlier(names: np.ndarray, length: int, first: int) -> Iterator[tuple[int, list[int]]]:
    """(place, lags) in order of places: lags from ``first`` to below twice ``length`` at which the same ``length`` words stand."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    if not len(at):
        return
    opens = np.r_[True, names[at[1:]] != names[at[:-1]]]
    # Occurrences at most half their length apart belong to one stretch of that period.
    apart = opens if first < length else opens | np.r_[True, np.diff(at) > length // 2]
    stretch = np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))
    before = np.where(opens[stretch], -1, stretch - 1) if first >= length else np.where(opens, -1, np.arange(len(at)) - 1)
    begins = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
    near = np.flatnonzero((before >= 0) & (at - at[before] < 2 * length))
    near = near[np.argsort(at[near], kind="stable")]
    for i, k, end in zip(at[near].tolist(), before[near].tolist(), begins[near].tolist(), strict=True):
        lags = []
        while k >= end and (lag := i - int(at[k])) < 2 * length:
            if lag >= first:
                lags.append(lag)
            k -= 1
        if lags:
            yield i, lags


def runs_of(words: list[str], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and two periods, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    length = -(-least // 2)
    if len(ids) < least or len(known) == len(ids):
        return []
    names, first = _of_length(ids, length), 1
    while len(names) and names.max() >= 0:

        def end(lag: int, matches: int, last: int, length: int = length) -> None:
            words_in = matches + length - 1 + lag
            if words_in >= max(least, 2 * lag):
                key = (last - matches + 1 - lag, words_in)
                found[key] = min(lag, found.get(key, lag))

        active: dict[int, int] = {}
        last = -1
        for i, lags in _earlier(names, length, first):
            if i != last + 1:
                for lag, m in active.items():
                    end(lag, m, last)
                active = {}
            now = {lag: active.pop(lag, 0) + 1 for lag in lags}
            for lag, m in active.items():
                end(lag, m, last)
            active, last = now, i
        for lag, m in active.items():
            end(lag, m, last)
        names, first, length = _paired(names, length), 2 * length, 2 * length
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(change).tolist(), strict=False) if not inside]


def text_runs(text: Column, least: int = 12) -> Column:
    """Struct of n_words, runs and collapsed; words stand between white space."""

    @F.pandas_udf(f"n_words bigint, runs {RUNS}, collapsed string")
    def runs(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            words = _WORD.findall(value or "")
            found = runs_of(words, least)
            rows.append((len(words), found, " ".join(collapsed_words(words, found))))
        return pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return runs(text)


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``runs`` and ``collapsed``, the text's words without repeated periods.

    ``runs`` are the stretches of at least ``least`` words and two smallest periods that no
    neighbouring word extends, by start, then period. Null and empty texts have no words and
    no runs, and collapse to an empty text. Every row is looked at by itself, so repeated
    rows come back as often as they came. Columns of docs called like an output give way to it.
    """
    found = docs.select(packed(docs), text_runs(bare(text_col), least).alias("f"))
    return unpacked(found, docs.columns, {c: F.col(f"f.{c}") for c in ("n_words", "runs", "collapsed")})
