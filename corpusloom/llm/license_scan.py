"""Fuzzy search for short license notices.

A notice may differ from its text by a bounded number of edits. Cut into one piece more
than the bound allows edits, one piece at least stands unchanged (pigeonhole): the pieces
are exact seeds. Around each seed the regex library matches the whole notice with bounded
errors, which verifies the edits and gives the span.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, packed, unpacked

#: (label, phrase): the base rules, found word by word.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: (label, words of the notice, edits allowed): about one edit for 10 characters.
NOTICES = (
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "licensed under the gnu general public license", 4),
    ("gpl", "under the terms of the gnu general public license", 4),
    ("lgpl", "gnu lesser general public license", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 9),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("cc-by", "creative commons attribution", 2),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 7),
)
#: One byte for one: A-Z to a-z, and what is not part of a word to a space.
_TO_WORDS = bytes(ord(" ") if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int

    def seeds(self) -> list[tuple[int, bytes]]:
        """(offset, piece) of edits + 1 pieces of about the same length."""
        n = self.edits + 1
        ends = [len(self.text) * k // n for k in range(n + 1)]
        return [(a, self.text[a:b].encode()) for a, b in zip(ends, ends[1:], strict=False)]

    def pattern(self):
        return regex.compile(f"(?e)(?<![^ ])(?:{regex.escape(self.text, literal_spaces=True)}){{e<={self.edits}}}(?![^ ])")


def words_of(text: str | None) -> bytes:
    """The lower-cased words, joined by single spaces; bytes of non-ASCII characters belong to words."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_TO_WORDS).split())


def phrase_starts(spaced: bytes, phrase: bytes) -> list[int]:
    """Word index of every place of a phrase in b" words "."""
    needle, found, at, word, last = b" " + phrase + b" ", [], spaced.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += spaced.count(b" ", last, at)
        last = at
        found.append(word)
        at = spaced.find(needle, at + 1)
    return found


def _find_all(spaced: bytes, piece: bytes) -> list[int]:
    found, at = [], spaced.find(piece)
    while at >= 0:
        found.append(at)
        at = spaced.find(piece, at + 1)
    return found


def fuzzy_spans(spaced: bytes, notices: list[tuple[Notice, list, object]]) -> list[tuple[str, int, int, int, int]]:
    """(label, first word, words, edits, length of the notice) of every notice found; overlapping finds of one notice are one.

    Windows are cut in bytes and edits counted in characters, which have up to four bytes.
    """
    spans = []
    for notice, seeds, pattern in notices:
        size, slack = len(notice.text), 4 * notice.edits
        windows = sorted({(max(0, at - offset - slack - 1), at - offset + size + slack + 1) for offset, piece in seeds for at in _find_all(spaced, piece)})
        merged: list[list[int]] = []
        for a, b in windows:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            # A window reaches from one space to another, so that it starts no word in its middle.
            a, b = spaced.rfind(b" ", 0, a + 1), spaced.find(b" ", b)
            a, b = max(a, 0), len(spaced) if b < 0 else b + 1
            part = spaced[a:b].decode("utf-8", "replace")
            for m in pattern.finditer(part):
                lead = len(part[: m.start()].encode())
                got = m.group().strip(" ")
                lead += len(m.group()) - len(m.group().lstrip(" "))
                first = spaced.count(b" ", 0, a + lead + 1) - 1
                spans.append((notice.label, first, got.count(" ") + 1, sum(m.fuzzy_counts), size))
    return spans


def scan_texts(text: Column, phrases=PHRASES, notices=NOTICES) -> Column:
    """Struct of n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists (label, first_word, n_words, edits) of the fuzzy finds. ``score`` is 1
    where a base phrase stands, else 1 less the share of edits of the best find, else 0.
    """
    made = [Notice(*n) for n in notices]
    pieces = [(n, n.seeds()) for n in made]
    bases = [(label, phrase.encode()) for label, phrase in phrases]

    @F.pandas_udf("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,n_words:bigint,edits:int>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        compiled = [(n, seeds, n.pattern()) for n, seeds in pieces]
        rows = []
        for value in texts:
            words = words_of(value)
            spaced = b" " + words + b" "
            starts, base = [], set()
            for label, phrase in bases:
                if at := phrase_starts(spaced, phrase):
                    base.add(label)
                    starts += at
            spans = fuzzy_spans(spaced, compiled) if words else []
            best = max((1 - edits / size for *_, edits, size in spans), default=0.0)
            labels = base | {s[0] for s in spans}
            rows.append((words.count(b" ") + 1 if words else 0, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max(0.0, best), sorted((s[:4] for s in spans), key=lambda s: (s[1], s[0]))))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan(text)


def scan_licenses(docs: DataFrame, text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """All columns of ``docs`` with what scan_texts gives.

    Null and empty texts have no words, no labels and score 0; first_word and last_word are
    null without a base phrase. Columns of docs called like an output give way to it.
    """
    found = docs.select(packed(docs), scan_texts(bare(text_col), phrases, notices).alias("f"))
    return unpacked(found, docs.columns, {c: F.col(f"f.{c}") for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")})
