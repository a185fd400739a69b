"""Text expressions; white space is Unicode white space, as Python's strip() has it."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores: the plain analyzer, no stems, no stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def dedup_key(text: Column) -> Column:
    """The first 120 characters with single spaces, then lower-cased."""
    return F.lower(F.substring(strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, 120))


def clean_page(text: Column) -> Column:
    """Lines stripped, blank ones dropped."""
    lines = F.transform(F.split(text, r"\R"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(strip(text), r"(?U)\s+"), 1, n), " ")


def comma_list(text: Column, default: str = "User") -> Column:
    """Trimmed non-blank parts; null gives the default alone."""
    return F.coalesce(F.filter(F.transform(F.split(text, ","), strip), lambda x: x != ""), F.array(F.lit(default)))


def _accents() -> tuple[str, str]:
    """Latin letters that canonically decompose into an ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.decomposition(chr(c))]
    kept = [(c, base.lower()) for c, base in pairs if base.isascii() and base.isalpha()]
    return "".join(c for c, _ in kept), "".join(base for _, base in kept)


ACCENTED, PLAIN = _accents()


def normal_form(text: Column) -> Column:
    """Lower case, accents off Latin letters, ASCII letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[^a-z0-9]", "")
