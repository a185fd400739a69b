"""Quality rules: counts per text, and lines that too many documents of a host share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, bare, forget, packed, staged, unpacked

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate where more documents of its host hold it than this number and this share of the host.
MIN_DOCS, MAX_SHARE = 20, 0.05
#: A document is depleted when boilerplate leaves it fewer words than this, or a smaller share of its words.
MIN_WORDS, MIN_LEFT = 50, 0.2


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) < 2_000_000 or window < 3:
        key = ids[:n]
        for i in range(1, window):
            key = key * len(seen) + ids[i : n + i]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.stack([ids[i : n + i] for i in range(window)], 1), axis=0, return_inverse=True, return_counts=True)
    again = counts[inverse.reshape(-1)] > 1
    inside = np.zeros(len(words), bool)
    for i in range(window):
        inside[i : n + i] |= again
    return int(inside.sum())


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_hashes, line_words.

    The last two have an entry for each line with a word; its hash is of the line in lower
    case with single spaces.
    """

    @F.pandas_udf("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_hashes array<bigint>, line_words array<int>")
    def counts(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            raw = text.encode("utf-8", "replace")
            words = raw.split()
            seen, repeats, hashes, lengths = set(), 0, [], []
            for line in raw.split(b"\n"):
                inside = line.split()
                if inside:
                    repeats += line in seen
                    seen.add(line)
                    hashes.append(xxhash.xxh64_intdigest(b" ".join(inside).lower()) - (1 << 63))
                    lengths.append(len(inside))
            rows.append((len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeats, repeated_words(words), hashes, lengths))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words"])

    return counts(text)


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes (as in text_counts) are in ``gone``; its other lines stay as they are."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, gones: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, gones, strict=True):
            if text is None or gone is None:
                out.append(None)
                continue
            taken, left = set(gone.tolist()), []
            for line in text.split("\n"):
                inside = line.encode("utf-8", "replace").split()
                if not inside or xxhash.xxh64_intdigest(b" ".join(inside).lower()) - (1 << 63) not in taken:
                    left.append(line)
            out.append("\n".join(left))
        return pd.Series(out, dtype=object)

    # Texts that keep all their lines don't go through Python again.
    return F.when(gone.isNull(), text).otherwise(cleaned(F.when(gone.isNotNull(), text), gone))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, n_docs) above the limits, from (host, id, line_hashes): a document counts once for a line, however often it has it.

    Rows of one host and id are one document, and so are those of a host with a null id.
    """
    hosts = lines.select("host", "id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    held = lines.select("host", "id", F.explode(F.array_distinct("line_hashes")).alias("line")).distinct()
    counted = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs)
    joined = counted.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return joined.filter(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line", "n_docs")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The packed rows with COUNTS, n_left, gone (hashes of the lines to take out, or null), base_failed and kept."""
    text = F.coalesce(bare(text_col), F.lit(""))
    # 128 bits tell texts apart: of 10^10 texts two would share 64 bits.
    copy = F.struct(*[F.xxhash64(F.lit(k), text).alias(name) for k, name in ((1, "one"), (2, "two"))]).alias("copy")
    # The rows themselves stay where they are; what the rules need of a text is written once.
    marked = staged(docs.select(bare(host_col).alias("host"), bare(id_col).alias("id"), copy, text_counts(text).alias("c")).select("host", "id", "copy", "c.*"), "quality-marked")
    common = staged(frequent_lines(marked, min_docs, max_share), "quality-common")
    small = common.count() <= 200_000
    common = common.select(F.col("host").alias("c_host"), F.col("line").alias("c_line"))
    texts = marked.select("host", "copy", *COUNTS, "line_hashes", "line_words").dropDuplicates(["host", "copy"])
    texts = staged(texts, "quality-texts")
    per_line = texts.select("host", "copy", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l")).select("host", "copy", F.col("l.line_hashes").alias("line"), F.col("l.line_words").alias("words"))
    hit = per_line.join(F.broadcast(common) if small else common, per_line["host"].eqNullSafe(F.col("c_host")) & (F.col("line") == F.col("c_line")))
    removed = hit.groupBy("host", "copy").agg(F.sum("words").alias("removed"), F.collect_set("line").alias("gone")).select(F.col("host").alias("r_host"), F.col("copy").alias("r_copy"), "removed", "gone")
    verdicts = texts.drop("line_hashes", "line_words").join(removed, F.col("host").eqNullSafe(F.col("r_host")) & (F.col("copy") == F.col("r_copy")), "left").withColumn("n_left", F.col("n_words") - F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("removed").isNotNull() & ((F.col("n_left") < min_words) | (F.col("n_left") < min_left * F.col("n_words")))
    verdicts = staged(verdicts.select(F.col("host").alias("v_host"), F.col("copy").alias("v_copy"), *COUNTS, "n_left", "gone", failed.alias("base_failed"), (~failed & ~depleted).alias("kept")), "quality-verdicts")
    forget(marked, texts, common)
    # Equal texts of a host meet one verdict; where they are very many, AQE deals them out anew.
    rows = docs.select(packed(docs), bare(host_col).alias("host"), copy)
    return rows.join(verdicts, rows["host"].eqNullSafe(F.col("v_host")) & (rows["copy"] == F.col("v_copy"))).drop("host", "copy", "v_host", "v_copy")


def quality(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """All columns of ``docs`` with the counts, ``n_left`` words after boilerplate lines, ``clean_text``, ``base_failed`` and ``kept``.

    ``clean_text`` is the text without its boilerplate lines; a null text stays null.

    ``base_failed``: fewer than min_words words, or more than half of the words in repeated
    3-word windows. ``kept`` is false if so, or if boilerplate lines depleted the document.
    A null text has no words; a null host is a host of its own. Repeated rows get equal verdicts.
    """
    judged = _judged(docs, host_col, text_col, id_col, **options)
    clean = {"clean_text": without_lines(F.col(ROW)[text_col], F.col("gone"))}
    return unpacked(judged, docs.columns, {c: F.col(c) for c in (*COUNTS, "n_left")} | clean | {c: F.col(c) for c in ("base_failed", "kept")})


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` that pass, their texts without boilerplate lines; columns unchanged, but n_chars counts what is left of a text that lost lines."""
    judged = _judged(docs, host_col, text_col, id_col, **options).filter("kept")
    clean = without_lines(F.col(ROW)[text_col], F.col("gone"))

    def kept(name: str) -> Column:
        if name == text_col:
            return F.col("_cl_clean")
        if name == "n_chars":
            return F.when(F.col("gone").isNull(), F.col(ROW)[name]).otherwise(F.char_length("_cl_clean").cast(docs.schema[name].dataType))
        return F.col(ROW)[name]

    return judged.select("*", clean.alias("_cl_clean")).select(*[kept(c).alias(c) for c in docs.columns])
