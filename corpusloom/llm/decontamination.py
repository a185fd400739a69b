"""Benchmark decontamination by a prefix-filtered set join.

Every window of ``window`` consecutive item words is a set of positioned word shingles. A
document holds the window only if it holds all of them, so the window's rarest shingle is
its necessary prefix. Documents are joined on that prefix alone; the positions then bound
where the window would start and end, and the words in between are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, bare, forget, lowered_words, packed, staged, unpacked

#: Tables of at most so many rows (a few numbers each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 300_000
#: A shingle's hash takes a twelfth of such a row, and ROW_BYTES is what texts of windows may take for one.
GRAMS_A_ROW, ROW_BYTES = 12, 300
#: Parts into which a shingle's hits are dealt where the join with the prefixes shuffles.
SALTS = 16
#: Joins like a shingle, so that the one pass over the corpus also gives a row for each document.
SENTINEL = -0x5EED5EED5EED5EED


def _hinted(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def _gram(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + i) for i in range(length)])


def _window_grams(length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda j: F.struct(j.alias("offset"), _gram(F.col("words"), j, length).alias("gram")))


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """(item, words): one row per window; an item of fewer words is one window, one without words has none."""
    words = items.select(bare(item_col).alias("item"), lowered_words(bare(text_col)).alias("w")).filter(F.size("w") > 0)
    return words.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).alias("words")).distinct()


def _document_grams(source: DataFrame, keys: list[str], lengths: list[int], sentinel: bool) -> DataFrame:
    """(keys, n_words, pos, len, gram): a row per word position and shingle length, without the words.

    With ``sentinel`` a row at position -1 stands for the document itself.
    """
    rows = source.select(*keys, "w", F.size("w").alias("n_words"))
    at = rows.select(*keys, "w", "n_words", F.explode(F.sequence(F.lit(-1 if sentinel else 0), F.greatest(F.col("n_words") - 1, F.lit(-1 if sentinel else 0)))).alias("pos"))
    if len(lengths) > 1:
        at = at.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("len"))
    else:
        at = at.withColumn("len", F.lit(lengths[0]))
    gram = F.coalesce(*[F.when(F.col("len") == n, _gram(F.col("w"), F.col("pos"), n)) for n in lengths])
    fits = (F.col("pos") >= 0) & (F.col("pos") + F.col("len") <= F.col("n_words"))
    here = F.when(fits, gram).when((F.col("pos") < 0) & (F.col("len") == lengths[0]), F.lit(SENTINEL))
    return at.select(*keys, "n_words", "pos", "len", here.alias("gram")).filter("gram is not null")


def _shingles(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(window, length, len, offset, gram): all shingles of the windows."""
    by_len = F.coalesce(*[F.when(F.col("len") == n, _window_grams(n)) for n in lengths])
    rows = windows.select("window", F.size("words").alias("length"), "len", "words").select("window", "length", "len", F.explode(by_len).alias("s"))
    return rows.select("window", "length", "len", "s.offset", "s.gram")


def window_hits(source: DataFrame, items: DataFrame, keys: list[str], item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, broadcast_rows: int = BROADCAST_ROWS, count_words: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """From (keys, text): (keys, n_words) of every text, and the exact occurrences (keys, start, length, items) of item windows.

    The corpus is read once for the shingles that items hold. Their rarity, the choice of
    prefixes and the bounds by position come from these hits. Texts with a candidate that
    is left are read again, and the words of the window are compared one by one. Beyond
    ``broadcast_rows`` rows the joins shuffle, salted, as a passage may stand in a third of
    all documents. Without ``count_words`` the first table is None.
    """
    windows = item_windows(items, item_col, item_text_col, window).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = staged(windows.select(F.monotonically_increasing_id().alias("window"), "words", "items", F.least(F.size("words"), F.lit(shingle)).alias("len")), "decontam-windows")
    listed = F.concat("words", F.col("items").cast("array<string>"))
    width = F.octet_length(F.array_join(listed, " ")) + 16 * F.size(listed)
    by_length = windows.groupBy("len").agg(F.sum(width).alias("bytes")).collect()  # ``shingle`` rows at most
    lengths = sorted(r["len"] for r in by_length) or [shingle]
    window_rows = sum(r["bytes"] for r in by_length) // ROW_BYTES
    shingles = _shingles(windows, lengths)
    grams = staged(shingles.select("gram").distinct(), "decontam-grams")
    words = source.select(*keys, lowered_words(F.col("text")).alias("w"))
    n_grams = grams.count()
    gram_rows = n_grams // GRAMS_A_ROW + 1
    if gram_rows <= broadcast_rows:
        sought = grams.unionByName(source.sparkSession.range(1).select(F.lit(SENTINEL).alias("gram"))) if count_words else grams
        hits = staged(_document_grams(words, keys, lengths, count_words).join(F.broadcast(sought), "gram"), "decontam-hits")
        texts = hits.filter("pos < 0").select(*keys, "n_words")
        texts.staged_path = hits.staged_path
    else:
        # Shingles are dealt to salts, and texts are counted apart: no key then stands for a share of the corpus.
        salted = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = _document_grams(words, keys, lengths, False).withColumn("salt", F.pmod(F.xxhash64(*keys, "pos"), F.lit(SALTS)).cast("int"))
        hits = staged(spread.join(salted, ["gram", "salt"]).drop("salt"), "decontam-hits")
        texts = words.select(*keys, F.size("w").alias("n_words"))

    # Shingles that no document holds rule their windows out; of the others a window's rarest is its prefix.
    counts = hits.filter("pos >= 0").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = shingles.join(_hinted(counts, gram_rows, broadcast_rows), "gram", "left")
    rarest = ranked.groupBy("window", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram", "len")).alias("p")).filter("p.n > 0")
    prefixes = staged(rarest.select("window", "length", "p.offset", "p.gram", F.col("p.len").alias("p_len")), "decontam-prefixes")
    held = hits.filter("pos >= 0")
    if prefixes.count() <= broadcast_rows:
        met = held.join(F.broadcast(prefixes), "gram")
    else:
        salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = held.withColumn("salt", F.pmod(F.xxhash64(*keys, "pos"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    start = F.col("pos") - F.col("offset")
    fits = (F.col("len") == F.col("p_len")) & (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    candidates = staged(met.filter(fits).select(*keys, "window", start.alias("start")).distinct(), "decontam-candidates")

    # One row of each text with its candidates; an occurrence needs all words of the window, in order.
    asked = candidates.groupBy(*keys).agg(F.collect_list(F.struct("start", "window")).alias("asked"))
    n_asked = candidates.select(*keys).distinct().count()
    again = source.join(_hinted(asked.select(*keys), n_asked, broadcast_rows), [source[k].eqNullSafe(asked[k]) for k in keys], "left_semi").dropDuplicates(keys)
    spots = candidates.join(_hinted(windows.select("window", "words", "items"), window_rows, broadcast_rows), "window")
    rows = again.select(*[F.col(k).alias(f"a_{k}") for k in keys], lowered_words(F.col("text")).alias("w"))
    same = F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words")
    found = spots.join(rows, [spots[k].eqNullSafe(rows[f"a_{k}"]) for k in keys]).filter(same)
    found = staged(found.select(*keys, "start", F.size("words").alias("length"), "items"), "decontam-found")
    forget(grams, prefixes, candidates, windows)
    if not count_words or gram_rows > broadcast_rows:
        forget(hits)  # else the texts' numbers of words are still read from them: ``forget(texts)``
    return texts if count_words else None, found


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(bare(text_col), F.lit(""))
    return docs.select(bare(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``contaminated``.

    A word inside any occurrence of a window counts once. Null texts have no words.
    Repeated rows come back as often as they came; columns of docs called like an output
    give way to it. Repeated items give one window with all their ids.
    """
    keys = ["id", "text_hash"]
    texts, hits = window_hits(_keyed(docs, id_col, text_col), items, keys, **options)
    per_doc = hits.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.flatten(F.collect_set("items")).alias("ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
    )["n"]
    per_doc = per_doc.select(F.col("id").alias("h_id"), F.col("text_hash").alias("h_hash"), covered.alias("hit"), F.array_sort(F.array_distinct(F.transform("ids", lambda x: x.cast("string")))).alias("ids"))
    known = texts.groupBy(*keys).agg(F.max("n_words").alias("n_words"))
    known = known.join(per_doc, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left").select(F.col("id").alias("k_id"), F.col("text_hash").alias("k_hash"), "n_words", "hit", "ids")
    known = staged(known, "decontam-known")
    forget(texts, hits)
    base = docs.select(packed(docs), bare(id_col).alias("id"), F.xxhash64(F.coalesce(bare(text_col), F.lit(""))).alias("text_hash"))
    joined = base.join(known, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash")), "left")
    found = F.coalesce(F.col("hit"), F.lit(0).cast("long"))
    return unpacked(joined, docs.columns, {"n_words": F.col("n_words").cast("long"), "n_hit": found, "items": F.coalesce("ids", F.array().cast("array<string>")), "contaminated": found > 0})


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; columns unchanged."""
    _, hits = window_hits(_keyed(docs, id_col, text_col), items, ["id", "text_hash"], count_words=False, **options)
    hit = staged(hits.select(F.col("id").alias("h_id"), F.col("text_hash").alias("h_hash")).distinct(), "decontam-hit")
    forget(hits)
    rows = docs.select(packed(docs), bare(id_col).alias("id"), F.xxhash64(F.coalesce(bare(text_col), F.lit(""))).alias("text_hash"))
    out = _hinted(hit, hit.count(), options.get("broadcast_rows", BROADCAST_ROWS))
    kept = rows.join(out, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left_anti")
    return kept.select(*[F.col(ROW)[c].alias(c) for c in docs.columns])
