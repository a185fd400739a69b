"""Splitting pages into passages.

Windows, sentences and headings are SQL expressions. Recursive, structural, semantic and
annotated splits fold over one text: a page in mapInPandas, with numbers and sections by
windows afterwards, or all pages of a document as one row of a plain function where a page's
chunks depend on the pages before.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_words, not_blank, strip

#: Separators from coarse to fine, the pattern of a numbered heading (in SQL and in Python), that of a Markdown heading, and what an annotator puts between chunks.
SEPARATORS = ("\n\n", "\n", " ", "")
HEADING = r"(?mU)^\s*(\d+(?:\.\d+)*\.?\s+[^\W\d_].*?)\s*$"
HEADING_LINE = re.compile(r"^\s*(\d+(?:\.\d+)*\.?\s+[^\W\d_].*?)\s*$", re.MULTILINE)
MARKDOWN_HEADING = re.compile(r"(^(?:#|\s*##|\s*###|\s*####)\s+.*$)", re.MULTILINE)
BREAK_MARKER = "===CHUNK_BREAK==="
#: Pages each on their own, with the end of the page before put in front, or laid end to end.
ISOLATED, CARRIED, JOINED = "isolated", "carried", "joined"
Split = Callable[[str], list[str]]
#: Texts of a batch that are split together, and the characters from which fewer are; what Python holds of a batch's chunks is bounded by them.
TOGETHER, TOGETHER_CHARS = 256, 1_000_000


def window_array(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, content): windows of ``size`` every size - overlap characters, blank ones dropped; size <= 0 is the whole text."""
    if size <= 0:
        return F.filter(F.array(F.struct(F.lit(0).alias("start"), text.alias("content"))), lambda w: not_blank(w["content"]))
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("content")))
    return F.filter(windows, lambda w: not_blank(w["content"]))


def character_windows(pages: DataFrame, size: int, overlap: int, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """All other columns with chunk_index (gapless from 0), start and content; no shuffle."""
    rest = [c for c in pages.columns if c != text_col]
    return pages.select(*rest, F.posexplode(window_array(F.col(text_col), size, overlap)).alias("chunk_index", "w")).select(*rest, "chunk_index", "w.start", "w.content")


def sentences(text: Column) -> Column:
    """After . ! ? and white space; stripped, blanks dropped."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def token_windows(text: Column, size: int, overlap: int, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """Windows of tokens joined by spaces; without a tokenizer characters, four to a token."""
    if tokenizer is None:
        return F.transform(window_array(text, size * 4, overlap * 4), lambda w: w["content"])
    words, step = tokenizer(text), max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / step)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, size), " ")), not_blank)


def marked_parts(reply: Column, marker: str = BREAK_MARKER) -> Column:
    """An annotator's reply cut at the markers; without one the whole reply."""
    return F.filter(F.transform(F.split(reply, re.escape(marker)), strip), lambda p: p != "")


def headings(text: Column) -> Column:
    """Titles of numbered section headings, in order."""
    return F.regexp_extract_all(text, F.lit(HEADING), F.lit(1))


def heading_marks(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, pos, title) of numbered headings; ``pos`` is where the match begins, blank lines before it included."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, p, m.start(), m[1].strip()) for d, p, t in zip(batch["document_id"], batch["page_number"], batch["text"], strict=True) for m in HEADING_LINE.finditer(t or "")]
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "pos", "title"])

    return pages.select("document_id", "page_number", "text").mapInPandas(run, f"document_id {kinds['document_id']}, page_number int, pos int, title string")


def section_of_chunks(chunks: DataFrame, marks: DataFrame) -> DataFrame:
    """As-of join: chunks (document_id, pos, chunk_index) with the last heading (document_id, pos, title) at or before them."""
    keys = ["document_id", "pos"]
    both = marks.select(*keys, F.lit(0).alias("kind"), F.lit(None).cast("int").alias("chunk_index"), "title").unionByName(chunks.select(*keys, F.lit(1).alias("kind"), F.col("chunk_index").cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("title")))
    order = Window.partitionBy("document_id").orderBy("pos", "kind", "chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section_title", F.last("title", ignorenulls=True).over(order)).filter("kind = 1").select("document_id", "chunk_index", "pos", "section_title")


def with_summary(content: Column, summary: Column, label: str) -> Column:
    """``[label: summary]`` before the content; without a summary the first eight words and dots."""
    fallback = F.concat(first_words(content, 8), F.lit("..."))
    given = F.when(not_blank(summary), strip(summary))
    return F.concat(F.lit(f"[{label}: "), F.coalesce(given, fallback), F.lit("]\n\n"), content)


def shared_edge(previous: Column, content: Column, most: int = 300) -> Column:
    """The longest end of ``previous`` that begins ``content``, up to ``most`` characters."""
    edges = F.array(F.struct(F.right(previous, F.lit(most)).alias("tail"), F.left(content, F.lit(most)).alias("head")))

    def longest(e: Column) -> Column:
        # Only places that hold the head's first character are compared in full.
        letters = F.split(e["tail"], "")
        starts = F.filter(F.transform(letters, lambda c, i: F.when(c == F.left(e["head"], F.lit(1)), F.length(e["tail"]) - i)), lambda n: n.isNotNull() & (n > 0))
        fits = F.filter(starts, lambda n: F.startswith(e["head"], F.right(e["tail"], n)))
        return F.coalesce(F.left(e["head"], F.array_max(fits)), F.lit(""))

    return F.coalesce(F.get(F.transform(edges, longest), F.lit(0)), F.lit(""))


# ---- folds -------------------------------------------------------------------------------


def window_pieces(text: str, size: int, overlap: int) -> list[str]:
    """The windows of ``window_array`` as plain text."""
    if size <= 0:
        return [text]
    step = max(1, size - overlap)
    last = max(0, -(-(len(text) - size) // step))
    return [w for w in (text[k * step : k * step + size] for k in range(last + 1)) if w.strip()]


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Greedy packing at the coarsest separator that works, finer ones for what is too long.

    Whole trailing pieces that fit the overlap open the next chunk, which may so exceed the
    size. A remainder that the chunk before it contains is dropped.
    """
    glue, finer = separators[0], separators[1:]
    done: list[str] = []
    held: list[str] = []
    width = 0  # of what is held, with the glue between

    def emit() -> None:
        joined = glue.join(held)
        if joined.strip():
            done.append(joined)

    for piece in text.split(glue) if glue else list(text):
        if len(piece) > size:
            if held:
                emit()
                held, width = [], 0
            if finer:
                done += recursive_pieces(piece, size, overlap, finer)
            else:
                starts = range(0, max(1, len(piece) - overlap), max(1, size - overlap))
                done += [w for w in (piece[a : a + size] for a in starts) if w.strip()]
            continue
        if held and width + len(glue) + len(piece) > size:
            emit()
            kept, width = 0, 0
            while kept < len(held) and (wider := width + len(held[-1 - kept]) + (len(glue) if kept else 0)) <= overlap:
                kept, width = kept + 1, wider
            held = held[len(held) - kept :]
        width += len(piece) + (len(glue) if held else 0)
        held.append(piece)
    rest = glue.join(held)
    if rest.strip() and not (done and rest in done[-1]):
        done.append(rest)
    return done


def structural_pieces(text: str, most: int, size: int, overlap: int) -> list[str]:
    """A chunk begins at every Markdown heading, and where it would grow over ``most``; longer ones are split again."""
    grown = [""]
    for part in filter(str.strip, MARKDOWN_HEADING.split(text)):
        if part.strip().startswith("#") or len(grown[-1]) + len(part) > most:
            grown.append(part)
        else:
            grown[-1] += "\n" + part
    out: list[str] = []
    for chunk in filter(None, map(str.strip, grown)):
        out += recursive_pieces(chunk, size, overlap) if len(chunk) > most else [chunk]
    return out


def distance_limit(distances: list[float], kind: str, value: float) -> float:
    """Percentile by index, mean plus deviations, or the value itself."""
    if kind == "percentile":
        at = min(max(0, int(len(distances) * value / 100)), len(distances) - 1)
        return sorted(distances)[at]
    if kind == "standard_deviation":
        mean = sum(distances) / len(distances)
        return mean + value * math.sqrt(sum((d - mean) ** 2 for d in distances) / len(distances))
    return value


def packed_sentences(parts: list[str], distances: list[float] | None, limit: float, most: int) -> list[str]:
    """Sentences joined until a distance over the limit, or until the chunk would be longer than ``most``."""
    out: list[list[str]] = []
    length = 0
    for i, s in enumerate(parts):
        apart = bool(distances) and i > 0 and distances[i - 1] > limit
        if not out or apart or length + len(s) > most:
            out.append([s])
            length = len(s)
        else:
            out[-1].append(s)
            length += len(s) + 1
    return [" ".join(x) for x in out]


def neighbour_distances(groups: list[str], embed: Callable[[list[str]], list[list[float]]], batch: int) -> list[float | None]:
    """Cosine distance of each text from the next one. The embedder gets ``batch`` texts at once; None where it gave another number of vectors."""
    vectors: list = []
    for at in range(0, len(groups), batch):
        reply = list(embed(groups[at : at + batch]))
        there = min(batch, len(groups) - at)
        vectors += reply if len(reply) == there else [None] * there
    pairs = [i for i in range(len(groups) - 1) if vectors[i] is not None and vectors[i + 1] is not None]
    out: list[float | None] = [None] * max(0, len(groups) - 1)
    if pairs:
        a, b = (np.array([vectors[i + k] for i in pairs], float) for k in (0, 1))
        scale = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
        # A vector of zeros is no distance from any.
        near = np.divide((a * b).sum(1), scale, out=np.ones_like(scale), where=scale > 0)
        for i, d in zip(pairs, (1 - near).tolist(), strict=True):
            out[i] = d
    return out


class SemanticSplit:
    """Cut where neighbouring groups of ``buffer`` sentences are further apart than most; without an embedder, or where it fails, by length alone.

    ``many`` splits texts together, so that the embedder gets full batches however short they are.
    """

    def __init__(self, embed: Callable[[list[str]], list[list[float]]] | None, kind: str = "percentile", value: float = 95.0, buffer: int = 1, most: int = 3000, batch: int = 32):
        self.embed, self.kind, self.value, self.buffer, self.most, self.batch = embed, kind, value, buffer, most, batch

    def __call__(self, text: str) -> list[str]:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[list[str]]:
        listed = [[s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()] for t in texts]
        groups = [" ".join(parts[i : i + self.buffer]) for parts in listed for i in range(len(parts))]
        apart = neighbour_distances(groups, self.embed, self.batch) if self.embed else [None] * len(groups)
        out, at = [], 0
        for text, parts in zip(texts, listed, strict=True):
            own: list[float | None] = apart[at : at + max(0, len(parts) - 1)]
            at += len(parts)
            if not parts or (len(parts) == 1 and self.embed):
                out.append([text])
            elif None in own or not own:
                out.append(packed_sentences(parts, None, 0.0, self.most))
            else:
                out.append(packed_sentences(parts, own, distance_limit(own, self.kind, self.value), self.most))
        return out


def semantic_pieces(text: str, embed: Callable[[list[str]], list[list[float]]] | None, kind: str = "percentile", value: float = 95.0, buffer: int = 1, most: int = 3000) -> list[str]:
    """One text by ``SemanticSplit``."""
    return SemanticSplit(embed, kind, value, buffer, most)(text)


def annotated_pieces(text: str, annotate: Callable[[str], str | None] | None, block: int = 4000, size: int = 1500, overlap: int = 250) -> list[str]:
    """What an annotator makes of each ``block`` characters, cut at its markers; recursive pieces where it says nothing or fails."""
    if not text.strip():
        return []
    if annotate is None:
        return recursive_pieces(text, size, overlap)
    out: list[str] = []
    for at in range(0, len(text), block):
        part = text[at : at + block]
        try:
            reply = annotate(part) or ""
        except Exception:  # one failed call must not lose the document
            reply = ""
        found = [p.strip() for p in reply.split(BREAK_MARKER) if p.strip()]
        out += found or ([] if BREAK_MARKER in reply else recursive_pieces(part, size, overlap))
    return out or recursive_pieces(text, size, overlap)


def placed(parts: list[str], text: str) -> Iterator[tuple[str, int]]:
    """(content, start): parts without outer white space, blanks dropped, each at its first place from the end of the one before on; else at that end."""
    at = 0
    for content in filter(None, map(str.strip, parts)):
        found = text.find(content, at)
        if found < 0:
            yield content, at
        else:
            yield content, found
            at = found + len(content)


def placed_chunks(pages: list[tuple[int, str]], split: Split, mode: str, overlap: int) -> Iterator[tuple[int, int, str, str | None]]:
    """(page_number, start, content, section_title) of one document's (page_number, text) in order.

    A section is the last numbered heading at or before the start; it stays open until the
    next one. Joined pages end in a line break each, and a chunk belongs to the page that
    holds its start (1 if none does).
    """
    section, carry = None, ""
    if mode == JOINED:
        starts = list(accumulate((len(t) + 1 for _, t in pages), initial=0))
        whole = "".join(f"{t}\n" for _, t in pages)
        marks = [(begin + m.start(), m[1].strip()) for begin, (_, t) in zip(starts, pages, strict=False) for m in HEADING_LINE.finditer(t)]
        places = [p for p, _ in marks]
        for content, start in placed(split(whole), whole):
            if at := bisect_right(places, start):
                section = marks[at - 1][1]
            k = bisect_right(starts, start) - 1
            yield pages[k][0] if k < len(pages) else 1, start, content, section
        return
    for number, text in pages:
        if not text.strip():
            continue
        marks = [(m.start(), m[1].strip()) for m in HEADING_LINE.finditer(text)]
        places = [p for p, _ in marks]
        parts = split(f"{carry}\n{text}" if carry else text)
        if mode == CARRIED:
            carry = parts[-1][-overlap:] if parts and overlap > 0 else ""
        for content, start in placed(parts, text):
            if at := bisect_right(places, start):
                section = marks[at - 1][1]
            yield number, start, content, section


def few(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of TOGETHER texts at most, that hold TOGETHER_CHARS at most if they are several."""
    begin = held = 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin >= TOGETHER or held + n > TOGETHER_CHARS):
            yield begin, i
            begin, held = i, 0
        held += n
    if lengths:
        yield begin, len(lengths)


def _page_pieces(pages: DataFrame, split: Split, kind: str) -> DataFrame:
    """(document_id, page_number, page, k, start, content, own) of pages split each on its own: the k-th piece, and the last heading of the page at or before it."""
    columns = ["document_id", "page_number", "page", "k", "start", "content", "own"]
    together = getattr(split, "many", None)
    if together is None:  # page by page, a hundred of them in Python's memory at a time
        one = lambda text: [(k, start, content, section) for k, (_, start, content, section) in enumerate(placed_chunks([(1, text or "")], split, ISOLATED, 0))]
        cut = F.udf(one, "array<struct<k:int,start:int,content:string,own:string>>", useArrow=False)
        return pages.select(*columns[:3], F.explode(cut("text")).alias("c")).select(*columns[:3], "c.*")

    def pieces(some: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc, number, page, text, parts in zip(some["document_id"], some["page_number"], some["page"], some["text"], together(some["text"].tolist()), strict=True):
            rows += [(doc, number, page, k, start, content, section) for k, (_, start, content, section) in enumerate(placed_chunks([(number, text)], lambda _, p=parts: p, ISOLATED, 0))]
        return pd.DataFrame(rows, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[bool(t and t.strip()) for t in batch["text"]]]
            for a, b in few(batch["text"].str.len().tolist()):
                yield pieces(batch.iloc[a:b])

    return pages.mapInPandas(run, f"document_id {kind}, page_number int, page bigint, k int, start int, content string, own string")


def split_pages(pages: DataFrame, split: Split, mode: str = ISOLATED, overlap: int = 0) -> DataFrame:
    """(document_id, page_number, chunk_index, start, content, section_title) by any way of splitting a text.

    Blank pages are skipped, null ones are blank; chunk_index is gapless through the
    document. A split with a method ``many`` gets the isolated pages of a batch together. Isolated pages are split one by one wherever they are, and numbered by a
    running count; a section stays open over later pages. Where a page takes from the one
    before, or pages are laid end to end, a document's pages are one row.
    """
    if mode not in (ISOLATED, CARRIED, JOINED):
        raise ValueError(f"{mode!r} is no way to treat pages")
    kind = pages.schema["document_id"].dataType.simpleString()
    columns = ["document_id", "page_number", "chunk_index", "start", "content", "section_title"]
    asked = pages.select("document_id", F.col("page_number").cast("int").alias("page_number"), "text")
    if mode == ISOLATED:
        # Different pages of one number are told apart by their texts; equal ones have equal pieces.
        pieces = _page_pieces(asked.withColumn("page", F.xxhash64("text")), split, kind)
        order = Window.partitionBy("document_id").orderBy("page_number", "page", "k")
        numbered = pieces.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("section_title", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.select(columns)

    # Rows of a plain function come to Python a hundred at a time, and no group costs a frame of its own.
    def run(listed: list) -> list[tuple]:
        pages = sorted((int(p), t or "") for p, t in listed)
        return [(p, i, a, c, s) for i, (p, a, c, s) in enumerate(placed_chunks(pages, split, mode, overlap))]

    chunked = F.udf(run, "array<struct<page_number:int,chunk_index:int,start:int,content:string,section_title:string>>", useArrow=False)
    listed = asked.groupBy("document_id").agg(F.collect_list(F.struct("page_number", "text")).alias("pages"))
    return listed.select("document_id", F.explode(chunked("pages")).alias("c")).select("document_id", "c.*")


def previews(pages: DataFrame, settings: dict[str, tuple[Split, str, int]]) -> DataFrame:
    """The chunks of several settings (split, mode, overlap) side by side, with ``setting``; nothing is written."""
    out = None
    for name, (split, mode, overlap) in settings.items():
        part = split_pages(pages, split, mode, overlap).withColumn("setting", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def preview_sizes(chunks: DataFrame) -> DataFrame:
    """(setting, document_id, n_chunks, characters, longest): what two settings make of a document, to compare them by."""
    n = F.length("content")
    return chunks.groupBy("setting", "document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(n).cast("bigint").alias("characters"), F.max(n).cast("bigint").alias("longest"))
