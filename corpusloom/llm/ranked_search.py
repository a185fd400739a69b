"""Ranked lexical search: short lists term at a time, long lists document at a time.

The corpus is read once into index segments, each a row that one task wrote: its documents and
the postings of the items' words. A query then goes through every segment by itself. Its short
lists are summed up term at a time into accumulators, and these count as one more iterator
with a bound. Iterators that together cannot reach the worst of the first documents so far only
answer for documents that others propose; windows of documents whose bounds stay below it are
passed over; and a document is looked up in no further list once what is left cannot carry it
that far. Each task keeps the first documents of each item over all its segments; a window by
item puts the tasks' lists together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bare, forget, lowered_words, staged

#: A segment is closed at so many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 16_384, 500_000
#: So many words of items at most are in tasks' hands at once: a vocabulary above is not used to thin the index, and items above are searched for in batches.
TASK_TERMS = 200_000
#: A list is short up to this share of a segment's documents.
SHORT = 1 / 16
#: Documents that are judged at once.
WINDOW = 2048
#: Parts into which an item's found documents are dealt before they meet.
SALTS = 32
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _segments(vocabulary: frozenset[bytes] | None, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(id_type)), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def write(ids: list, lengths: list[int], lists: dict[bytes, tuple[list[int], list[int]]]) -> pa.RecordBatch:
        places = [p for some, _ in lists.values() for p in some]
        tfs = [n for _, some in lists.values() for n in some]
        row = [len(ids), sum(lengths), ids, lengths, list(lists), [len(some) for some, _ in lists.values()], places, tfs]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, lists, held = [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                # Lower case of bytes is that of A-Z alone.
                found = _WORD.findall((text.as_py() or b"").lower())
                if not found:
                    continue
                counts = Counter(found)
                for term in counts if vocabulary is None else vocabulary.intersection(counts):
                    some = lists.get(term) or lists.setdefault(term, ([], []))
                    some[0].append(len(ids))
                    some[1].append(counts[term])
                    held += 1
                ids.append(doc_id.as_py())
                lengths.append(len(found))
                if len(ids) >= SEGMENT_DOCS or held >= SEGMENT_POSTINGS:
                    yield write(ids, lengths, lists)
                    ids, lengths, lists, held = [], [], {}, 0
        if ids:
            yield write(ids, lengths, lists)

    return run


def index_segments(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every segment: its documents with a term, their lengths, and the postings of the vocabulary (None: of all terms)."""
    rows = docs.select(bare(id_col).alias("id"), bare(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(_segments(vocabulary, to_arrow_type(kind)), f"n_docs bigint, n_terms bigint, doc_ids array<{kind.simpleString()}>, lengths array<bigint>, terms array<binary>, dfs array<int>, places array<int>, tfs array<int>")


def first_of(scores: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Places of the ``limit`` highest scores; equal scores by id, nulls last."""
    if len(scores) > limit:
        there = np.flatnonzero(scores >= -np.partition(-scores, limit - 1)[limit - 1])
    else:
        there = np.arange(len(scores))
    if ids.dtype == object:
        order = sorted(range(len(there)), key=lambda k: (-scores[there[k]], ids[there[k]] is None, ids[there[k]]))
    else:
        order = np.lexsort((ids[there], -scores[there]))
    return there[order[:limit]]


class Segment:
    """The lists of one segment with every posting's part of a score, shared by all items."""

    def __init__(self, row: dict, weights: dict[bytes, int], n_docs: int, n_terms: int) -> None:
        held = row["doc_ids"].values
        self.ids = held.to_numpy(zero_copy_only=False) if pa.types.is_integer(held.type) and not held.null_count else np.array([*held.to_pylist(), None], object)[:-1]
        m = 50 + (50 * row["lengths"].values.to_numpy() * n_docs) // n_terms
        ends = np.cumsum(row["dfs"].values.to_numpy())
        places, tfs = row["places"].values.to_numpy(), row["tfs"].values.to_numpy().astype(np.int64)
        self.lists: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}
        for k, term in enumerate(row["terms"].values.to_pylist()):
            if w := weights.get(term, 0):
                at = slice(ends[k - 1] if k else 0, ends[k])
                part = w * ((1_000_000_000 * tfs[at]) // (1000 * tfs[at] + 20 * m[places[at]]))
                self.lists[term] = (places[at], part, int(part.max()))

    def accumulated(self, lists: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, int]:
        """Short lists summed up term at a time, as one list with a bound."""
        places, at = np.unique(np.concatenate([p for p, _, _ in lists]), return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, at, np.concatenate([c for _, c, _ in lists]))
        return places, sums, int(sums.max())

    def search(self, terms: list[bytes], best: tuple[np.ndarray, np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, ids) of earlier segments with what this one has."""
        lists = [self.lists[t] for t in terms if t in self.lists]
        short = [x for x in lists if len(x[0]) <= SHORT * len(self.ids)]
        lists = [x for x in lists if len(x[0]) > SHORT * len(self.ids)] + ([self.accumulated(short)] if short else [])
        lists.sort(key=lambda x: x[2])
        reach = np.cumsum([bound for *_, bound in lists])
        for begin in range(0, len(self.ids), WINDOW) if lists else ():
            bar = int(best[0][-1]) if len(best[0]) >= limit else 0
            # What cannot reach the bar together proposes no document; a score equal to the bar may win by its id.
            silent = int(np.searchsorted(reach, bar, side="left"))
            if silent == len(lists):
                break
            cuts = [slice(*np.searchsorted(places, (begin, begin + WINDOW))) for places, *_ in lists]
            tops = [int(part[cut].max()) if cut.stop > cut.start else 0 for (_, part, _), cut in zip(lists, cuts, strict=True)]
            if not any(tops[silent:]) or sum(tops) < bar:
                continue
            sums = np.zeros(WINDOW, np.int64)
            for (places, part, _), cut in zip(lists[silent:], cuts[silent:], strict=True):
                sums[places[cut] - begin] += part[cut]
            asked = np.flatnonzero(sums)
            for k in range(silent - 1, -1, -1):
                asked = asked[sums[asked] + sum(tops[: k + 1]) >= bar]
                places, part = lists[k][0][cuts[k]], lists[k][1][cuts[k]]
                if not len(asked) or not len(places):
                    continue
                at = np.minimum(np.searchsorted(places, asked + begin), len(places) - 1)
                there = places[at] == asked + begin
                sums[asked[there]] += part[at[there]]
            asked = asked[sums[asked] >= max(bar, 1)]
            if len(asked):
                scores, ids = np.concatenate([best[0], sums[asked]]), np.concatenate([best[1], self.ids[asked + begin]])
                kept = first_of(scores, ids, limit)
                best = scores[kept], ids[kept]
        return best


def _searched(asked: dict[int, list[bytes]], weights: dict[bytes, int], n_docs: int, n_terms: int, limit: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("item", pa.int64()), ("id", id_type), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment({name: batch.column(j)[k] for j, name in enumerate(batch.schema.names)}, weights, n_docs, n_terms)
                for item, terms in asked.items():
                    best[item] = segment.search(terms, best.get(item, (np.zeros(0, np.int64), segment.ids[:0])), limit)
        for item, (scores, ids) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(scores), pa.int64()), pa.array(ids.tolist(), id_type), pa.array(scores)], schema=schema)

    return run


def _top(found: DataFrame, limit: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def rank_documents(docs: DataFrame, items: DataFrame, limit: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the ``limit`` documents with the highest scores above 0 for each item, equal scores by id.

    Items of one id are one query that asks with the words of all; items and documents
    without a word (null and empty texts among them) are in no result. Repeated documents
    count and are ranked one by one; a null id comes after all others. Other columns are
    not looked at, so their names cannot clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = items.select(bare(item_col).alias("item_id"), F.explode(lowered_words(bare(item_text_col))).alias("term")).distinct()
    asked = words.groupBy("item_id").agg(F.collect_list(F.encode("term", "UTF-8")).alias("terms"))
    asked = staged(asked.select(F.monotonically_increasing_id().alias("item"), "item_id", "terms"), "ranked-items")
    terms = asked.select("item", F.explode("terms").alias("term"))
    n_asked, n_vocabulary = terms.agg(F.count(F.lit(1)), F.count_distinct("term")).first()
    vocabulary = frozenset(bytes(r[0]) for r in terms.select("term").distinct().collect()) if n_vocabulary <= TASK_TERMS else None  # bounded by TASK_TERMS
    index = staged(index_segments(docs, vocabulary, id_col, text_col), "ranked-index")
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    kind = docs.select(bare(id_col)).schema[0].dataType
    found = spark.createDataFrame([], f"item bigint, id {kind.simpleString()}, score bigint")
    if n_docs and n_asked:
        held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
        weighted = staged(terms.join(held.select(F.col("terms").alias("term"), weight.alias("w")).filter("w > 0"), "term"), "ranked-weights")
        batches = -(-n_asked // TASK_TERMS)
        for b in range(batches):
            mine = weighted.filter(F.pmod(F.xxhash64("item"), F.lit(batches)) == b) if batches > 1 else weighted
            asks, weights = {}, {}
            for r in mine.collect():  # a batch of about TASK_TERMS words
                asks.setdefault(r["item"], []).append(bytes(r["term"]))
                weights[bytes(r["term"])] = r["w"]
            part = index.mapInArrow(_searched(asks, weights, n_docs, n_terms, limit, to_arrow_type(kind)), found.schema)
            found = found.unionByName(part) if b else part
        forget(weighted)
    dealt = _top(found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), limit, "item", "salt").drop("rank", "salt")
    best = _top(dealt, limit, "item").join(asked.select("item", "item_id"), "item")
    return best.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
