"""Ranked retrieval for a table of queries.

``queries``: query_id, query, vector, groups, tenant, freshness, filters. ``chunks``:
chunk_id, document_id, chunk_index, content, embedding, and what the predicates need. No
step pairs all queries with all chunks: words lead from queries to chunks, and vectors
meet block by block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.text import dedup_key, tokens
from ..functions.vectors import cosine
from ..sources.store import staged
from . import keyword_index as K
from . import predicates as P
from . import vector_index as N
from .context import expand
from .predicates import ASKER, SEEN, may_see

#: Tables made of queries are broadcast up to so many rows; more are joined by shuffle.
BROADCAST_QUERIES = 10_000
#: Queries, and chunks, of one block of the matrix product; queries whose scores are worked out together.
BLOCK, TOGETHER = 16_384, 64
DECIMALS = 6
#: Searches whose words have up to so many postings in a stored index read them all.
PRUNE_ABOVE = 50_000_000
#: Searches with more hits than that, that ask for a posting so often on average, meet the stored postings block by block.
MANY_HITS, ASKED_OFTEN = 20_000_000, 4
#: Rows of chunks are picked by a broadcast of up to so many ids before they are joined.
BROADCAST_IDS = 1_000_000
#: Words of a text column: the place for a stemmer.
Analyzer = Callable[[Column], Column]


def _small(df: DataFrame, limit: int = BROADCAST_QUERIES) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def fits_metadata() -> Column:
    return P.metadata_matches(P.cleaned_filters(F.col("filters")), F.col("columns"), F.col("doc_metadata"), F.col("metadata"))


def postings(chunks: DataFrame, analyzer: Analyzer = tokens) -> DataFrame:
    """(term, chunk_id, tf): the keyword index, to be written once and given to every search."""
    return chunks.select("chunk_id", F.explode(analyzer(F.col("content"))).alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, analyzer: Analyzer = tokens) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(analyzer(F.col("query")))).alias("term"))


def keyword_ranks(queries: DataFrame, chunks: DataFrame, index: DataFrame | None = None, analyzer: Analyzer = tokens) -> DataFrame:
    """(query_id, chunk_id, fts_rank): 0.1 for every matching position of any query term.

    Without an index the chunks' words meet the terms as they are read, so only hits are
    shuffled. Queries and chunks go through one analyzer, plain words unless a stemmer is
    plugged in; an index must have been built with the same one.
    """
    terms = _small(query_terms(queries, analyzer), 10 * BROADCAST_QUERIES)
    words = chunks.select("chunk_id", F.explode(analyzer(F.col("content"))).alias("term"), F.lit(1).alias("tf")) if index is None else index
    return words.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.round(0.1 * F.sum("tf"), DECIMALS).alias("fts_rank"))


def _top(df: DataFrame, limit: int, *order) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


def _units(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(float)
    return matrix / np.where((n := np.linalg.norm(matrix, axis=1, keepdims=True)) > 0, n, 1)


def _nearest(limit: int):
    """Of two blocks of one class, each query's ``limit`` best chunks by rounded score and chunk_id, as the window that merges blocks has it."""

    def nearest(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "chunk_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})]
        if len(some) and len(others):
            others = others.sort_values("chunk_id", ignore_index=True)
            ids, matrix, chunk_ids, vectors = some["query_id"].to_numpy(), _units(some["vector"]), others["chunk_id"].to_numpy(), _units(others["embedding"])
            most = min(limit, len(chunk_ids))
            for at in range(0, len(ids), TOGETHER):
                scores = (matrix[at : at + TOGETHER] @ vectors.T).round(DECIMALS)
                # The limit-th best score of each query; what equals it is kept too, and cut by chunk_id.
                bar = -np.partition(-scores, most - 1, axis=1)[:, most - 1 : most]
                q, c = np.nonzero(scores >= bar)
                order = np.lexsort((c, -scores[q, c], q))
                q, c = q[order], c[order]
                place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
                q, c = q[place < most], c[place < most]
                parts.append(pd.DataFrame({"query_id": ids[at : at + TOGETHER][q], "chunk_id": chunk_ids[c], "score": scores[q, c]}))
        return pd.concat(parts[1:] or parts)

    return nearest


def _met_blocks(asked: DataFrame, held: DataFrame, limit: int, block: int) -> DataFrame:
    """(query_id, chunk_id, score) of asked (class, query_id, vector) and held (class, chunk_id, embedding), class by class.

    Both are dealt to blocks of about ``block`` rows of the largest class, and each two blocks of a class meet in one group of a shuffle.
    """
    largest = lambda df: df.groupBy("class").count().agg(F.max("count")).first()[0] or 0
    qbs, cbs = (max(1, -(-largest(df) // block)) for df in (asked, held))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = asked.select("*", one("query_id", qbs).alias("qb"), every(cbs).alias("cb"))
    right = held.select("*", one("chunk_id", cbs).alias("cb"), every(qbs).alias("qb"))
    keys = ["class", "qb", "cb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_nearest(limit), "query_id bigint, chunk_id bigint, score double")


def top_k_blocks(queries: DataFrame, chunks: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank): unfiltered nearest chunks by block matrix products."""
    asked = queries.filter("vector is not null").select(F.lit(0).alias("class"), "query_id", "vector")
    held = chunks.filter("embedding is not null").select(F.lit(0).alias("class"), "chunk_id", "embedding")
    return _top(_met_blocks(asked, held, limit, block), limit, F.col("score").desc(), "chunk_id")


def vector_candidates(queries: DataFrame, chunks: DataFrame, limit: int, as_of_year: int, pre: bool = False, block: int = BLOCK, index: N.VectorIndex | None = None) -> DataFrame:
    """The chunks' columns with query_id, score and rank: nearest by cosine among those that the query may see.

    Queries that may see the same are one class; a chunk is looked at once for each class
    of its tenant, and vectors meet in blocks. With a stored index a vector is sent once for
    all classes, and blocks that cannot hold a better one are passed over. Chunks without a
    vector come last, ties go by chunk_id. Queries without a vector have no list.
    """
    asked, seen = _classes(queries.filter("vector is not null"), chunks, as_of_year, pre)
    if index is None:
        there = chunks.filter("embedding is not null").select("chunk_id", "embedding")
        met = _met_blocks(asked.select("class", "query_id", "vector"), seen.filter("there").select("class", "chunk_id").join(there, "chunk_id"), limit, block)
    else:
        by_chunk = seen.filter("there").groupBy("chunk_id").agg(F.collect_set("class").alias("classes"))
        met, _ = N.nearest_visible(index, asked.select("query_id", "class", "vector"), by_chunk, limit)
    first = F.row_number().over(Window.partitionBy("class").orderBy("chunk_id"))
    blanks = seen.filter("not there").select("class", "chunk_id").withColumn("n", first).filter(F.col("n") <= limit)
    blanks = asked.select("class", "query_id").join(blanks, "class").select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(True).alias("blank"))
    best = _top(met.withColumn("blank", F.lit(False)).unionByName(blanks), limit, "blank", F.col("score").desc(), "chunk_id").drop("blank")
    best = staged(best, "vector-best")
    return _picked(chunks, best).join(best, "chunk_id")


def _picked(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The chunks that are in ``found``, picked before anything of them is exchanged if these are not too many."""
    ids = found.select("chunk_id").distinct()
    return chunks.join(F.broadcast(ids), "chunk_id", "left_semi") if ids.count() <= BROADCAST_IDS else chunks


def _classes(queries: DataFrame, chunks: DataFrame, as_of_year: int, pre: bool) -> tuple[DataFrame, DataFrame]:
    """Queries with their ``class``, which may see the same, and (class, chunk_id, there) of what each may see; ``there`` tells of a vector."""
    who = [*ASKER, *(["filters"] if pre else [])]
    key = F.xxhash64("tenant", F.col("groups").isNull(), "groups", F.col("freshness").isNull(), "freshness", *([F.to_json("filters")] if pre else []))
    asked = queries.withColumn("class", key)
    classes = asked.groupBy("class").agg(*[F.first(c).alias(c) for c in who])
    classes = classes.select("class", *who, F.explode(F.array_distinct(F.array("tenant", F.split("tenant", "-")[0]))).alias("tenant_id"))
    ok = may_see(as_of_year) & (fits_metadata() if pre else F.lit(True))
    looked = ["chunk_id", F.col("embedding").isNotNull().alias("there"), *SEEN, *(["columns", "doc_metadata", "metadata"] if pre else [])]
    return asked, chunks.select(*looked).join(_small(classes), "tenant_id").filter(ok).select(F.col("class").alias("class"), "chunk_id", "there")


def keyword_candidates(queries: DataFrame, chunks: DataFrame, limit: int, as_of_year: int, index: DataFrame | K.KeywordIndex | None = None, pre: bool = False, analyzer: Analyzer = tokens, prune_above: int = PRUNE_ABOVE) -> DataFrame:
    """The chunks' columns with query_id, fts_rank, score and rank: by keyword rank; ``score`` is the cosine, for display.

    The index gives the pairs; chunks come in by their ids, and only the first ``limit`` of
    each query are scored. Of a stored index the queries' postings are read, and if there
    are more than ``prune_above``, only those that can lead to a first chunk; the chunks that
    they lead to are then counted by their words. Many queries that ask for the same postings
    meet them in blocks, those of the same words and rights as one search.
    """
    stored = isinstance(index, K.KeywordIndex)
    queries = staged(queries, "keyword-queries") if stored else queries
    about = chunks.select("chunk_id", *SEEN, *(["columns", "doc_metadata", "metadata"] if pre else []))
    asker = queries.select("query_id", *ASKER, *(["filters"] if pre else []))

    def visible(pairs: DataFrame) -> DataFrame:
        return pairs.join(about, "chunk_id").join(asker, "query_id").filter(may_see(as_of_year) & (fits_metadata() if pre else F.lit(True)))

    rank = lambda n: F.round(0.1 * n, DECIMALS).alias("fts_rank")
    terms = staged(query_terms(queries, analyzer), "keyword-terms") if stored else None
    postings_there, hits_there = K.n_hits(index, terms) if stored else (0, 0)
    if stored and hits_there > max(MANY_HITS, ASKED_OFTEN * postings_there):
        classed, seen = _classes(queries, chunks, as_of_year, pre)
        words = terms.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
        asked = staged(classed.select("query_id", "class").join(words, "query_id").withColumn("search", F.xxhash64("class", "terms")), "keyword-asked")
        searches = asked.groupBy("search").agg(F.first("class").alias("class"), F.first("terms").alias("terms"))
        hits = _top(K.best_hits(index, searches, seen.select("class", "chunk_id"), limit).withColumnRenamed("search", "query_id"), limit, F.col("score").desc(), "chunk_id")
        hits = hits.select(F.col("query_id").alias("search"), "chunk_id", rank(F.col("score")))
        pairs = hits.join(asked.select("query_id", "search"), "search")
    elif stored and postings_there > prune_above:
        asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("asked"))
        seen = lambda hits: visible(staged(hits, "keyword-hits"))
        reads, _ = K.search_plan(index, terms, seen, limit)
        led_to = staged(seen(K.candidates(index, reads)).select("query_id", "chunk_id"), "keyword-pairs")
        places = F.size(F.filter(analyzer(F.col("content")), lambda w: F.array_contains("asked", w)))
        pairs = chunks.select("chunk_id", "content").join(led_to, "chunk_id").join(asked, "query_id").select("query_id", "chunk_id", rank(places))
    elif stored:
        pairs = visible(K.all_hits(index, terms).groupBy("query_id", "chunk_id").agg(rank(F.sum("tf"))))
    else:
        pairs = visible(keyword_ranks(queries, chunks, index, analyzer))
    best = _top(pairs.select("query_id", "chunk_id", "fts_rank"), limit, F.col("fts_rank").desc(), "chunk_id")
    best = staged(best, "keyword-best") if stored else best
    found = (_picked(chunks, best) if stored else chunks).join(best, "chunk_id").join(queries.select("query_id", "vector"), "query_id")
    return found.withColumn("score", F.round(cosine(F.col("embedding"), F.col("vector")), DECIMALS)).drop("vector")


def boosted(df: DataFrame, boost: float, as_of_year: int) -> DataFrame:
    """A constant on top for documents of the year; lists keep their order."""
    return df.withColumn("score", F.round(F.col("score") + F.when(F.year("created_at") == as_of_year, boost).otherwise(0.0), DECIMALS))


def with_metadata(df: DataFrame) -> DataFrame:
    """Document and chunk metadata in one map, the chunk's values first."""
    doc = F.map_filter("doc_metadata", lambda k, v: ~F.coalesce(F.map_contains_key("metadata", k), F.lit(False)))
    return df.withColumn("merged_metadata", F.map_concat(F.coalesce(doc, F.create_map().cast("map<string,string>")), F.coalesce("metadata", F.create_map().cast("map<string,string>"))))


# ---- fusion ------------------------------------------------------------------------------


def _deduplicated(fused: DataFrame, limit: int, *order) -> DataFrame:
    """Best of each text key (worked out here if ``fused`` has none), then the first ``limit`` of each query."""
    best = Window.partitionBy("query_id", "key").orderBy(*order)
    keyed = fused if "key" in fused.columns else fused.withColumn("key", dedup_key(F.col("content")))
    first = keyed.withColumn("in_key", F.row_number().over(best)).filter("in_key = 1")
    return _top(first.drop("in_key", "key"), limit, *order)


def _both_lists(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Both lists by chunk. Texts' keys are made before the join, so that a caller without use for texts has none of them moved."""
    told = lambda df, x, *more: df.select("query_id", "chunk_id", *[F.col(c).alias(f"{x}_{c}") for c in ("content", "score", "rank")], dedup_key(F.col("content")).alias(f"{x}_key"), *more)
    both = told(vector, "v").join(told(keyword, "k", "fts_rank"), ["query_id", "chunk_id"], "full_outer")
    return both.select("*", F.coalesce("v_content", "k_content").alias("content"), F.coalesce("v_key", "k_key").alias("key"))


def fuse_rrf(vector: DataFrame, keyword: DataFrame, limit: int, k: int = 60, vector_weight: float = 0.6, keyword_weight: float = 0.4) -> DataFrame:
    """Weighted reciprocal ranks; ties go to the vector list's order, then the keyword list's."""
    both = _both_lists(vector, keyword)
    score = F.coalesce(vector_weight / (k + F.col("v_rank")), F.lit(0.0)) + F.coalesce(keyword_weight / (k + F.col("k_rank")), F.lit(0.0))
    fused = both.withColumn("fused", F.round(score, 9))
    return _deduplicated(fused, limit, F.col("fused").desc(), F.col("v_rank").asc_nulls_last(), F.col("k_rank").asc_nulls_last(), "chunk_id").select("query_id", "rank", "chunk_id", F.col("fused").alias("score"), "content")


def fuse_scores(vector: DataFrame, keyword: DataFrame, limit: int, vector_weight: float = 0.6, keyword_weight: float = 0.4, threshold: float = 0.0) -> DataFrame:
    """Weighted sum of cosine (0 at least) and keyword rank over the query's largest (0.1 at least); the threshold comes after the cut."""
    both = _both_lists(vector, keyword)
    top = F.greatest(F.coalesce(F.max("fts_rank").over(Window.partitionBy("query_id")), F.lit(0.0)), F.lit(0.1))
    score = vector_weight * F.when(F.col("v_rank").isNotNull(), F.greatest(F.lit(0.0), "v_score")).otherwise(0.0) + keyword_weight * F.coalesce("fts_rank", F.lit(0.0)) / top
    fused = both.withColumn("fused", F.round(score, 9))
    cut = _deduplicated(fused, limit, F.col("fused").desc(), F.col("v_rank").asc_nulls_last(), F.col("k_rank").asc_nulls_last(), "chunk_id")
    return cut.filter(F.col("fused") >= threshold).select("query_id", "rank", "chunk_id", F.col("fused").alias("score"), "content")


def fuse_union(vector: DataFrame, keyword: DataFrame, vector_limit: int, keyword_limit: int) -> DataFrame:
    """The first distinct of the vector list, then the keyword list until both limits together are full."""
    first = _deduplicated(vector.select("query_id", "chunk_id", "content", "score", F.col("rank").alias("place")), vector_limit, "place")
    first = first.withColumn("list", F.lit(0)).select("query_id", "chunk_id", "content", "score", "place", "list")
    taken = first.select("query_id", "chunk_id")
    keys = first.select("query_id", dedup_key(F.col("content")).alias("key"))
    more = keyword.select("query_id", "chunk_id", "content", "score", F.col("rank").alias("place")).withColumn("key", dedup_key(F.col("content")))
    more = more.join(taken, ["query_id", "chunk_id"], "left_anti").join(keys, ["query_id", "key"], "left_anti")
    once = more.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("place"))).filter("n = 1")
    both = first.unionByName(once.withColumn("list", F.lit(1)).select("query_id", "chunk_id", "content", "score", "place", "list"))
    return _top(both, vector_limit + keyword_limit, "list", "place").select("query_id", "rank", "chunk_id", "score", "content")


def retrieve(queries: DataFrame, chunks: DataFrame, config: SearchConfig, as_of_year: int, index: DataFrame | K.KeywordIndex | None = None, limit: int | None = None, analyzer: Analyzer = tokens) -> DataFrame:
    """The whole search for every query: (query_id, rank, chunk_id, score, content). ``limit`` None means the configured one.

    With a context expansion, ``content`` is the hit between markers among what surrounds it,
    as far as the query may see it; ``chunks`` then need page_number and section_title.
    """
    cut = config.final_limit if limit is None else limit
    pre = config.metadata_stage == "pre"
    wanted = queries.select("query_id", "filters")

    def listed(df: DataFrame) -> DataFrame:
        kept = boosted(df, config.freshness_boost, as_of_year)
        if not pre:
            kept = kept.join(wanted, "query_id").filter(fits_metadata()).drop("filters")
            kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        return kept

    slim = ["query_id", "rank", "chunk_id", "score", "content"]
    vector = keyword = None
    if config.search_strategy in ("vector", "hybrid"):
        vector = listed(vector_candidates(queries, chunks, config.vector_limit, as_of_year, pre))
    if config.search_strategy in ("keyword", "hybrid"):
        keyword = listed(keyword_candidates(queries, chunks, config.keyword_limit, as_of_year, index, pre, analyzer))
    if keyword is None:
        found = vector.filter((F.col("rank") <= cut) & (F.col("score") >= config.score_threshold)).select(*slim)
    elif vector is None:
        found = keyword.filter(F.col("rank") <= cut).select(*slim)
    elif config.hybrid_strategy == "rrf":
        found = fuse_rrf(vector, keyword, cut, config.rrf_k, config.vector_weight, config.keyword_weight)
    elif config.hybrid_strategy == "score":
        found = fuse_scores(vector, keyword, cut, config.vector_weight, config.keyword_weight, config.score_threshold)
    else:
        found = fuse_union(vector, keyword, config.vector_final_limit, config.keyword_final_limit)
    if config.context_expansion == "none":
        return found
    around = chunks.select("chunk_id", "document_id", "chunk_index", "page_number", "section_title")
    hits = found.join(around, "chunk_id").withColumn("hit_id", F.col("chunk_id"))
    more = expand(hits, chunks, config.context_expansion, config.context_expansion_size, config.context_max_tokens, queries, as_of_year)
    return found.drop("content").join(more.withColumnRenamed("hit_id", "chunk_id"), ["query_id", "chunk_id"]).select(*slim)
