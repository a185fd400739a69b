"""A keyword index that is kept with the chunks, updated by generations and read as far as a search needs.

A row holds the chunks of one share in which a word is equally frequent: a frequency and
plain ids, which is all that the exchange by key moves. Rows are bucketed by a key of the
word and its slice (a frequent word has several, so it is no task's alone), and sorted by
key. A search looks at the frequencies first; the words' highest postings give every query the
score that its list must reach, and from then on only rows that can lead to it are read.

Many searches at once go the other way: blocks of shares meet all searches (``best_hits``),
so a posting is sent once however many ask for it, and no pair of query and chunk is a row
unless it is among the best of its block.

An update writes a generation: the postings of fresh chunks and the ids of those that are
gone. A posting counts unless its chunk is gone in a later generation. ``compacted`` writes
all that counts as a new beginning.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.store import file_system, mark, staged

#: Slices of a word, and chunks that share a row at most (on average); small tables have more shares, so that tasks are not too few.
SLICES, SHARE, SMALL_SHARES, SMALL_SHARE = 8, 16_384, 16, 2048
#: Tables made of queries' words, and ids of gone chunks, are broadcast up to so many rows.
BROADCAST_ROWS = 100_000
#: Of so many keys at most the buckets are picked by name.
NAMED_KEYS = 512
#: Postings of a word, for each chunk that a list has room for, from which the score to reach is estimated.
DEPTH = 4
#: Postings of one block of ``best_hits`` on average, of so many blocks one in this many is searched first, and a word's share of a block's chunks from which it is an array over all of them.
BLOCK_POSTINGS, FIRST_BLOCKS, FREQUENT = 4_000_000, 8, 1 / 32
#: Shares whose rows are about one bucket.
BUCKET_SHARES = 4
_READS = "array<struct<term:string,least:int,need:int>>"
_ROWS = "term string, tf int, share int, chunk_ids array<{kind}>"
_COLUMNS = "key bigint, term string, tf int, n int, share int, shares int, chunk_ids array<{kind}>"


@dataclass(frozen=True)
class KeywordIndex:
    """Where an index is, the type of chunk_id, and the buckets of generations to come (of those there are, their folders tell). One without its mark does not count."""

    folder: str
    kind: str = "bigint"
    buckets: int = 64

    def generations(self, spark: SparkSession) -> list[tuple[int, str, bool]]:
        """(number, folder, whether all begins anew) of what counts, oldest first."""
        pattern, fs = file_system(spark, f"{self.folder}/generation=*/_*")
        names = [s.getPath() for s in fs.globStatus(pattern) or []]
        found = sorted((int(p.getParent().getName().split("=")[1].split("-")[0]), p.getParent().toString(), p.getName() == "_anew") for p in names if p.getName() in ("_anew", "_more"))
        starts = [k for k, (_, _, anew) in enumerate(found) if anew]
        return found[starts[-1] :] if starts else []


def _share(chunk_id: Column, shares: int) -> Column:
    """A power of two of shares, so that those of a smaller one are unions of them."""
    return F.pmod(F.xxhash64(chunk_id), F.lit(shares)).cast("int")


def _power(n: float) -> int:
    """The power of two that is ``n`` at least."""
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


def _key(term: Column, piece: Column) -> Column:
    return F.xxhash64(term, piece)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before, and the end."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def _share_rows(table: pa.Table) -> pa.Table:
    """Rows of the index for the chunks (share, chunk_id, terms, tf) of a share: every place in ``terms`` counts ``tf`` times; a chunk may have several rows."""
    ids = table["chunk_id"].combine_chunks()
    words = pa.concat_arrays([c.flatten() for c in table["terms"].chunks]).dictionary_encode()
    lengths = pc.list_value_length(table["terms"]).to_numpy()
    by_id = pc.sort_indices(ids).to_numpy()
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    # A number for word and chunk; it occurs as often as the word does there.
    pairs = words.indices.to_numpy().astype(np.int64)
    pairs *= len(ids)
    pairs += np.repeat(place, lengths)
    if pc.all(pc.equal(table["tf"], 1)).as_py():
        pairs, tf = np.unique(pairs, return_counts=True)
    else:
        each = np.repeat(table["tf"].to_numpy(), lengths)
        pairs, at = np.unique(pairs, return_inverse=True)
        tf = np.bincount(at, each).astype(np.int64)
    term, at = np.divmod(pairs, max(1, len(ids)))
    order = np.argsort(term * (tf.max(initial=0) + 1) + tf, kind="stable")  # chunks of a word and frequency stay sorted
    term, at, tf = term[order], at[order], tf[order]
    cuts = _runs(term, tf)
    return pa.table({
        "term": words.dictionary.take(pa.array(term[cuts[:-1]])), "tf": pa.array(tf[cuts[:-1]], pa.int32()), "share": pa.array(np.full(len(cuts) - 1, table["share"][0].as_py()), pa.int32()),
        "chunk_ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids.take(pa.array(by_id[at]))),
    })


def _write(index: KeywordIndex, chunks: DataFrame, terms: Column, tf: Column, n_chunks: int, number: int, anew: bool, gone: DataFrame | None) -> None:
    """A generation of ``chunks``: rows with a chunk_id and words ``terms``, each of which counts ``tf`` times; a chunk may have several rows."""
    spark = chunks.sparkSession
    shares = _power(max(n_chunks / SHARE, min(SMALL_SHARES, n_chunks / SMALL_SHARE)))
    buckets = max(index.buckets, shares // BUCKET_SHARES)
    place = f"{index.folder}/generation={number}-{buckets}-{uuid.uuid4().hex[:8]}"
    # What is dealt out is the chunks; their words are told apart where a share is together.
    dealt = chunks.withColumn("chunk_id", F.col("chunk_id").cast(index.kind)).withColumn("share", _share(F.col("chunk_id"), shares)).repartition(shares, "share")
    rows = dealt.select("share", "chunk_id", F.coalesce(terms, F.array().cast("array<string>")).alias("terms"), tf.cast("bigint").alias("tf"))
    rows = rows.groupBy("share").applyInArrow(_share_rows, _ROWS.format(kind=index.kind))
    # What can be worked out again isn't exchanged.
    key = _key(F.col("term"), F.pmod("share", F.lit(SLICES)).cast("int"))
    keyed = rows.repartition(buckets, key).select(key.alias("key"), "term", "tf", F.size("chunk_ids").alias("n"), "share", F.lit(shares).alias("shares"), "chunk_ids")
    name = f"corpusloom_keywords_{uuid.uuid4().hex}"
    keyed.write.bucketBy(buckets, "key").sortBy("key", "term", "tf").option("compression", "zstd").option("path", f"{place}/rows").saveAsTable(name)
    spark.sql(f"drop table {name}")  # an external table: its files stay
    if gone is not None:
        gone.select("chunk_id").distinct().write.parquet(f"{place}/gone")
    mark(spark, f"{place}/{'_anew' if anew else '_more'}")


def _write_chunks(index: KeywordIndex, chunks: DataFrame, analyzer, number: int, anew: bool, gone: DataFrame | None) -> None:
    _write(index, chunks.select("chunk_id", "content"), analyzer(F.col("content")), F.lit(1), chunks.count(), number, anew, gone)


def build(index: KeywordIndex, chunks: DataFrame, analyzer=tokens) -> None:
    """A new beginning of the index, from all chunks (chunk_id, content)."""
    earlier = index.generations(chunks.sparkSession)
    _write_chunks(index, chunks, analyzer, earlier[-1][0] + 1 if earlier else 0, True, None)


def update(index: KeywordIndex, gone: DataFrame, fresh: DataFrame, analyzer=tokens) -> None:
    """A generation: chunks of ``gone`` (chunk_id) no longer count, those of ``fresh`` (chunk_id, content) do; an id may be in both."""
    _write_chunks(index, fresh, analyzer, index.generations(fresh.sparkSession)[-1][0] + 1, False, gone)


def _rows(index: KeywordIndex, spark: SparkSession, place: str) -> DataFrame:
    """The bucketed rows of one generation."""
    buckets = int(place.rsplit("=", 1)[1].split("-")[1])
    name = "corpusloom_keywords_" + hashlib.sha256(place.encode()).hexdigest()[:24]
    if not spark.catalog.tableExists(name):
        spark.sql(f"create table {name} ({_COLUMNS.format(kind=index.kind)}) using parquet clustered by (key) sorted by (key) into {buckets} buckets location '{place}/rows'")
    return spark.table(name)


def _gone_later(index: KeywordIndex, spark: SparkSession) -> DataFrame | None:
    """(chunk_id, gone_in): the last generation in which a chunk went."""
    tables = [spark.read.parquet(f"{place}/gone").withColumn("gone_in", F.lit(n)) for n, place, anew in index.generations(spark) if not anew]
    if not tables:
        return None
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("chunk_id").agg(F.max("gone_in").alias("gone_in"))


def live_postings(index: KeywordIndex, spark: SparkSession) -> DataFrame:
    """(term, chunk_id, tf) of all that counts."""
    return _hits(index, spark, None, lambda rows: rows.select("term", "tf", "chunk_ids"), ["term"])


def _small(df: DataFrame) -> tuple[DataFrame, int]:
    n = df.count()
    return (F.broadcast(df) if n <= BROADCAST_ROWS else df), n


def _of_words(index: KeywordIndex, spark: SparkSession, words: DataFrame) -> list[tuple[int, DataFrame]]:
    """(generation, rows joined with ``words`` (term, ...)); rows are not exchanged, and buckets without a word not opened if the words are few."""
    keyed = words.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).withColumn("key", _key(F.col("term"), F.col("slice"))).drop("slice")
    asked, n = _small(keyed)
    named = [r[0] for r in keyed.select("key").distinct().collect()] if n <= NAMED_KEYS else None  # few by the count
    out = []
    for number, place, _ in index.generations(spark):
        rows = _rows(index, spark, place)
        # The join is by the buckets' column alone, which keeps it free of an exchange of rows; keys that collide are told apart after it.
        met = (rows.filter(F.col("key").isin(named)) if named else rows).withColumnRenamed("term", "held").join(asked, "key")
        out.append((number, met.filter(F.array_contains(F.array("term"), F.col("held"))).drop("held")))
    return out


def _hits(index: KeywordIndex, spark: SparkSession, words: DataFrame | None, pick, columns: list[str]) -> DataFrame:
    """``columns`` with chunk_id and tf of every posting that counts, out of the rows that ``pick`` leaves."""
    found, out = _gone_later(index, spark), None
    tables = _of_words(index, spark, words) if words is not None else [(n, _rows(index, spark, place)) for n, place, _ in index.generations(spark)]
    for number, rows in tables:
        part = pick(rows).select(*columns, "tf", F.explode("chunk_ids").alias("chunk_id")).select(*columns, "chunk_id", "tf")
        if found is not None:
            later = found.filter(F.col("gone_in") > number).select("chunk_id")
            part = part.join(_small(later)[0], "chunk_id", "left_anti")
        out = part if out is None else out.unionByName(part)
    return out


def bounds(index: KeywordIndex, spark: SparkSession, words: DataFrame) -> DataFrame:
    """(term, tf, n): how many postings the words have of each frequency; postings themselves are not read."""
    out = None
    for _, rows in _of_words(index, spark, words):
        part = rows.groupBy("term", "tf").agg(F.sum("n").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("term", "tf").agg(F.sum("n").alias("n"))


def first_reads(limit: pd.Series, told: pd.Series) -> pd.Series:
    """Of each word the highest frequencies, down to DEPTH times as many postings as the list has room for."""

    def reads(most: int, words) -> list[dict]:
        out = []
        for w in words:
            left = DEPTH * most
            for b in sorted(w["bounds"], key=lambda b: -b["tf"]):
                least, left = b["tf"], left - b["n"]
                if left <= 0:
                    break
            out.append({"term": w["term"], "least": int(least), "need": 1})
        return out

    return pd.Series([reads(n, w) for n, w in zip(limit, told, strict=True)])


def last_reads(score: pd.Series, told: pd.Series) -> pd.Series:
    """The words, and of each the frequencies, that lead to every chunk whose frequencies sum up to ``score`` at least.

    Words outside the ones chosen sum up to less than the score even at their highest, so
    such a chunk has one of the chosen words, and as often as its share of what is missing.
    Of the choices by falling highest frequency the one with the fewest postings is taken.
    ``need`` is what a chunk's postings that are read must sum up to, each counted from one
    below ``least``, as what isn't read has at most that or its word's highest frequency.
    """

    def reads(need: int, words) -> list[dict]:
        order = sorted(words, key=lambda w: -max(b["tf"] for b in w["bounds"]))
        tops = [max(b["tf"] for b in w["bounds"]) for w in order]
        best = None
        for k in range(1, len(order) + 1):
            missing = need - sum(tops[k:])
            if missing < 1 and k < len(order):
                continue
            least = max(1, -(-missing // k))
            cost = sum(b["n"] for w in order[:k] for b in w["bounds"] if b["tf"] >= least)
            if best is None or cost < best[0]:
                best = cost, [{"term": w["term"], "least": int(least), "need": int(missing - k * (least - 1))} for w in order[:k]]
        return best[1]

    return pd.Series([reads(int(s), w) for s, w in zip(score, told, strict=True)])


def n_postings(index: KeywordIndex, terms: DataFrame) -> int:
    """Postings of the different words of ``terms``; none is read."""
    return sum(rows.agg(F.sum("n")).first()[0] or 0 for _, rows in _of_words(index, terms.sparkSession, terms.select("term").distinct()))


def n_hits(index: KeywordIndex, terms: DataFrame) -> tuple[int, int]:
    """Postings of the different words of ``terms`` (query_id, term), and the same with a word's counted for every query that has it; none is read."""
    asked = terms.groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    found = [rows.agg(F.sum("n"), F.sum(F.col("n") * F.col("times"))).first() for _, rows in _of_words(index, terms.sparkSession, asked)]
    return sum(r[0] or 0 for r in found), sum(r[1] or 0 for r in found)


def all_hits(index: KeywordIndex, terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id, tf) of every posting of terms (query_id, term)."""
    return _hits(index, terms.sparkSession, terms, lambda rows: rows, ["query_id"])


def search_plan(index: KeywordIndex, terms: DataFrame, visible: Callable[[DataFrame], DataFrame], limit: int) -> tuple[DataFrame, DataFrame]:
    """For ``terms`` (query_id, term): what each query reads (query_id, term, least, need), and its words' postings below every bound (query_id, told).

    ``visible`` takes (query_id, chunk_id, score) and leaves what the query may see. The
    score to reach is the limit-th best sum of frequencies among the highest postings, a
    lower bound of the limit-th best score; a query with fewer such chunks reads all.
    """
    spark = terms.sparkSession
    words = terms.select("term").distinct()
    known = terms.join(_small(bounds(index, spark, words))[0], "term").groupBy("query_id", "term").agg(F.collect_list(F.struct("tf", "n")).alias("bounds"))
    told = staged(known.groupBy("query_id").agg(F.collect_list(F.struct("term", "bounds")).alias("told")), "keyword-bounds")
    first = staged(told.select("query_id", F.explode(F.pandas_udf(first_reads, _READS)(F.lit(limit), "told")).alias("r")).select("query_id", "r.*"), "keyword-first")
    seen = visible(_asked_hits(index, first).groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("score"))).select("query_id", "chunk_id", "score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    bar = seen.withColumn("place", place).filter(F.col("place") == limit).select("query_id", "score")
    needs = told.join(bar, "query_id", "left").select("query_id", "told", F.coalesce("score", F.lit(0)).alias("score"))
    return staged(needs.select("query_id", F.explode(F.pandas_udf(last_reads, _READS)("score", "told")).alias("r")).select("query_id", "r.*"), "keyword-reads"), told


def _asked_hits(index: KeywordIndex, reads: DataFrame) -> DataFrame:
    """(query_id, chunk_id, tf, least, need) for reads (query_id, term, least, need)."""
    asked = ["query_id", "least", "need"]
    return _hits(index, reads.sparkSession, reads, lambda rows: rows.filter(F.col("tf") >= F.col("least")), asked).select(*asked, "chunk_id", "tf")


def candidates(index: KeywordIndex, reads: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the postings that ``reads`` names, without those that cannot reach the query's score."""
    found = _asked_hits(index, reads).groupBy("query_id", "chunk_id").agg(F.sum(F.col("tf") - F.col("least") + 1).alias("got"), F.first("need").alias("need"))
    return found.filter(F.col("got") >= F.col("need")).select("query_id", "chunk_id")


def postings_read(told: DataFrame, reads: DataFrame) -> DataFrame:
    """(query_id, postings, read): how many postings a query's words have, and how many are in rows that it reads."""
    rows = told.select("query_id", F.explode("told").alias("w")).select("query_id", "w.term", F.explode("w.bounds").alias("b")).join(reads, ["query_id", "term"], "left")
    read = F.when(F.col("b.tf") >= F.col("least"), F.col("b.n")).otherwise(0)
    return rows.groupBy("query_id").agg(F.sum("b.n").alias("postings"), F.sum(read).alias("read"))


def compacted(index: KeywordIndex, spark: SparkSession, n_chunks: int) -> None:
    """All that counts as a new beginning; earlier generations no longer do."""
    _write(index, live_postings(index, spark), F.array("term"), F.col("tf"), n_chunks, index.generations(spark)[-1][0] + 1, True, None)


# ---- many searches at once ---------------------------------------------------------------


def _best_scores(scores: np.ndarray, bar: int, before: int, limit: int) -> np.ndarray:
    """Places of the ``limit`` highest scores above ``bar``, or equal to it and before ``before``, of equal ones the first; in no order."""
    low, high = bar, int(scores.max(initial=0))
    if high < low:
        return np.empty(0, np.int64)
    if (more := np.count_nonzero(scores > low)) < limit:
        return np.concatenate([np.flatnonzero(scores > low), np.flatnonzero(scores[:before] == low)[: limit - more]])
    low += 1
    while low < high:  # the highest that at least ``limit`` reach
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.count_nonzero(scores >= middle) >= limit else (low, middle - 1)
    over = np.flatnonzero(scores > low)
    return np.concatenate([over, np.flatnonzero(scores == low)[: limit - len(over)]])


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists, and how many each has."""
    return pa.concat_arrays([c.flatten() for c in lists.chunks]).to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy()


def _block_searched(limit: int, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one block: the ``limit`` best chunks of each search by sum of frequencies and chunk_id, among those that its class may see.

    ``held`` (class, term, tf, chunk_ids) has words' postings, and with a class in place of the
    word the chunks that it may see; ``asked`` is (search, class, terms, bar, last). Of chunks
    at the score ``bar`` those before the chunk ``last`` count, all if there is none.
    """
    out = pa.schema([("search", pa.int64()), ("chunk_id", kind), ("score", pa.int64())])

    def searched(held: pa.Table, asked: pa.Table) -> pa.Table:
        may, words = held.filter(pc.is_null(held["term"])), held.filter(pc.is_valid(held["term"]))
        if not len(may) or not len(words) or not len(asked):
            return out.empty_table()
        ids, lengths = _flat(may["chunk_ids"])
        seen_by = np.repeat(may["class"].to_numpy(), lengths)
        chunks, at = np.unique(ids, return_inverse=True)
        ids, lengths = _flat(words["chunk_ids"])
        times = np.repeat(words["tf"].to_numpy(), lengths)
        place = np.minimum(np.searchsorted(chunks, ids), len(chunks) - 1)
        visible = chunks[place] == ids
        named = words["term"].combine_chunks().dictionary_encode()
        code = np.repeat(named.indices.to_numpy(), lengths)[visible]
        order = np.argsort(code, kind="stable")
        place, times = place[visible][order], times[visible][order]
        cuts = np.searchsorted(code[order], np.arange(len(named.dictionary) + 1))
        codes = {t: k for k, t in enumerate(named.dictionary.to_pylist())}
        tops, some = np.zeros(len(codes), np.int64), cuts[1:] > cuts[:-1]
        if some.any():
            tops[some] = np.maximum.reduceat(times, cuts[:-1][some])
        terms = asked["terms"].to_pylist()
        most = int(times.max(initial=0)) * max(map(len, terms))
        number = np.int16 if most < 1 << 15 else np.int64
        times = times.astype(number)
        arrays: dict[int, np.ndarray] = {}
        scores, rows = np.zeros(len(chunks), number), []
        classes = asked["class"].to_numpy()
        searches, bars = asked["search"].to_numpy(), asked["bar"].to_numpy()
        befores = [len(chunks) if last is None else int(np.searchsorted(chunks, last)) for last in asked["last"].to_pylist()]
        for cls in np.unique(classes):
            sees = np.zeros(len(chunks), number)
            sees[at[seen_by == cls]] = 1
            if not sees.any():
                continue
            for i in np.flatnonzero(classes == cls):
                there = [codes[t] for t in terms[i] if t in codes]
                if tops[there].sum() < bars[i]:
                    continue
                scores.fill(0)
                for k in there:
                    a, b = cuts[k], cuts[k + 1]
                    if b - a > FREQUENT * len(chunks):
                        if k not in arrays:
                            arrays[k] = np.zeros(len(chunks), number)
                            arrays[k][place[a:b]] = times[a:b]
                        scores += arrays[k]
                    else:
                        scores[place[a:b]] += times[a:b]
                np.multiply(scores, sees, out=scores)
                if len(best := _best_scores(scores, int(bars[i]), befores[i], limit)):
                    rows.append((np.full(len(best), searches[i]), best, scores[best].astype(np.int64)))
        if not rows:
            return out.empty_table()
        search, best, score = map(np.concatenate, zip(*rows, strict=True))
        return pa.table([pa.array(search, pa.int64()), pa.array(chunks[best], kind), pa.array(score, pa.int64())], schema=out)

    return searched


def _round(block: int, many: int) -> int:
    """Blocks are searched from the highest round to 0; a round has about FIRST_BLOCKS times as many as those before."""
    r = 0
    while many >= 2 * FIRST_BLOCKS ** (r + 1) and block % FIRST_BLOCKS ** (r + 1) == 0:
        r += 1
    return r


def best_hits(index: KeywordIndex, searches: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """(search, chunk_id, score) that hold the ``limit`` best chunks of each of searches (search, class, terms), by sum of frequencies and chunk_id.

    ``seen`` is (class, chunk_id): what searches of a class may see. Postings, visible chunks and
    all searches meet block by block. Where blocks are many, they are searched in rounds: a search's
    limit-th best chunk so far is what those of later blocks must come before, by score and
    chunk_id, so that what a round finds grows with the searches, not with the blocks.
    """
    spark = searches.sparkSession
    seen = staged(seen.select("class", F.col("chunk_id").cast(index.kind).alias("chunk_id")), "keyword-seen")
    searches = staged(searches.select("search", "class", "terms"), "keyword-searches")
    words = staged(searches.select(F.explode("terms").alias("term")).distinct(), "keyword-words")
    found, held, blocks = _gone_later(index, spark), None, []
    for number, rows in _of_words(index, spark, words):
        n, shares = rows.agg(F.sum("n"), F.max("shares")).first()
        if not n:
            continue
        many = min(shares, _power(n / BLOCK_POSTINGS))
        blocks += [(number, k, many) for k in range(many)]
        there = seen if found is None else seen.join(found.filter(F.col("gone_in") > number).select("chunk_id"), "chunk_id", "left_anti")
        place = lambda block: (F.lit(number).alias("generation"), block.cast("int").alias("block"))  # noqa: E731, B023
        part = rows.select(*place(F.pmod("share", F.lit(many))), F.lit(None).cast("bigint").alias("class"), "term", "tf", "chunk_ids")
        may = there.select(*place(_share(F.col("chunk_id"), many)), "class", F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"), F.array("chunk_id").alias("chunk_ids"))
        held = part.unionByName(may) if held is None else held.unionByName(part).unionByName(may)
    told = f"search bigint, chunk_id {index.kind}, score bigint"
    if held is None:
        return spark.createDataFrame([], told)
    kind = pa.int64() if index.kind == "bigint" else pa.string()
    keys = ["generation", "block"]
    rounds = sorted({_round(k, many) for _, k, many in blocks}, reverse=True)
    best, asked = None, searches.select("*", F.lit(1).cast("bigint").alias("bar"), F.lit(None).cast(index.kind).alias("last"))
    for r in rounds:
        some = [(g, k) for g, k, many in blocks if _round(k, many) == r]
        others = [(g, k) for g, k, many in blocks if _round(k, many) > r]
        named = lambda these: F.struct(*keys).isin([F.struct(F.lit(g).alias("generation"), F.lit(k).alias("block")) for g, k in these])
        wanted = named(some) if r else ~named(others) if others else F.lit(True)
        placed = F.broadcast(spark.createDataFrame(some, "generation int, block int"))  # by the postings, of millions each
        met = held.filter(wanted).groupBy(*keys).cogroup(asked.crossJoin(placed).groupBy(*keys)).applyInArrow(_block_searched(limit, kind), told)
        best = met if best is None else best.unionByName(met)
        if r:
            place = F.row_number().over(Window.partitionBy("search").orderBy(F.col("score").desc(), "chunk_id"))
            first = staged(best.withColumn("place", place).filter(F.col("place") <= limit), "keyword-first-blocks")
            bars = first.filter(F.col("place") == limit).select("search", F.col("score").alias("bar"), F.col("chunk_id").alias("last"))
            best, asked = first.drop("place"), searches.join(bars, "search", "left").withColumn("bar", F.coalesce("bar", F.lit(1).cast("bigint")))
    return best
