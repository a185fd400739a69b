"""Exact nearest vectors by pivots: blocks that cannot hold a better one are passed over.

Every vector lies near one of a bounded number of pivots, at an angle to it. A block is a
pivot's vectors of one band of angles. Angles obey the triangle inequality, so the pivot's
angle to a query and the band bound every cosine of the block. A first pass looks into each
query's most promising blocks; its limit-th score is what a block must be able to reach, and
a second pass looks into the others that can. What is skipped depends on the data: vectors in
clusters leave most blocks out, vectors that are spread evenly over many dimensions none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import mark, staged

#: Pivots at most, and vectors of a pivot or part of a block (on average).
PIVOTS, BLOCK_ROWS = 1024, 1024
#: Angles of one band differ by so many radians at most.
BAND = 0.1
#: Vectors that the first pass looks at, for each place of the list, and at least one in so many of all; queries whose scores are worked out together.
DEPTH, FIRST_SHARE, TOGETHER = 8, 16, 64
DECIMALS = 6
#: Rounding of scores and bounds never hides a block.
MARGIN = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    """Where ``rows`` (pivot, band, part, chunk_id, unit), ``pivots`` (pivot, unit) and ``blocks`` (pivot, band, low, high, n, parts) are."""

    folder: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def units(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(float)
    return matrix / np.where((n := np.linalg.norm(matrix, axis=1, keepdims=True)) > 0, n, 1)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def build(index: VectorIndex, chunks: DataFrame, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, part_rows: int | None = None) -> None:
    """Index the chunks (chunk_id, embedding) that have a vector, a pivot for each ``block_rows`` of them; blocks are dealt to parts of ``part_rows``. A zero vector is at a right angle to all."""
    spark = chunks.sparkSession
    held = chunks.filter("embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = min(pivots, max(1, held.count() // block_rows))
    # The pivots are the vectors of the smallest hashes; at most ``pivots`` of them come to the driver and go to the tasks.
    chosen = held.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).toPandas()
    kind = held.schema["chunk_id"].dataType.simpleString()
    centre = units(chosen["embedding"]) if len(chosen) else np.zeros((0, 0))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centre)], "pivot int, unit array<double>").write.mode("overwrite").parquet(f"{index.folder}/pivots")

    def placed(batches):
        for batch in batches:
            if not len(batch):
                continue
            unit = units(batch["embedding"])
            cosines = unit @ centre.T
            nearest = cosines.argmax(1)
            angle = _angles(cosines[np.arange(len(unit)), nearest])
            yield pd.DataFrame({"pivot": nearest.astype(np.int32), "band": np.floor(angle / BAND).astype(np.int32), "angle": angle, "chunk_id": batch["chunk_id"].to_numpy(), "unit": list(unit)})

    rows = held.mapInPandas(placed, f"pivot int, band int, angle double, chunk_id {kind}, unit array<double>")
    rows = staged(rows, "vector-rows")
    blocks = rows.groupBy("pivot", "band").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("parts", F.ceil(F.col("n") / (part_rows or block_rows)).cast("int"))
    blocks.write.mode("overwrite").parquet(f"{index.folder}/blocks")
    sized = F.broadcast(index.table(spark, "blocks").select("pivot", "band", "parts"))  # pivots times bands at most
    dealt = rows.join(sized, ["pivot", "band"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
    dealt.select("pivot", "band", "part", "chunk_id", "unit").write.mode("overwrite").parquet(f"{index.folder}/rows")
    mark(spark, f"{index.folder}/_whole")


def block_bounds(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """(query_id, pivot, band, n, parts, bound) of every block, for asked (query_id, class, unit); the blocks are pivots times bands at most."""
    spark = asked.sparkSession
    pivots = index.table(spark, "pivots").orderBy("pivot").toPandas()
    blocks = index.table(spark, "blocks").orderBy("pivot", "band").toPandas()
    kind = asked.schema["query_id"].dataType.simpleString()
    centre = np.stack(pivots["unit"].to_numpy()) if len(pivots) else np.zeros((0, 0))
    of, low, high = blocks["pivot"].to_numpy(), blocks["low"].to_numpy(), blocks["high"].to_numpy()

    def bounded(batches):
        for batch in batches:
            for at in range(0, len(batch) if len(blocks) else 0, 256):
                some = batch.iloc[at : at + 256]
                to_pivot = _angles(units(some["unit"]) @ centre.T)[:, of]
                apart = np.maximum(0, np.maximum(low - to_pivot, to_pivot - high))
                q, b = np.indices(apart.shape).reshape(2, -1)
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[q], "pivot": of[b], "band": blocks["band"].to_numpy()[b], "n": blocks["n"].to_numpy()[b], "parts": blocks["parts"].to_numpy()[b], "bound": np.cos(apart[q, b])})

    return asked.select("query_id", "unit").mapInPandas(bounded, f"query_id {kind}, pivot int, band int, n bigint, parts int, bound double")


def nearest_in(limit: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of one part of a block: each query's ``limit`` best of the chunks that its class may see, by rounded score and chunk_id, from its ``bar`` on."""

    def nearest(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(some) and len(held):
            held = held.sort_values("chunk_id", ignore_index=True)
            vectors, ids = np.stack(held["unit"].to_numpy()), held["chunk_id"].to_numpy()
            seen_by = held["classes"].to_numpy()
            for cls, askers in some.groupby("class"):
                there = np.array([cls in s for s in seen_by])
                if not there.any():
                    continue
                seen, seen_ids = vectors[there], ids[there]
                most = min(limit, len(seen))
                for at in range(0, len(askers), TOGETHER):
                    few = askers.iloc[at : at + TOGETHER]
                    scores = (np.stack(few["unit"].to_numpy()) @ seen.T).round(DECIMALS)
                    # The limit-th best score of each query; what equals it is kept too, and cut by chunk_id, which is the order of the columns.
                    bar = np.maximum(-np.partition(-scores, most - 1, axis=1)[:, most - 1 : most], few["bar"].to_numpy()[:, None])
                    q, c = np.nonzero(scores >= bar)
                    order = np.lexsort((c, -scores[q, c], q))
                    q, c = q[order], c[order]
                    kept = np.arange(len(q)) - np.searchsorted(q, q, side="left") < most
                    q, c = q[kept], c[kept]
                    parts.append(pd.DataFrame({"query_id": few["query_id"].to_numpy()[q], "chunk_id": seen_ids[c], "score": scores[q, c]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "chunk_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})

    return nearest


def nearest_visible(index: VectorIndex, asked: DataFrame, seen: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score) that hold every query's ``limit`` best chunks, and the blocks (query_id, pivot, band, n, bound, read).

    ``asked``: (query_id, class, vector); ``seen``: (chunk_id, classes), the classes of queries that
    may see a chunk. A vector goes to the tasks of its block once, however many classes there are.
    """
    spark = asked.sparkSession
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("vector", lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))
    asked = staged(asked.select("query_id", "class", unit.alias("unit")), "vector-asked")
    bounds = staged(block_bounds(index, asked), "vector-bounds")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "pivot", "band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held_rows = index.table(spark, "blocks").agg(F.sum("n")).first()[0] or 0
    ordered = staged(bounds.withColumn("first", before < max(DEPTH * limit, held_rows // FIRST_SHARE)), "vector-order")
    rows = index.table(spark, "rows")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, score double"
    held = rows.join(seen, "chunk_id").select("pivot", "band", "part", "chunk_id", "unit", "classes")
    keys = ["pivot", "band", "part"]

    def looked_into(pairs: DataFrame) -> DataFrame:
        spread = pairs.select("query_id", "pivot", "band", "bar", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(asked, "query_id")
        needed = held.join(spread.select(*keys).distinct(), keys, "left_semi")
        return spread.groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInPandas(nearest_in(limit), kinds)

    met = staged(looked_into(ordered.filter("first").withColumn("bar", F.lit(-2.0))), "vector-first")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    bar = met.withColumn("place", place).filter(F.col("place") == limit).select("query_id", F.col("score").alias("bar"))
    judged = ordered.join(bar, "query_id", "left").withColumn("read", F.col("first") | F.col("bar").isNull() | (F.col("bound") + MARGIN >= F.col("bar")))
    judged = staged(judged, "vector-judged")
    more = looked_into(judged.filter("read and not first").withColumn("bar", F.coalesce("bar", F.lit(-2.0))))
    return met.unionByName(more), judged.select("query_id", "pivot", "band", "n", "bound", "read")
