"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to blocks by a hash of their values and of the number that tells equal
rows apart, so copies spread like any other rows. How many rows of a block go to a shard follows the
multivariate hypergeometric law of a uniform shuffle, so the shards' sizes are exact. Each
block permutes its rows and cuts them by its line of the matrix; each shard permutes what
it receives. Neither a block nor a shard is ever one task's unbounded group: both are
permuted in pieces whose first ranks are summed up. All this moves row keys; whole rows
are joined to their places at the end.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, forget, packed, row_key, staged, unpacked

#: Rows of a block, on average, until there are MAX_BLOCKS lines of the matrix; from then on blocks grow, and are permuted in more pieces.
BLOCK_ROWS, MAX_BLOCKS = 20_000, 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement; inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left, up, down, p_up, p_down = rng.random() - at_mode, mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) / (up + 1) * (draws - up) / (bad - draws + up + 1)
            up, left = up + 1, left - p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * (bad - draws + down) / (draws - down + 1)
            down, left = down - 1, left - p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows of each block for each shard; margins are exactly as given."""
    rng, left, lines = random.Random(seed), list(shard_rows), []
    for rows in block_rows:
        line, open_rows, pool = [], rows, sum(left)
        for room in left:
            n = hypergeometric(rng, room, pool - room, open_rows)
            line.append(n)
            open_rows, pool = open_rows - n, pool - room
        left = [a - b for a, b in zip(left, line, strict=True)]
        lines.append(line)
    return lines


def numbered_copies(counted: DataFrame, part_rows: int) -> DataFrame:
    """(one, two, copy): each of the n rows of (one, two, n) by its number from 0.

    A row that repeats very often is unfolded in parts of ``part_rows``, which are dealt out
    before, so that no row's copies are one task's.
    """
    n = F.col("n")
    parts = counted.select("one", "two", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / part_rows))).alias("part"))
    dealt = staged(parts.repartition("one", "two", "part"), "sharding-parts")
    ends = F.least(n, (F.col("part") + 1) * part_rows) - 1
    return dealt.select("one", "two", F.explode(F.sequence(F.col("part") * part_rows, ends)).alias("copy"))


def _ranked(rows: DataFrame, groups: list[str], pieces: int, name: str, label: str, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``name``: 0, 1, ... in the order of the 64-bit hash ``by`` within the groups; and the staged rows that it reads.

    A group is ranked in pieces, each a range of the hash and one task's work, whose first ranks are summed up.
    """
    piece = F.floor(F.shiftrightunsigned(by, 11) / F.lit(float(1 << 53)) * pieces).cast("int")
    keys = [*groups, "piece"]
    # Unsigned order of the hash, as the pieces have it.
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.shiftrightunsigned(by, 1), F.col(by), *order))
    inside = staged(rows.withColumn("piece", piece).withColumn("at", at), label)
    sizes = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*groups).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(k).alias(f"s_{k}") for k in keys], before.alias("first"))
    joined = inside.join(starts, [F.col(k) == F.col(f"s_{k}") for k in keys])
    return joined.select(*rows.columns, (F.col("first") + F.col("at") - 1).alias(name)), inside


def placements(counted: DataFrame, total: int, shards: int, seed: int, block_rows: int) -> DataFrame:
    """(one, two, copy, shard, slot) for each of the n rows of (one, two, n): the shuffle on row keys alone."""
    spark, copy = counted.sparkSession, ["one", "two", "copy"]
    hashes = [F.xxhash64(F.lit(seed + k), *copy).alias(c) for k, c in enumerate(("draw", "place", "tie"))]
    blocks = max(1, min(MAX_BLOCKS, total // block_rows))
    rows = numbered_copies(counted, block_rows).select(*copy, *hashes).withColumn("block", F.pmod(F.col("tie"), F.lit(blocks)).cast("int"))
    ranked, in_blocks = _ranked(rows, ["block"], max(1, total // blocks // block_rows), "rank", "sharding-ranked", "draw", ["tie", "place"])
    counts = {r["block"]: r["count"] for r in in_blocks.groupBy("block").count().collect()}  # MAX_BLOCKS rows at most
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], [total // shards + (s < total % shards) for s in range(shards)], seed)
    lines = [(b, list(accumulate(line))) for b, line in enumerate(matrix)]
    lines = F.broadcast(spark.createDataFrame(lines, "block int, ends array<bigint>"))  # MAX_BLOCKS lines of `shards` numbers at most
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int")
    sent = ranked.join(lines, "block").select(*copy, "place", "tie", "draw", shard.alias("shard"))
    slotted, in_shards = _ranked(sent, ["shard"], max(1, total // shards // block_rows), "slot", "sharding-placed", "place", ["tie", "draw"])
    forget(in_blocks)
    return slotted.select(*copy, "shard", F.col("slot").cast("long").alias("slot"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard).

    Shards' row counts differ by one at most. The order depends on the rows' values and the
    seed alone. Rows equal in all columns are one row with a count until the end: a whole
    row moves once, to where its places are. Nulls are values like any other, an empty table
    gives an empty one, and outputs replace input columns of their name.
    """
    keyed = docs.select(packed(docs), *row_key(docs))
    counted = staged(keyed.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")), "sharding-counted")
    total, repeated = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = placements(counted, total, shards, seed, block_rows)
    if repeated > 1:
        # The same value under the same key, whichever row of several it is taken from.
        keyed = keyed.groupBy("one", "two").agg(F.first(ROW).alias(ROW))
    placed = placed.select("one", "two", F.floor(F.col("copy") / block_rows).alias("part"), "shard", "slot")
    out = keyed.join(placed.filter("part = 0"), ["one", "two"]).select(ROW, "shard", "slot")
    if repeated > block_rows:
        # Copies of one row beyond the first part meet it part by part; so frequent are total / block_rows rows at most.
        many = counted.filter(F.col("n") > block_rows).select("one", "two", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor((F.col("n") - 1) / block_rows))).alias("part"))
        out = out.unionByName(keyed.join(many, ["one", "two"]).join(placed, ["one", "two", "part"]).select(ROW, "shard", "slot"))
    return unpacked(out, docs.columns, {"shard": F.col("shard"), "slot": F.col("slot")})
