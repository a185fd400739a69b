"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target gives its documents an expected number of copies. The whole part is
certain; the fractions are rounded by duels: two documents exchange mass, weighted by
their sizes so that the source's expected words stay what they are, until one of the two
is whole. The undecided document of every bucket goes on to the next level of a reduction
tree, so no task ever holds more than one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, SPACED_WORD, bare, forget, packed, row_key, staged, uniform, unpacked

#: Documents of one source that meet in a bucket of the tree, on average.
FAN_IN = 48
#: Equal rows that one task unfolds.
PART_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size): water-filling under the caps.

    Sources in code-point order, null last, take the weights in turn. Targets share the
    total size by weight, stop at ``max_epochs`` times their source's size, and the excess
    is shared again by weight. One row per source reaches the windows, however many
    documents there are.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    named = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        named.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("left_size", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("open_level", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    )
    water = F.first("open_level", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(water, F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", "source_size", "n_docs", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def _duel(first: Column, second: Column, seed: int, level: int) -> Column:
    """Two (key, two, size, mass) structs with mass in (0, 1): struct(done, open) after one exchange.

    Either the first gains what the second loses, or the reverse, in words; the odds keep
    both expectations. ``open`` is null when both become whole.
    """
    p, q, a, b = first["mass"], second["mass"], first["size"].cast("double"), second["size"].cast("double")
    up = F.least((1 - p) * a, q * b)  # words that the first can gain
    down = F.least(p * a, (1 - q) * b)  # words that it can lose
    gains = uniform(F.lit(seed), F.lit(level), first["key"], first["two"], second["key"], second["two"]) < down / (up + down)
    first_full, second_empty = (1 - p) * a <= q * b, (1 - p) * a >= q * b
    first_empty, second_full = p * a <= (1 - q) * b, p * a >= (1 - q) * b
    p_up, q_up = F.when(first_full, F.lit(1.0)).otherwise(p + up / a), F.when(second_empty, F.lit(0.0)).otherwise(q - up / b)
    p_down, q_down = F.when(first_empty, F.lit(0.0)).otherwise(p - down / a), F.when(second_full, F.lit(1.0)).otherwise(q + down / b)
    return F.struct(
        _with_mass(first, F.when(gains, p_up).otherwise(p_down)).alias("first"),
        _with_mass(second, F.when(gains, q_up).otherwise(q_down)).alias("second"),
    )


def _with_mass(item: Column, mass: Column) -> Column:
    return F.struct(item["key"].alias("key"), item["two"].alias("two"), item["size"].alias("size"), mass.alias("mass"))


def _whole(item: Column) -> Column:
    return (item["mass"] <= 0) | (item["mass"] >= 1)


def _fold(items: Column, kind: str, seed: int, level: int) -> Column:
    """Let a bucket's documents meet one after the other: struct(done array, open struct or null)."""
    none = F.lit(None).cast(kind)

    def step(acc: Column, item: Column) -> Column:
        met = _duel(acc["open"], item, seed, level)
        settled = F.filter(F.array(met["first"], met["second"]), _whole)
        left = F.filter(F.array(met["first"], met["second"]), lambda x: ~_whole(x))
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), item.alias("open"))).otherwise(F.struct(F.concat(acc["done"], settled).alias("done"), F.get(left, F.lit(0)).alias("open")))

    return F.aggregate(items, F.struct(F.array().cast(f"array<{kind}>").alias("done"), none.alias("open")), step)


def round_copies(fractions: DataFrame, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """(key, two, extra) with extra 0 or 1 from (source, key, two, size, mass): the reduction tree.

    Rows with mass 0 or 1, or of size 0, are whole at once. A source has n / fan_in buckets
    at a level and each passes on one document at most. (key, two) tells documents apart.
    """
    kind = "struct<key:bigint,two:bigint,size:bigint,mass:double>"
    item = F.struct(*[F.col(c).cast("long").alias(c) for c in ("key", "two", "size")], F.col("mass").cast("double").alias("mass"))
    whole = (F.col("mass") <= 0) | (F.col("mass") >= 1) | (F.col("size") <= 0)
    up = lambda is_up: F.when(is_up, 1).otherwise(0).alias("extra")
    decided = [fractions.filter(whole).select("key", "two", up(F.col("mass") >= 1))]
    current = fractions.filter(~whole).select("source", item.alias("item"))
    level = 0
    counts = current.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    buckets = counts.select("source", F.ceil(F.col("n") / fan_in).alias("buckets"))
    most = counts.agg(F.max("n")).first()[0] or 0
    while most > 1:
        buckets = staged(buckets, "mixing-buckets")
        dealt = current.join(F.broadcast(buckets) if buckets.count() <= 100_000 else buckets, current["source"].eqNullSafe(buckets["source"])).select(current["source"], F.pmod(F.xxhash64(F.lit(seed + level), "item.key", "item.two", "item.size"), F.col("buckets")).alias("bucket"), "item")
        met = dealt.groupBy("source", "bucket").agg(F.collect_list(F.struct((-F.col("item.size")).alias("o"), F.col("item.key").alias("k"), F.col("item.two").alias("t"), "item")).alias("items"))
        folded = staged(met.select("source", _fold(F.transform(F.array_sort("items"), lambda x: x["item"]), kind, seed, level).alias("f")), "mixing-level")
        decided.append(folded.select(F.explode("f.done").alias("d")).select("d.key", "d.two", up(F.col("d.mass") >= 1)))
        current = folded.filter("f.open is not null").select("source", F.col("f.open").alias("item"))
        counts = current.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        forget(buckets)
        buckets = counts.select("source", F.ceil(F.col("n") / fan_in).alias("buckets"))
        most, level = counts.agg(F.max("n")).first()[0] or 0, level + 1
    last = uniform(F.lit(seed), F.lit(-1), F.col("item.key"), F.col("item.two")) < F.col("item.mass")
    decided.append(current.select("item.key", "item.two", up(last)))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


INFO = ["size", "source_size", "target"]


def _mixed(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 7, fan_in: int = FAN_IN, part_rows: int = PART_ROWS) -> DataFrame:
    """The packed rows with size, source_size, target and copies."""
    size = F.regexp_count(F.coalesce(bare(text_col), F.lit("")), F.lit(SPACED_WORD)).cast("long")
    keyed = docs.select(packed(docs), *row_key(docs))
    thin = staged(docs.select(bare(source_col).alias("source"), size.alias("size"), *row_key(docs)), "mixing-sizes")
    targets = staged(source_targets(thin, weights, max_epochs), "mixing-targets")
    small = F.broadcast(targets) if targets.count() <= 100_000 else targets
    once = thin.groupBy("one", "two", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    # A rate within rounding of a whole number is that number.
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size"), 9)).otherwise(F.lit(0.0))
    expected = F.when(F.col("size") > 0, F.round(F.col("times") * rate, 7)).otherwise(F.lit(0.0))
    per_doc = once.join(small, once["source"].eqNullSafe(small["source"])).select(once["source"], "one", "two", "size", "times", "source_size", "target", expected.alias("expected"))
    per_doc = staged(per_doc, "mixing-documents")
    fractions = per_doc.select("source", F.col("one").alias("key"), "two", "size", (F.col("expected") - F.floor("expected")).alias("mass"))
    extra = round_copies(fractions, seed, fan_in).withColumnRenamed("key", "one")
    share = per_doc.join(extra, ["one", "two"]).select("one", "two", "size", "times", F.col("source_size").cast("long").alias("source_size"), "target", (F.floor("expected") + F.col("extra")).alias("sum"))
    share = staged(share, "mixing-shares")
    forget(thin, per_doc)
    out = keyed.join(share.filter("times = 1"), ["one", "two"]).select(ROW, *INFO, F.col("sum").alias("copies"))
    several = share.filter("times > 1")
    if not several.isEmpty():
        # Equal rows are counted, not told apart: one of them is unfolded again, in parts that are dealt out before.
        parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / part_rows)))
        firsts = keyed.join(several, ["one", "two"]).groupBy("one", "two", "times", "sum", *INFO).agg(F.first(ROW).alias(ROW))
        dealt = firsts.withColumn("part", parts).repartition("one", "two", "part")
        nth = F.explode(F.sequence(F.col("part") * part_rows, F.least("times", (F.col("part") + 1) * part_rows) - 1))
        each = dealt.select(ROW, *INFO, "times", "sum", nth.alias("nth"))
        copies = F.floor(F.col("sum") / F.col("times")) + F.when(F.col("nth") < F.col("sum") % F.col("times"), 1).otherwise(0)
        out = out.unionByName(each.select(ROW, *INFO, copies.alias("copies")))
    return out


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``size`` counts what stands between white space; a null or empty text has 0 and is never
    taken. A null source is a source of its own. Rows equal in all columns are one document
    that comes so many times: what they get together is rounded once and dealt out among
    them, so that they meet their target as different rows do. An empty table gives an empty one.
    """
    out = _mixed(docs, source_col, text_col, **options)
    return unpacked(out, docs.columns, {c: F.col(c) for c in INFO} | {"copies": F.col("copies").cast("int"), "taken": (F.col("copies") * F.col("size")).cast("long")})


def take_mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; columns unchanged."""
    mixed = _mixed(docs, source_col, text_col, **options)
    repeated = mixed.filter("copies > 0").select(ROW, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies").cast("bigint"))).alias("copy"))
    return repeated.select(*[F.col(ROW)[c].alias(c) for c in docs.columns])
