"""The row that follows each row in an order over the whole table, without a group of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, staged


def with_next(rows: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """``rows`` with ``next_<c>`` for each carried column, taken from the row that comes next by ``order``; the last row's next is the first.

    Rows must differ in ``order``, which has nulls first. They are dealt out by ranges of it,
    each range's rows find their next among themselves, and the last one's is the first of the
    next range: of every range one row goes to a table as long as there are shuffle partitions.
    """
    dealt = staged(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id()), "succession")
    told = F.struct(*[F.col(c) for c in carried])
    by = [F.col(c).asc_nulls_first() for c in order]
    # The least struct has nulls first, as the order has.
    firsts = dealt.groupBy("part").agg(F.min(F.struct(*order, told.alias("first"))).alias("f")).select("part", "f.first")
    parts = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(parts)).alias("after"))
    found = dealt.withColumn("next", F.lead(told).over(Window.partitionBy("part").orderBy(*by))).join(after, "part")
    out = staged(found.select(*rows.columns, *[F.coalesce(F.col("next")[c], F.col("after")[c]).alias(f"next_{c}") for c in carried]), "succession-found")
    forget(dealt)
    return out
