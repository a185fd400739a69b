"""Threads and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_blank, strip

DEFAULT_TITLE = "New chat"
ALL_GROUPS = ("Management", "HR", "Finance", "User")


def thread_list(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads with their number of messages, 0 included; sort by updated_at descending to show."""
    counts = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return threads.join(counts, "thread_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def thread_detail(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads with ``messages``: message_id, role, content, sources and created_at in the order of time; empty for threads without any."""
    said = F.struct("created_at", "message_id", "role", "content", "sources")
    listed = messages.groupBy("thread_id").agg(F.array_sort(F.collect_list(said)).alias("messages"))
    none = F.array().cast(listed.schema["messages"].dataType)
    return threads.join(listed, "thread_id", "left").withColumn("messages", F.coalesce("messages", none))


def auto_title(title: Column, first_question: Column, is_empty: Column) -> Column:
    """The first 50 characters of the question, with dots if there are more; for threads with a default or no title, or no messages."""
    short = F.when(F.length(first_question) > 50, F.concat(F.substring(first_question, 1, 50), F.lit("..."))).otherwise(first_question)
    return F.when(title.isNull() | ~not_blank(title) | (title == DEFAULT_TITLE) | is_empty, F.coalesce(short, title)).otherwise(title)


def append_turns(threads: DataFrame, messages: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the new messages; threads are touched at their newest message."""
    newest = turns.groupBy("thread_id").agg(F.max("created_at").alias("touched"))
    touched = threads.join(newest, "thread_id", "left").withColumn("updated_at", F.greatest("updated_at", "touched")).drop("touched")
    return touched, messages.unionByName(turns)


def rename(threads: DataFrame, names: DataFrame) -> DataFrame:
    """New titles, trimmed; blank ones change nothing."""
    return threads.join(names.select("thread_id", "new_title"), "thread_id", "left").withColumn("title", F.when(not_blank(F.col("new_title")), strip(F.col("new_title"))).otherwise(F.col("title"))).drop("new_title")


def delete(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Threads, or messages, without the deleted threads."""
    return rows.join(gone.select("thread_id").distinct(), "thread_id", "left_anti")


def latest_source(messages: DataFrame) -> DataFrame:
    """(thread_id, source): the first source of the last assistant message that has any."""
    cited = messages.filter((F.col("role") == "assistant") & (F.size("sources") > 0))
    return cited.groupBy("thread_id").agg(F.max_by(F.get("sources", F.lit(0)), F.struct("created_at", "message_id")).alias("source"))


def default_groups(groups: Column, role: Column) -> Column:
    return F.coalesce(groups, F.when(role == "admin", F.array(*[F.lit(g) for g in ALL_GROUPS])).otherwise(F.array(F.lit("User"))))
