"""Context around hits, evidence and citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .predicates import ASKER, SEEN, may_see

START, END = "[[MATCH_START]]", "[[MATCH_END]]"
MOST_OVERLAP = 300
PLACEHOLDER = "{context_str}"


def neighbours(hits: DataFrame, chunks: DataFrame, kind: str, reach: int = 1, queries: DataFrame | None = None, as_of_year: int | None = None) -> DataFrame:
    """(query_id, hit_id, document_id, chunk_id, chunk_index, content) around each hit of (query_id, hit_id, document_id, chunk_index, page_number, section_title).

    Siblings by an equi-join on exploded indexes, so that a long document is not paired
    with itself; page and section by equi-join, where a null section meets none. With
    ``queries`` a neighbour must pass tenant, access and freshness as the hit did; without,
    give ``chunks`` that all who ask may see.
    """
    around = chunks.select("document_id", "chunk_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content", "page_number", "section_title", *(SEEN if queries is not None else ()))
    if kind == "siblings":
        near = hits.select("query_id", "hit_id", "document_id", F.explode(F.sequence(F.col("chunk_index").cast("int") - reach, F.col("chunk_index").cast("int") + reach)).alias("chunk_index"))
        joined = near.join(around, ["document_id", "chunk_index"])
    else:
        on = ["document_id", "page_number" if kind == "page" else "section_title"]
        joined = hits.select("query_id", "hit_id", *on).join(around, on)
    if queries is not None:
        joined = joined.join(queries.select("query_id", *ASKER), "query_id").filter(may_see(as_of_year))
    return joined.select("query_id", "hit_id", "document_id", "chunk_id", "chunk_index", "content")


def within_budget(contents: list[str], hit: int, budget: int) -> list[int]:
    """Places kept: right and left in turn from the hit, each side until its first misfit; the hit always stays."""
    used, kept = len(contents[hit]), [hit]
    sides = {1: hit + 1, -1: hit - 1}
    while sides and used < budget:
        for step in [s for s in (1, -1) if s in sides]:
            at = sides[step]
            if 0 <= at < len(contents) and used + len(contents[at]) <= budget:
                used += len(contents[at])
                kept.append(at)
                sides[step] = at + step
            else:
                del sides[step]
    return sorted(kept)


def merged(contents: list[str], hit: int) -> str:
    """Joined without the overlap of neighbours (line breaks where there is none), the hit between markers."""
    text, span = contents[0], (0, len(contents[0])) if hit == 0 else None
    for i, part in enumerate(contents[1:], 1):
        left, right = text.rstrip(), part.lstrip()
        shared = next((n for n in range(min(len(left), len(right), MOST_OVERLAP), 0, -1) if left.endswith(right[:n])), 0)
        begin = len(left) - shared if shared else len(text) + 1
        text = left + right[shared:] if shared else f"{text}\n{part}"
        if i == hit:
            span = (begin, begin + len(right if shared else part))
    return text if span is None else text[: span[0]] + START + text[span[0] : span[1]] + END + text[span[1] :]


def expand(hits: DataFrame, chunks: DataFrame, kind: str, reach: int = 1, max_tokens: int = 4000, queries: DataFrame | None = None, as_of_year: int | None = None) -> DataFrame:
    """(query_id, hit_id, content) with context; hits that nothing surrounds keep their content. Groups are single hits."""
    found = neighbours(hits, chunks, kind, reach, queries, as_of_year)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["chunk_index", "chunk_id"], ignore_index=True)
        contents, at = group["content"].tolist(), group.index[group["chunk_id"] == group["hit_id"]]
        if len(at):
            keep = within_budget(contents, int(at[0]), max_tokens * 3)
            text = merged([contents[i] for i in keep], keep.index(int(at[0])))
        else:
            text = merged(contents, -1)
        return pd.DataFrame({"query_id": group["query_id"][:1], "hit_id": group["hit_id"][:1], "expanded": [text]})

    out = found.groupBy("query_id", "hit_id").applyInPandas(fold, "query_id bigint, hit_id bigint, expanded string")
    return hits.join(out, ["query_id", "hit_id"], "left").select("query_id", "hit_id", F.coalesce("expanded", "content").alias("content"))


def without_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\[MATCH_(START|END)\]\]", "")


def evidence_block(place: Column, title: Column, section: Column, page: Column, content: Column) -> Column:
    return F.concat(F.lit("["), place.cast("string"), F.lit("] Title: "), title, F.lit(" (Section: "), F.coalesce(section, F.lit("N/A")), F.lit(", Page: "), F.coalesce(page.cast("string"), F.lit("N/A")), F.lit(")\nContent: "), without_markers(content), F.lit("\n"))


def evidence(hits: DataFrame) -> DataFrame:
    """(query_id, context): blocks of (rank, title, section_title, page_number, content), in order."""
    block = evidence_block(F.col("rank"), F.col("title"), F.col("section_title"), F.col("page_number"), F.col("content"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return listed.select("query_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n---\n").alias("context"))


def templates_for(askers: DataFrame, templates: DataFrame, default_tenant: str = "default", default_locale: str = "cs", locales: tuple[str, ...] = ("cs", "en")) -> DataFrame:
    """``askers`` (tenant, locale, ...) with ``template``: that of the tenant's base and the locale, else the default tenant's.

    ``templates``: (tenant, locale, template), a configuration table. The base of a tenant is
    what stands before its first dash; a locale that is not known counts as the default one.
    """
    known = F.broadcast(templates.groupBy("tenant", "locale").agg(F.max("template").alias("template")).withColumnsRenamed({"tenant": "t_tenant", "locale": "t_locale"}))  # configuration
    base = F.split(F.coalesce("tenant", F.lit(default_tenant)), "-")[0]
    locale = F.when(F.lower("locale").isin(*locales), F.lower("locale")).otherwise(default_locale)
    asked = askers.withColumn("_base", base).withColumn("_locale", locale)
    own = asked.join(known, (F.col("_base") == F.col("t_tenant")) & (F.col("_locale") == F.col("t_locale")), "left").withColumnRenamed("template", "_own").drop("t_tenant", "t_locale")
    rest = known.filter(F.col("t_tenant") == default_tenant).drop("t_tenant")
    both = own.join(rest, F.col("_locale") == F.col("t_locale"), "left")
    return both.select(*askers.columns, F.coalesce("_own", "template").alias("template"))


def answer_sources(hits: DataFrame) -> DataFrame:
    """(query_id, sources): what an answer was given, in order, from hits (query_id, rank, document_id, chunk_id, title, content, section_title, page_number, freshness_status, score, allowed_groups)."""
    fields = ["document_id", "chunk_id", "title", "content", "section_title", "page_number", "freshness_status", "score", "allowed_groups"]
    given = F.coalesce("allowed_groups", F.array().cast("array<string>")).alias("allowed_groups")
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*[given if f == "allowed_groups" else F.col(f) for f in fields]).alias("s")))).alias("l"))
    return listed.select("query_id", F.transform("l", lambda x: x["s"]).alias("sources"))


def prompt(template: Column, context: Column) -> Column:
    """The template with its placeholder filled, or with the context after it."""
    return F.when(F.contains(template, F.lit(PLACEHOLDER)), F.replace(template, F.lit(PLACEHOLDER), context)).otherwise(F.concat(template, F.lit("\n\n=== DOCUMENTS ===\n"), context, F.lit("\n")))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(message_id, place, source) for [n] and [Source n] in ``content``; numbers without a source are ignored."""
    cited = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[(?:Source )?([0-9]{1,6})\]"), F.lit(1)))
    places = answers.select("message_id", F.explode(cited).alias("n")).select("message_id", F.col("n").cast("int").alias("place"))
    return places.join(sources, ["message_id", "place"])


def strategy_label(strategy: Column) -> Column:
    return F.when(strategy == "vector", "vector_pgvector").when(strategy == "keyword", "keyword_fts").otherwise("hybrid_rrf")


def history(messages: DataFrame, turns: int = 6) -> DataFrame:
    """The last turns of every thread (thread_id, created_at, message_id)."""
    last = Window.partitionBy("thread_id").orderBy(F.col("created_at").desc(), F.col("message_id").desc())
    return messages.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= turns)


def highlighted_parts(text: Column) -> Column:
    """Array of (part, matched)."""
    pieces = F.split(text, r"\[\[MATCH_START\]\]|\[\[MATCH_END\]\]")
    return F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("part"), (i % 2 == 1).alias("matched"))), lambda x: strip(x["part"]) != "")
