"""Inferring document metadata: what surrounds a model's answer is deterministic, and so are the rules that stand in for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Month names in dates, relation types, and phrases that announce a relation.
MONTHS = "ledna|ledan|února|unora|března|brezna|dubna|května|kvetna|června|cervna|července|cervence|srpna|září|zari|října|rijna|listopadu|prosince"
DATE_LINE = rf"(?iu)\b\d{{1,2}}\.\s*\d{{1,2}}\.\s*\d{{4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}\.\s*(?:{MONTHS})\s*\d{{4}}\b"
RELATIONS = ("replaces", "modifies", "none")
RELATION_PHRASES = {"replaces": r"(?iu)\b(?:replaces|nahrazuje|ruší)\b", "modifies": r"(?iu)\b(?:modifies|amends|upravuje|doplňuje|mění)\b"}
STOP_WORDS = {"en": ("the", "and", "of", "to", "in", "is"), "fr": ("le", "la", "les", "de", "et", "un"), "de": ("der", "die", "und", "das", "in", "zu"), "es": ("el", "la", "los", "de", "que", "y"), "cs": ("a", "se", "na", "je", "že", "v")}


def date_candidates(text: Column, most: int = 5, around: int = 2) -> Column:
    """Lines with a date and the lines around them; the first ``most``."""
    # A line break at the end opens no line.
    lines = F.split(F.regexp_replace(text, r"\R\z", ""), r"\R")
    at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(DATE_LINE))
    first = F.slice(at, 1, most)
    return F.transform(first, lambda i: F.array_join(F.slice(lines, F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1), "\n"))


def first_date(snippet: Column) -> Column:
    """The first D.M.YYYY or ISO date of a snippet."""
    dotted = F.regexp_extract(snippet, r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})", 0)
    parts = [F.regexp_extract(snippet, r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})", k) for k in (3, 2, 1)]
    made = F.when(dotted != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")))
    iso = F.regexp_extract(snippet, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    return F.coalesce(made, F.when(iso != "", iso))


def release_date(answer: Column, metadata_date: Column, modified: Column, run_date: Column) -> Column:
    """An answer that is exactly a date, else the file's metadata, its modification time, the day of the run."""
    exact = F.when(answer.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(answer).cast("date"))
    return F.coalesce(exact, metadata_date, modified.cast("date"), run_date)


def category_for(answers: DataFrame, categories: DataFrame, fallback: str = "user") -> DataFrame:
    """``answers`` (document_id, answer) with the key of the first category that the answer names; blanks name none.

    categories: (ord, key, label, role) - a configuration table, put into one broadcast row.
    """
    listed = F.broadcast(categories.agg(F.array_sort(F.collect_list(F.struct("ord", F.lower("key").alias("lkey"), F.lower(F.coalesce("label", F.lit(""))).alias("llabel"), F.lower(F.coalesce("role", F.lit(""))).alias("lrole"), "key"))).alias("cats")))
    said = F.lower(F.trim("answer"))

    def fits(c: Column) -> Column:
        same = (c["lrole"] == said) | (c["lkey"] == said) | (c["llabel"] == said)
        part = (c["llabel"] != "") & (F.contains(c["llabel"], said) | F.contains(said, c["llabel"]))
        return (said != "") & (same | part)

    key = F.get(F.filter("cats", fits), F.lit(0))["key"]
    return answers.crossJoin(listed).select(*answers.columns, F.coalesce(key, F.lit(fallback)).alias("category_key"))


def category_by_keywords(words: DataFrame, keywords: DataFrame, fallback: str = "user") -> DataFrame:
    """(document_id, category_key) with the most keyword hits; (document_id, term) against (key, term), ties to the smaller key."""
    # The words are read once: those that no keyword meets count for no key, and keep their document in.
    hits = words.join(F.broadcast(keywords), "term", "left").groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("key").isNotNull(), F.struct((-F.col("n")).alias("n"), "key")))
    return hits.groupBy("document_id").agg(best.alias("b")).select("document_id", F.coalesce("b.key", F.lit(fallback)).alias("category_key"))


def parsed_relation(answer: Column) -> Column:
    """Struct of relationship_type, target_document_id, target_document_title; fences go, unknown and malformed answers are none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"\A```(?:json)?\n", ""), r"\n```\z", ""))
    raw = F.from_json(bare, "relationship_type string, target_document_id string, target_document_title string")
    known = F.coalesce(raw["relationship_type"].isin(*RELATIONS), F.lit(False))
    return F.struct(F.when(known, raw["relationship_type"]).otherwise("none").alias("relationship_type"), F.when(known, raw["target_document_id"]).alias("target_document_id"), F.when(known, raw["target_document_title"]).alias("target_document_title"))


def title_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits, underscores and hyphens that have a letter or a digit; what stands between them does not count."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_-]+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def titles_in(texts: DataFrame, keys: list[str], titles: DataFrame, within: list[str]) -> DataFrame:
    """(keys, at, end, and titles' columns) for every title (``title``, ...) whose words stand in a row in texts (keys, within, words).

    Titles may be of any length: the word runs of every length that a title has are joined
    with them by equality, so no text meets a title that it does not hold. A title that
    stands within a longer one is no find there. Texts and titles meet if they agree in
    the columns ``within``.
    """
    known = titles.withColumn("_words", title_words(F.col("title"))).filter(F.size("_words") > 0).withColumn("_run", F.array_join("_words", " "))
    lengths = sorted(r[0] for r in known.select(F.size("_words")).distinct().collect())  # as many as words in the longest title at most
    if not lengths:
        lengths = [1]
    each = F.explode(F.array(*map(F.lit, lengths)))
    sized = texts.select(*keys, *within, "words", each.alias("_n")).filter(F.size("words") >= F.col("_n"))
    placed = sized.select(*keys, *within, "words", "_n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("_n") + 1)).alias("at"))
    runs = placed.select(*keys, *[F.col(c).alias(f"_of_{c}") for c in within], "at", (F.col("at") + F.col("_n")).alias("end"), F.array_join(F.slice("words", F.col("at"), F.col("_n")), " ").alias("_run"))
    met = runs.join(known.drop("_words"), "_run")
    for c in within:
        met = met.filter(F.col(f"_of_{c}").eqNullSafe(F.col(c)))
    before = Window.partitionBy(*keys).orderBy("at", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    span = lambda: F.struct("end", -F.col("at"))
    return met.withColumn("_wider", F.max(span()).over(before)).filter(F.col("_wider").isNull() | (F.col("_wider") <= span())).drop("_wider", "_run", *[f"_of_{c}" for c in within])


def relations_by_rule(sentences: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_document_id, relationship_type, target_document_id) where a sentence has a phrase and, later, an earlier document's title.

    Titles are found as ``titles_in`` finds them, of any length and whatever their
    punctuation. Documents with a tenant_id relate within their tenant.
    """
    found = None
    for kind, phrase in RELATION_PHRASES.items():
        rest = title_words(F.regexp_replace("sentence", rf"(?s)^.*?{phrase.removeprefix('(?iu)')}", ""))
        part = sentences.filter(F.col("sentence").rlike(phrase)).select("document_id", F.lit(kind).alias("relationship_type"), rest.alias("words"))
        found = part if found is None else found.unionByName(part)
    tenant = ["tenant_id"] if "tenant_id" in documents.columns else []
    order = documents.select("document_id", "date_order", *tenant)
    said = found.distinct().join(order, "document_id").withColumn("sentence", F.xxhash64("words"))
    targets = documents.select(F.col("document_id").alias("target_document_id"), "title", F.col("date_order").alias("target_order"), *tenant)
    hits = titles_in(said, ["document_id", "date_order", "relationship_type", "sentence"], targets, tenant)
    return hits.filter("target_order < date_order").select(F.col("document_id").alias("source_document_id"), "relationship_type", "target_document_id").distinct()


def language_answer(answer: Column, default: str = "cs") -> Column:
    said = F.lower(F.trim(answer))
    return F.when(said.isin("cs", "en"), said).otherwise(default)


def language_by_stop_words(words: Column) -> Column:
    """The language most of whose stop words occur; ties go to the first in order."""
    scored = F.array(*[F.struct(F.size(F.filter(words, _in(stops))).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, stops) in enumerate(STOP_WORDS.items())])
    return F.array_max(scored)["lang"]


def _in(stops: tuple[str, ...]):
    return lambda w: w.isin(*stops)


def page_texts(pages: DataFrame) -> DataFrame:
    """(document_id, excerpt, full_text): the first two pages, and all, in order."""
    listed = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    texts = F.transform("p", lambda x: x["text"])
    return listed.select("document_id", F.array_join(F.slice(texts, 1, 2), "\n").alias("excerpt"), F.array_join(texts, "\n").alias("full_text"))


def chronological(documents: DataFrame, date_text: Column) -> DataFrame:
    """``date_order`` within a tenant: by date, what is no date first, then by id.

    Documents are numbered within their day, and the days' numbers summed up, so that a tenant is no task's group.
    """
    day = F.try_to_timestamp(date_text, F.lit("yyyy-MM-dd")).cast("date")
    dated = documents.withColumn("_day", day)
    sizes = dated.groupBy("tenant_id", "_day").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("tenant_id").orderBy(F.col("_day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col("tenant_id").alias("_tenant"), F.col("_day").alias("_of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    numbered = dated.withColumn("_at", F.row_number().over(Window.partitionBy("tenant_id", "_day").orderBy("document_id")))
    joined = numbered.join(firsts, F.col("tenant_id").eqNullSafe(F.col("_tenant")) & F.col("_day").eqNullSafe(F.col("_of")))
    return joined.select(*documents.columns, (F.col("_before") + F.col("_at")).alias("date_order"))


def relation_candidates(documents: DataFrame) -> DataFrame:
    """(document_id, title) of the documents that a new one may replace or modify: the current ones."""
    return documents.filter("freshness_status = 'current'").select("document_id", "title")
