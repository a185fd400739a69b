"""Registered queries of the search library, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions import text as T
from ..operators import chunking as C
from ..operators import context as X
from ..operators import conversations as V
from ..operators import governance as U
from ..operators import ingest as I
from ..operators import jobs as J
from ..operators import keyword_index as K
from ..operators import passages as L
from ..operators import predicates as P
from ..operators import retrieval as R
from ..operators import tagging as G
from ..sources import store
from . import binding as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _csv(array) -> F.Column:
    return F.array_join(array, ",")


_STRIPPED = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
USERS = "(values ('management', ['Management']), ('hr', ['HR']), ('nobody', [])) as u(who, groups)"


def _users(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([("management", ["Management"]), ("hr", ["HR"]), ("nobody", [])], "who string, groups array<string>"))  # three rows


# ---- predicates --------------------------------------------------------------------------


@query(f"""with {B.D} select document_id, who,
 coalesce(tenant_id in ('acme-prod', 'acme'), false) as tenant_ok,
 list_contains(groups, 'Management') or coalesce(list_has_any(acl, list_concat(groups, ['User'])), false) as strict_ok,
 acl is null or len(acl) = 0 or list_contains(acl, 'User') or list_contains(groups, 'Management') or list_has_any(acl, groups) as lenient_ok,
 freshness_status = 'current' as latest_ok, year(created_at) = {B.AS_OF_YEAR} as this_year_ok
 from d, {USERS}""")
def p1_access_and_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = B.documents(spark, sf_dir).crossJoin(_users(spark))  # three users
    fresh = lambda mode: P.fresh_enough(F.lit(mode), F.col("freshness_status"), F.col("created_at"), B.AS_OF_YEAR)
    return pairs.select("document_id", "who", P.tenant_matches(F.col("tenant_id"), F.lit("acme-prod")).alias("tenant_ok"), P.acl_strict(F.col("acl"), F.col("groups")).alias("strict_ok"), P.acl_lenient(F.col("acl"), F.col("groups")).alias("lenient_ok"), fresh("latest").alias("latest_ok"), fresh("this_year").alias("this_year_ok"))


@query(f"""with {B.D} select document_id, language = 'en' and department = 'hr' as fits, coalesce(acl_csv, 'User') as asked from
 (select document_id, language, department, case when acl_csv = '' then '' else acl_csv end as acl_csv from d)""")
def p5_metadata_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    asked = P.cleaned_filters(F.create_map(F.lit("language"), F.lit("en"), F.lit("department"), F.lit("hr"), F.lit("freshness_filter"), F.lit("all"), F.lit("final_limit"), F.lit("3"), F.lit("additionalProp1"), F.lit("{}"), F.lit("empty"), F.lit(None).cast("string")))
    columns = F.create_map(F.lit("language"), F.col("language"), F.lit("document_type"), F.col("document_type"))
    return docs.select("document_id", P.metadata_matches(asked, columns, F.col("metadata")).alias("fits"), _csv(T.comma_list(F.col("acl_csv"))).alias("asked"))


@query(f"""with {B.D} select document_id,
 language = 'en' and source_folder = 'src3' and year(created_at) = {B.AS_OF_YEAR} as filtered,
 contains(lower(title), 'oc_1') or contains(lower(document_type), 'oc_1') or contains(lower(source_folder), 'oc_1') as searched from d""")
def p8_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    fits = P.library_matches(F.col("language"), F.col("metadata")["source_folder"], F.col("freshness_status"), F.year("created_at"), F.lit("en"), F.lit("src3"), F.lit("this_year"), B.AS_OF_YEAR)
    return docs.select("document_id", fits.alias("filtered"), P.library_search(F.lit(" OC_1 "), F.col("title"), F.col("document_type"), F.col("source_folder")).alias("searched"))


# ---- sources and ingest ------------------------------------------------------------------


@query(f"""with {B.D} select document_id,
 array_to_string(list_filter(list_transform(string_split(replace(text, '. ', '. ' || chr(10) || chr(10) || '  '), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) as cleaned from d""")
def s3_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.replace(F.col("text"), F.lit(". "), F.lit(". \n\n  "))
    return B.documents(spark, sf_dir).select("document_id", T.clean_page(spread).alias("cleaned"))


@query(f"""with {B.D} select document_id, sha256(text) as checksum, concat(source_folder, '/doc_', document_id, '.txt') as path,
 concat('doc_', document_id) as title, source_folder as folder, 'document' as kind, concat('doc_', document_id, 'txt.') as safe from d""")
def i1_paths_and_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    full = F.concat(F.lit("C:\\x/data/"), F.regexp_replace(I.uri_path(F.col("source_uri")), "/", "\\\\"))
    path = I.relative_path(full)
    return docs.select("document_id", I.checksum(F.col("text")).alias("checksum"), path.alias("path"), I.title_of(path).alias("title"), I.folder_metadata(path)["source_folder"].alias("folder"), I.type_of(path).alias("kind"), I.safe_name(F.concat(F.lit(" ("), F.col("title"), F.lit(") t*x/t."))).alias("safe"))


def _incoming(docs: DataFrame) -> DataFrame:
    text = F.when(F.col("document_id") % 10 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    return docs.withColumn("text", text).withColumn("checksum", I.checksum(text))


@query("""select doc_id as document_id, case when doc_id % 10 >= 8 then 'new' when doc_id % 10 = 0 then 'changed' else 'unchanged' end as change from documents""")
def i4_change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    existing = docs.filter("document_id % 10 < 8").select("document_id", F.replace("source_uri", F.lit("file://"), F.lit("azure://box/")).alias("source_uri"), I.checksum(F.col("text")).alias("checksum"))
    return I.classify(_incoming(docs).select("document_id", "source_uri", "checksum"), existing).select("document_id", "change")


@query(f"""with {B.D} select document_id, case when document_id % 10 in (0, 8, 9) then language when document_id % 3 = 0 then 'xx' else language end as language,
 length(text) + case when document_id % 10 = 0 then 3 else 0 end as size from d""")
def i5_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir).select("document_id", "source_uri", "language", "text")
    stored = docs.filter("document_id % 10 < 8")
    found = I.classify(_incoming(docs), stored.withColumn("checksum", I.checksum(F.col("text"))))
    updates = found.filter("change = 'unchanged'").select("document_id", F.when(F.col("document_id") % 3 == 0, "xx").alias("language"))
    kept = I.refreshed(stored, updates, ("language",))
    fresh = found.filter("change <> 'unchanged'").select("document_id", "source_uri", "language", "text")
    return I.replaced(kept, found.filter("change = 'changed'"), fresh).select("document_id", "language", F.length("text").cast("bigint").alias("size"))


@query(f"""with {B.D}, {B.C} select chunk_id, case when document_id % 3 = 0 then 'xx' else language end as language, case when document_id % 3 = 1 then 'HR,User' else acl_csv end as acl,
 case when document_id % 3 = 2 then 'new' else department end as department from c""")
def i5_refreshed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of unchanged documents take new values of language, list of groups and metadata where there are any."""
    docs, n = B.documents(spark, sf_dir).select("document_id", "language", "acl", "metadata"), F.col("document_id")
    updates = docs.select("document_id", F.when(n % 3 == 0, "xx").alias("language"), F.when(n % 3 == 1, F.array(F.lit("HR"), F.lit("User"))).alias("acl"), F.when(n % 3 == 2, F.create_map(F.lit("department"), F.lit("new"))).alias("metadata"))
    stored = B.chunks(spark, sf_dir).select("document_id", "chunk_id").join(docs, "document_id")
    out = I.refreshed(stored, updates, ("language", "acl", "metadata"))
    return out.select("chunk_id", "language", _csv(F.col("acl")).alias("acl"), F.col("metadata")["department"].alias("department"))


@query(f"""with {B.D} select document_id, case when contains(title, '_15') then 'archived' else 'current' end as freshness_status,
 case when contains(title, '_15') then 'Management' when contains(title, '7') then 'HR' else 'Public' end as department from d""")
def i9_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(0, "_15", ["Management"], "archived", "Management"), (1, "7", ["HR"], "current", "HR"), (2, None, ["User"], "current", "Public")], "ord int, needle string, acl array<string>, freshness_status string, department string")
    return I.by_rules(B.documents(spark, sf_dir).select("document_id", "title"), rules, F.col("title")).select("document_id", "freshness_status", "department")


def _files(docs: DataFrame) -> DataFrame:
    """Documents as files of a folder; every ninth has no metadata and no list of groups."""
    none = F.col("document_id") % 9 == 0
    path = F.concat(F.lit("/srv/data/"), F.col("source_folder"), F.lit("/doc_"), F.col("document_id"), F.lit(".txt"))
    said = F.create_map(F.lit("created_at"), F.col("created_at").cast("string"), F.lit("n"), F.col("document_id").cast("string"))
    return docs.select(path.alias("path"), "tenant_id", F.col("text").alias("content"), F.when(~none, said).alias("metadata"), F.when(~none, F.col("acl")).alias("acl"), "language", F.when(~none, F.col("freshness_status")).alias("freshness_status"))


_ROWS = """r as (select sha256(source_uri2) as document_id, source_uri2 as source_uri, title, 'document' as document_type, language, case when document_id % 9 = 0 then timestamp '2026-02-03 04:05:06' else cast(created_at as timestamp) end as created_at,
 case when document_id % 9 = 0 then 'current' else freshness_status end as freshness_status, sha256(text) as checksum, case when document_id % 9 = 0 or acl_csv is null then 'Public' else acl_csv end as acl, text, document_id as n
 from (select *, concat('file://', source_folder, '/doc_', document_id, '.txt') as source_uri2 from d))"""
RUN_TIME = "2026-02-03 04:05:06"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.document_rows(_files(B.documents(spark, sf_dir)), F.lit(RUN_TIME).cast("timestamp"))


@query(f"with {B.D}, {_ROWS} select document_id, source_uri, title, document_type, language, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created, freshness_status, checksum, acl from r")
def i7_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("document_id", "source_uri", "title", "document_type", "language", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "freshness_status", "checksum", _csv(F.col("acl")).alias("acl"))


@query(f"""with {B.D}, {_ROWS}, {B.C} select sha256(concat(r.document_id, '#', chunk_index)) as chunk_id, r.language, r.acl, r.freshness_status, sha256(content) as content_hash from c join r on r.n = c.document_id""")
def i8_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("file://"), F.col("source_folder"), F.lit("/doc_"), F.col("document_id"), F.lit(".txt"))
    texts = B.documents(spark, sf_dir).select(F.sha2(uri, 256).alias("document_id"), "text")
    cut = C.character_windows(texts, B.SIZE, B.OVERLAP).select("document_id", "chunk_index", "content", F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section_title"))
    return I.chunk_rows(cut, _stored(spark, sf_dir)).select("chunk_id", "language", _csv(F.col("acl")).alias("acl"), "freshness_status", "content_hash")


@query(f"""with {B.D}, q as (select distinct 'api' as source_type, source_uri, title, document_type, language, text as content, acl_csv from d)
 select sha256(content) as checksum, title, language, acl_csv as acl, 0 as chunk_index, content, 'current' as freshness_status from q""")
def s5_direct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document sent in as a request, twice."""
    asked = B.documents(spark, sf_dir).select(F.lit("api").alias("source_type"), "source_uri", "title", "document_type", "language", "acl", "metadata", F.col("text").alias("content"))
    documents, chunks = J.direct_records(asked.unionByName(asked), F.lit(RUN_TIME).cast("timestamp"))
    both = documents.select("document_id", "checksum", "title").join(chunks, "document_id")
    return both.select("checksum", "title", "language", _csv(F.col("acl")).alias("acl"), "chunk_index", "content", "freshness_status")


@query(f"""with {B.D}, {B.C}, f as (select document_id, language, acl_csv, document_id % 10 <> 3 as there, case when document_id % 10 = 4 then '' else text end as now from d),
 k as (select document_id, language, acl_csv, j, {_STRIPPED.format("substr(now, cast(j * 600 + 1 as bigint), 600)")} as content from (
  select *, unnest(range(0, cast(greatest(0, ceil((length(now) - 600) / 600.0)) as bigint) + 1)) as j from f where there)),
 fresh as (select document_id, row_number() over (partition by document_id order by j) - 1 as chunk_index, language, acl_csv, content from k where content <> '')
 select document_id, chunk_index, language, acl_csv as acl, sha256(content) as digest from fresh
 union all select document_id, chunk_index, 'old', 'old', sha256(content) from c where document_id not in (select document_id from fresh)""")
def i14_rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks against files: one in ten is missing, one is empty, one has moved to another folder."""
    docs, n = B.documents(spark, sf_dir), F.col("document_id")
    old = B.chunks(spark, sf_dir).select("document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content", F.lit("old").alias("language"), F.array(F.lit("old")).alias("acl"))
    folder = F.when(n % 10 == 5, "moved").otherwise(F.col("source_folder"))
    pages = docs.filter(n % 10 != 3).select(F.concat(F.lit("/srv/data/"), folder, F.lit("/doc_"), n, F.lit(".txt")).alias("path"), F.lit(1).alias("page_number"), F.when(n % 10 == 4, "").otherwise(F.col("text")).alias("text"))
    out = J.rechunked(docs, old, pages, lambda t: C.window_pieces(t, 600, 0))
    return out.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "language", _csv(F.col("acl")).alias("acl"), F.sha2("content", 256).alias("digest"))


# ---- chunking ----------------------------------------------------------------------------


@query(f"with {B.D}, {B.C} select document_id, cast(chunk_index as bigint) as chunk_index, cast(start as bigint) as start, content from c")
def c1_character_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chunks(spark, sf_dir).select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("start").cast("bigint").alias("start"), "content")


@query(rf"""with s as (select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)),
 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) as sentence from documents)
 select doc_id as document_id, sentence, count(*) as n from s group by all""")
def c3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.documents(spark, sf_dir).select("document_id", F.explode(C.sentences(F.col("text"))).alias("sentence"))
    return rows.groupBy("document_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


def _pages(docs: DataFrame) -> DataFrame:
    """Pages of 700 characters."""
    cut = C.character_windows(docs.select("document_id", "text"), 700, 0)
    return cut.select("document_id", (F.col("chunk_index") + 1).alias("page_number"), F.col("content").alias("text"))


#: Pages of 700 characters, blank ones left out, numbered again; and the same laid end to end, a line break after each.
_PAGES = """p as (select doc_id, i, substr(text, cast(i * 700 + 1 as bigint), 700) as t from (
  select *, unnest(range(0, cast(greatest(0, ceil((length(text) - 700) / 700.0)) as bigint) + 1)) as i from documents) where regexp_matches(substr(text, cast(i * 700 + 1 as bigint), 700), '\\S')),
 n as (select *, row_number() over (partition by doc_id order by i) as page_number, sum(length(t) + 1) over (partition by doc_id order by i) as until from p)"""

@query(f"""with {_PAGES}, w as (select doc_id, concat(string_agg(t, chr(10) order by i), chr(10)) as text from p group by doc_id),
 k as (select doc_id, i * 1000 as begins, substr(text, cast(i * 1000 + 1 as bigint), 1000) as raw from (
  select *, unnest(range(0, cast(greatest(0, ceil((length(text) - 1000) / 1000.0)) as bigint) + 1)) as i from w)),
 s as (select doc_id, begins + length(raw) - length(regexp_replace(raw, '^\\s+', '')) as start, {_STRIPPED.format("raw")} as content from k where regexp_matches(raw, '\\S'))
 select s.doc_id as document_id, row_number() over (partition by s.doc_id order by start) - 1 as chunk_index, cast(start as bigint) as start, cast(min(n.page_number) as bigint) as page_number, sha256(content) as digest
 from s join n on n.doc_id = s.doc_id and n.until > s.start group by s.doc_id, s.start, s.content""")
def c11_cross_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = C.split_pages(_pages(B.documents(spark, sf_dir)), lambda t: C.window_pieces(t, 1000, 0), C.JOINED)
    return cut.select("document_id", *[F.col(c).cast("bigint").alias(c) for c in ("chunk_index", "start", "page_number")], F.sha2("content", 256).alias("digest"))


@query(f"""with {_PAGES}, k as (select doc_id, page_number, j, substr(t, cast(j * 250 + 1 as bigint), 300) as raw from (
  select *, unnest(range(0, cast(greatest(0, ceil((length(t) - 300) / 250.0)) as bigint) + 1)) as j from n))
 select doc_id as document_id, cast(page_number as bigint) as page_number, row_number() over (partition by doc_id order by page_number, j) - 1 as chunk_index, {_STRIPPED.format("raw")} as content
 from k where regexp_matches(raw, '\\S')""")
def c10_page_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = C.split_pages(_pages(B.documents(spark, sf_dir)), lambda t: C.window_pieces(t, 300, 50))
    return cut.select("document_id", *[F.col(c).cast("bigint").alias(c) for c in ("page_number", "chunk_index")], "content")


@query(f"""with {_PAGES}, k as (select 'small' as setting, 200 as size, t, doc_id from n union all select 'large', 500, t, doc_id from n),
 w as (select setting, doc_id, {_STRIPPED.format("substr(t, cast(j * size + 1 as bigint), size)")} as content from (
  select *, unnest(range(0, cast(greatest(0, ceil((length(t) - size) / cast(size as double))) as bigint) + 1)) as j from k))
 select setting, doc_id as document_id, count(*) as n_chunks, cast(sum(length(content)) as bigint) as characters, max(length(content)) as longest from w where content <> '' group by setting, doc_id""")
def c18_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {name: ((lambda t, n=n: C.window_pieces(t, n, 0)), C.ISOLATED, 0) for name, n in (("small", 200), ("large", 500))}
    return C.preview_sizes(C.previews(_pages(B.documents(spark, sf_dir)), settings))


@query(f"""with {B.D}, {B.C} select document_id, cast(chunk_index as bigint) as chunk_index,
 case when start >= length(text) // 2 and length(text) // 2 > 0 then '2. Beta' else '1. Alpha' end as section_title from c""")
def c14_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    headed = F.concat(F.lit("1. Alpha\n"), F.col("text"), F.lit("\n2. Beta\nend"))
    titles = docs.select("document_id", F.length("text").alias("n"), F.posexplode(C.headings(headed)).alias("k", "title"))
    marks = titles.select("document_id", F.when(F.col("k") == 0, 0).otherwise(F.floor(F.col("n") / 2)).cast("bigint").alias("pos"), "title")
    cut = B.chunks(spark, sf_dir).select("document_id", F.col("start").cast("bigint").alias("pos"), "chunk_index")
    return C.section_of_chunks(cut, marks).select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "section_title")


@query(f"""with {B.D}, {B.C}, w as (select *, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') as ws from c)
 select chunk_id, concat('[Summary: ', case when chunk_id % 2 = 0 then 'given' else concat(array_to_string(ws[1:8], ' '), '...') end, ']', chr(10), chr(10), content) as enriched from w""")
def c17_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = B.chunks(spark, sf_dir)
    return cut.select("chunk_id", C.with_summary(F.col("content"), F.when(F.col("chunk_id") % 2 == 0, " given ").otherwise("  "), "Summary").alias("enriched"))


@query(f"""with {B.D}, {B.C}, p as (select chunk_id, lag(content) over (partition by document_id order by chunk_index) as prev, content from c),
 e as (select chunk_id, prev, content, unnest(range(1, cast(least(length(prev), length(content), 300) as bigint) + 1)) as n from p where prev is not null)
 select chunk_id, max(n) as shared from e where starts_with(content, substr(prev, cast(length(prev) - n + 1 as bigint))) group by chunk_id""")
def c19_shared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("content").over(Window.partitionBy("document_id").orderBy("chunk_index"))
    cut = B.chunks(spark, sf_dir).withColumn("prev", before).filter("prev is not null")
    return cut.select("chunk_id", F.length(C.shared_edge(F.col("prev"), F.col("content"))).cast("bigint").alias("shared")).filter("shared > 0")


@query(f"with {B.D} select document_id, len(range(0, cast(greatest(0, ceil((length(text) - 2048) / 1792.0)) as bigint) + 1)) as n_windows from d")
def c7_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.documents(spark, sf_dir).select("document_id", F.size(C.token_windows(F.col("text"), 512, 64)).cast("bigint").alias("n_windows"))


@query(f"""with {B.D}, w as (select document_id, regexp_extract_all(lower(text), '{B.WORDS_RE}') as ws from d),
 k as (select *, unnest(range(0, cast(greatest(0, ceil((len(ws) - 100) / 80.0)) as bigint) + 1)) as i from w)
 select document_id, i as chunk_index, array_to_string(ws[i * 80 + 1 : i * 80 + 100], ' ') as content from k where len(ws) > 0""")
def c7_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a hundred tokens, twenty of them shared, by the tokenizer hook."""
    from ..hooks import word_tokenizer

    cut = B.documents(spark, sf_dir).select("document_id", F.posexplode(C.token_windows(F.col("text"), 100, 20, word_tokenizer)).alias("chunk_index", "content"))
    return cut.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content")


_CUT = ["document_id", "page_number", "chunk_index", "content"]


@query()
def c2_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_pages(_pages(B.documents(spark, sf_dir)), lambda t: C.recursive_pieces(t, 300, 50)).select(_CUT)


@query()
def c4_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..hooks import hashing_embedder

    embed = hashing_embedder(32)
    return C.split_pages(_pages(B.documents(spark, sf_dir)), C.SemanticSplit(embed)).select(_CUT)


@query(f"""with {_PAGES}, k as (select doc_id, page_number, unnest(p) as raw, unnest(range(len(p))) as j from (select doc_id, page_number, string_split(replace(t, '. ', concat('.', chr(1))), chr(1)) as p from n)),
 s as (select doc_id, page_number, j, {_STRIPPED.format("raw")} as content from k)
 select doc_id as document_id, cast(page_number as bigint) as page_number, row_number() over (partition by doc_id order by page_number, j) - 1 as chunk_index, content from s where content <> ''""")
def c8_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut where an annotator, which here marks the ends of sentences, says."""
    marked = lambda text: text.replace(". ", f".{C.BREAK_MARKER}")
    cut = C.split_pages(_pages(B.documents(spark, sf_dir)), lambda t: C.annotated_pieces(t, marked))
    return cut.select("document_id", *[F.col(c).cast("bigint").alias(c) for c in ("page_number", "chunk_index")], "content")


@query()
def c6_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = B.documents(spark, sf_dir).select("document_id", F.lit(1).alias("page_number"), F.concat(F.lit("# One\n"), F.col("text"), F.lit("\n## Two\n"), F.col("text")).alias("text"))
    return C.split_pages(headed, lambda t: C.structural_pieces(t, 1200, 400, 50)).select(_CUT)


@query()
def c12_page_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_pages(_pages(B.documents(spark, sf_dir)), lambda t: C.recursive_pieces(t, 300, 50), C.CARRIED, 50).select(_CUT)


@query()
def c15_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and sections of recursive pieces across pages; every third page opens with a numbered heading."""
    pages = _pages(B.documents(spark, sf_dir))
    n = F.col("page_number")
    headed = F.when(n % 3 == 1, F.concat(F.lit("\n"), n, F.lit(". Part of the text\n"), F.col("text"))).otherwise(F.col("text"))
    return C.split_pages(pages.withColumn("text", headed), lambda t: C.recursive_pieces(t, 300, 50), C.JOINED).select("document_id", "chunk_index", "page_number", "start", "section_title")


# ---- tagging -----------------------------------------------------------------------------


@query("""select o_orderkey as document_id, 1 as n, concat('Head', chr(10), 'Issued on ', day(o_orderdate), '. ', month(o_orderdate), '. ', year(o_orderdate), chr(10), 'a', chr(10), 'b') as snippet,
 strftime(o_orderdate, '%Y-%m-%d') as released from orders""")
def t1_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    text = F.concat(F.lit("Head\nIssued on "), F.dayofmonth(day), F.lit(". "), F.month(day), F.lit(". "), F.year(day), F.lit("\na\nb\nc"))
    found = orders.select(F.col("o_orderkey").alias("document_id"), G.date_candidates(text).alias("s"))
    released = G.release_date(G.first_date(F.get("s", F.lit(0))), F.lit(None).cast("date"), F.lit(None).cast("timestamp"), F.lit("2026-01-01").cast("date"))
    return found.select("document_id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("snippet"), released.cast("string").alias("released"))


@query("""select doc_id as document_id, case doc_id % 5 when 0 then 'management' when 1 then 'hr' when 2 then 'finance' when 3 then 'user' else 'user' end as category_key from documents""")
def t4_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = B.categories(spark).withColumn("role", U.role_name(F.col("role_name"), F.col("key"), F.col("allowed_groups")))
    said = F.element_at(F.array(*[F.lit(x) for x in (" MANAGEMENT ", "the hr team", "Finance", "", "unknown")]), (F.col("document_id") % 5 + 1).cast("int"))
    return G.category_for(B.documents(spark, sf_dir).select("document_id", said.alias("answer")), cats).select("document_id", "category_key")


@query("""select doc_id as document_id, case doc_id % 4 when 0 then 'replaces' when 1 then 'modifies' else 'none' end as kind, case when doc_id % 4 < 2 then cast(doc_id as varchar) end as target from documents""")
def t7_relation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit('{"relationship_type": "'), F.element_at(F.array(*[F.lit(x) for x in ("replaces", "modifies", "eats", "none")]), (F.col("document_id") % 4 + 1).cast("int")), F.lit('", "target_document_id": "'), F.col("document_id"), F.lit('"}'))
    said = F.when(F.col("document_id") % 4 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).when(F.col("document_id") % 4 == 3, "not json").otherwise(said)
    return B.documents(spark, sf_dir).select("document_id", G.parsed_relation(said).alias("r")).select("document_id", F.col("r.relationship_type").alias("kind"), F.col("r.target_document_id").alias("target"))


@query(r"""with s as (select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(concat(text, case when doc_id % 35 = 0 then concat(' This replaces the old doc_', doc_id - 7, ' at once.') when doc_id % 35 = 1 then concat(' It amends doc_', doc_id - 1, '.') else '' end), '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)),
 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) as sentence from documents),
 f as (select doc_id, sentence, case when regexp_matches(sentence, '(?i)\b(?:replaces|nahrazuje|ruší)\b') then regexp_extract(sentence, '(?is)\b(?:replaces|nahrazuje|ruší)\b(.*)$', 1) end as a, case when regexp_matches(sentence, '(?i)\b(?:modifies|amends|upravuje|doplňuje|mění)\b') then regexp_extract(sentence, '(?is)\b(?:modifies|amends|upravuje|doplňuje|mění)\b(.*)$', 1) end as m from s)
 select distinct f.doc_id as source_document_id, 'replaces' as relationship_type, d.doc_id as target_document_id from f join documents d on list_contains(regexp_split_to_array(f.a, '[^\p{L}\p{N}_-]+'), concat('doc_', d.doc_id)) and d.doc_id < f.doc_id
 union all select distinct f.doc_id, 'modifies', d.doc_id from f join documents d on list_contains(regexp_split_to_array(f.m, '[^\p{L}\p{N}_-]+'), concat('doc_', d.doc_id)) and d.doc_id < f.doc_id""")
def t8_relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document; one in 35 ends by replacing, and one by amending an earlier one."""
    docs, n = B.documents(spark, sf_dir), F.col("document_id")
    more = F.when(n % 35 == 0, F.concat(F.lit(" This replaces the old doc_"), n - 7, F.lit(" at once."))).when(n % 35 == 1, F.concat(F.lit(" It amends doc_"), n - 1, F.lit("."))).otherwise("")
    said = docs.select("document_id", F.explode(C.sentences(F.concat("text", more))).alias("sentence"))
    return G.relations_by_rule(said, docs.select("document_id", "title", n.alias("date_order")))


#: A document's title by its number, as SQL text and Column: two to eleven words with punctuation between them.
_TITLE = """concat(case {0} % 3 when 0 then 'Order ' when 1 then 'RULES No.' else '' end, {0}, '/2020', array_to_string(list_transform(range({0} % 8), lambda i: concat(case when i % 2 = 0 then ' (word ' else ', & ' end, i)), ''), case when {0} % 2 = 0 then '"' else '' end)"""


def _title(n: F.Column) -> F.Column:
    more = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < n % 8, F.concat(F.when(i % 2 == 0, " (word ").otherwise(", & "), i.cast("string"))).otherwise(""))
    return F.concat(F.when(n % 3 == 0, "Order ").when(n % 3 == 1, "RULES No.").otherwise(""), n.cast("string"), F.lit("/2020"), F.array_join(more, ""), F.when(n % 2 == 0, '"').otherwise(""))


_TITLE_WORDS = r"array_to_string(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_-]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')), ' ')"


@query(rf"""with t as (select doc_id, text, {_TITLE.format("doc_id")} as title from documents),
 s as (select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(concat(text, case when doc_id % 35 = 0 then concat(' This replaces "', {_TITLE.format("(doc_id - 7)")}, ', at once.') when doc_id % 35 = 1 then concat(' It amends the ', {_TITLE.format("(doc_id - 1)")}, '.') else '' end), '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) as sentence from t),
 f as (select doc_id, 'replaces' as kind, regexp_extract(sentence, '(?is)\b(?:replaces|nahrazuje|ruší)\b(.*)$', 1) as rest from s where regexp_matches(sentence, '(?i)\b(?:replaces|nahrazuje|ruší)\b')
  union all select doc_id, 'modifies', regexp_extract(sentence, '(?is)\b(?:modifies|amends|upravuje|doplňuje|mění)\b(.*)$', 1) from s where regexp_matches(sentence, '(?i)\b(?:modifies|amends|upravuje|doplňuje|mění)\b')),
 n as (select doc_id, kind, concat(' ', {_TITLE_WORDS.format("rest")}, ' ') as rest from f), k as (select doc_id, concat(' ', {_TITLE_WORDS.format("title")}, ' ') as title from t)
 select distinct n.doc_id as source_document_id, kind as relationship_type, k.doc_id as target_document_id from n join k on contains(n.rest, k.title) and k.doc_id < n.doc_id""")
def t8_long_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of up to eleven words, with punctuation, after the phrases that announce a relation; no title stands in another."""
    docs, n = B.documents(spark, sf_dir), F.col("document_id")
    more = F.when(n % 35 == 0, F.concat(F.lit(' This replaces "'), _title(n - 7), F.lit(", at once."))).when(n % 35 == 1, F.concat(F.lit(" It amends the "), _title(n - 1), F.lit("."))).otherwise("")
    said = docs.select("document_id", F.explode(C.sentences(F.concat("text", more))).alias("sentence"))
    return G.relations_by_rule(said, docs.select("document_id", _title(n).alias("title"), n.alias("date_order")))


@query(f"with {B.D} select document_id, title from d where freshness_status = 'current'")
def t6_relation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relation_candidates(B.documents(spark, sf_dir))


KEYWORDS = (("management", "the"), ("management", "de"), ("hr", "of"), ("hr", "la"), ("hr", "the"), ("finance", "und"), ("finance", "que"))


@query(f"""with {B.D}, w as (select document_id, unnest(regexp_extract_all(lower(substr(text, 1, 1400)), '{B.WORDS_RE}')) as term from d),
 k as (select * from (values {", ".join(map(str, KEYWORDS))}) as k(key, term)),
 h as (select document_id, key, count(*) as n from w join k using (term) group by all),
 b as (select document_id, min(key) as key from (select *, max(n) over (partition by document_id) as top from h) where n = top group by document_id)
 select distinct w.document_id, coalesce(key, 'user') as category_key from w left join b using (document_id)""")
def t5_keyword_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two pages' words against keywords of the categories."""
    keywords = spark.createDataFrame(KEYWORDS, "key string, term string")
    words = B.documents(spark, sf_dir).select("document_id", F.explode(T.tokens(F.substring("text", 1, 1400))).alias("term"))
    return G.category_by_keywords(words, keywords)


@query(f"""with {B.D} select document_id, case document_id % 4 when 0 then 'Management' when 1 then 'Management,HR' when 2 then 'Management,Finance' else 'Management,HR,Finance,User' end as acl, case document_id % 4 when 3 then 'Management' else 'known' end as edited from (select document_id, case when document_id % 4 = 3 then 'ghost' else department end as department from d)""")
def t11_category_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by category: all of them for unknown ones at ingest, Management's alone in an edit."""
    named = B.documents(spark, sf_dir).select("document_id", F.when(F.col("document_id") % 4 == 3, "ghost").otherwise(F.col("department")).alias("key"))
    joined = named.join(F.broadcast(B.categories(spark)), "key", "left")  # configuration
    alone = U.category_groups(joined, (U.MANAGEMENT,))
    return joined.select("document_id", _csv(U.category_groups(joined)).alias("acl"), F.when(F.col("label").isNull(), _csv(alone)).otherwise("known").alias("edited"))


_SQL_STOPS = "greatest(" + ", ".join(f"struct_pack(n := len(list_filter(ws, lambda w: list_contains({list(s)!r}, w))), k := {-k}, lang := '{lang}')" for k, (lang, s) in enumerate(G.STOP_WORDS.items())) + ")"


@query(f"""with {B.D}, w as (select document_id, regexp_extract_all(lower(text), '{B.WORDS_RE}') as ws from d)
 select document_id, {_SQL_STOPS}.lang as language from w""")
def t9_language_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    return B.documents(spark, sf_dir).withColumn("ws", words).select("document_id", G.language_by_stop_words(F.col("ws")).alias("language"))


@query(f"""with {B.D} select document_id, sha256(concat(substr(text, 1, 700), case when length(text) > 700 and regexp_matches(substr(text, 701, 700), '\\S') then chr(10) || substr(text, 701, 700) else '' end)) as excerpt from d""")
def t10_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_texts(_pages(B.documents(spark, sf_dir))).select("document_id", F.sha2("excerpt", 256).alias("excerpt"))


@query(f"""with {B.D} select document_id, row_number() over (partition by tenant_id order by case when document_id % 9 = 0 then null else created_at end asc nulls first, document_id) as date_order from d""")
def t12_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("document_id") % 9 == 0, "soon").otherwise(F.col("created_at").cast("string"))
    return G.chronological(B.documents(spark, sf_dir), day).select("document_id", F.col("date_order").cast("bigint").alias("date_order"))


@query(f"""with {B.D}, f as (select document_id, source_folder, created_at, concat(text, case when document_id % 35 = 0 and document_id >= 7 then concat(chr(10), 'Issued ', created_at, '. This replaces doc_', document_id - 7, '.') else '' end) as content from d),
 w as (select document_id, regexp_extract_all(lower(content), '{B.WORDS_RE}') as ws from f),
 k as (select * from (values {", ".join(map(str, KEYWORDS))}) as k(key, term)),
 h as (select document_id, key, count(*) as n from (select document_id, unnest(ws) as term from w) join k using (term) group by all),
 b as (select document_id, min(key) as key from (select *, max(n) over (partition by document_id) as top from h) where n = top group by document_id),
 c as (select document_id, count(*) as n_chunks from (select *, unnest(range(0, cast(greatest(0, ceil((length(content) - {B.SIZE}) / {B.SIZE - B.OVERLAP}.0)) as bigint) + 1)) as i from f)
  where regexp_matches(substr(content, cast(i * {B.SIZE - B.OVERLAP} + 1 as bigint), {B.SIZE}), '\\S') group by document_id),
 r as (select f.document_id, s.document_id as by_id from f join f s on s.document_id = f.document_id + 7 and s.document_id % 35 = 0 and s.created_at > f.created_at)
 select concat('file://', source_folder, '/doc_', f.document_id, '.txt') as source_uri, {{stops}}.lang as language, case when by_id is null then 'current' else 'archived' end as freshness_status,
  case when by_id is null then 'current' else 'archived' end as chunk_status, coalesce(b.key, 'user') as department, case when by_id is not null then concat('doc_', by_id) end as replaced_by, n_chunks
 from f join w using (document_id) join c using (document_id) left join b using (document_id) left join r using (document_id)""".replace("{stops}", _SQL_STOPS))
def i15_full_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of one tenant, from reading to related documents with their chunks counted; one in 35 replaces an earlier one."""
    docs, n = B.documents(spark, sf_dir), F.col("document_id")
    path = F.concat(F.lit("/srv/data/"), F.col("source_folder"), F.lit("/doc_"), n, F.lit(".txt"))
    more = F.when((n % 35 == 0) & (n >= 7), F.concat(F.lit("\nIssued "), F.col("created_at").cast("string"), F.lit(". This replaces doc_"), n - 7, F.lit("."))).otherwise("")
    files = docs.select(path.alias("path"), F.lit("acme").alias("tenant_id"), F.concat("text", more).alias("content"), F.col("created_at").cast("timestamp").alias("modified"))
    pages = files.select("path", F.lit(1).alias("page_number"), F.col("content").alias("text"))
    keywords = spark.createDataFrame(KEYWORDS, "key string, term string")
    documents, chunks, _ = J.full_reindex(files, pages, keywords, B.categories(spark), F.lit(RUN_TIME).cast("timestamp"), lambda t: C.window_pieces(t, B.SIZE, B.OVERLAP))
    counts = chunks.groupBy("document_id", F.col("freshness_status").alias("chunk_status")).agg(F.count(F.lit(1)).alias("n_chunks"))
    return documents.join(counts, "document_id").select("source_uri", "language", "freshness_status", "chunk_status", F.col("metadata")["department"].alias("department"), F.col("metadata")["replaced_by_document_title"].alias("replaced_by"), "n_chunks")


# ---- governance --------------------------------------------------------------------------


@query(f"""with {B.D} select d.document_id,
 case when s.document_id is not null then 'archived' else d.freshness_status end as freshness_status,
 case when s.document_id is not null then s.title end as replaced_by,
 case when d.document_id % 35 = 0 and d.document_id >= 7 and r.document_id is not null then r.title end as replaces, case when d.document_id % 35 = 1 and m.document_id is not null then m.title end as modifies
 from d left join d s on s.document_id = d.document_id + 7 and s.document_id % 35 = 0
 left join d r on r.document_id = d.document_id - 7 left join d m on m.document_id = d.document_id - 1""")
def u1_archival(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.apply_relations(B.documents(spark, sf_dir), B.relations(spark, sf_dir))
    return out.select("document_id", "freshness_status", *[F.col("metadata")[f"{k}_document_title"].alias(k) for k in ("replaced_by", "replaces", "modifies")])


@query(f"""with {B.D}, {B.C} select chunk_id, case when (document_id + 7) % 35 = 0 and document_id + 7 in (select document_id from d) then 'archived' else freshness_status end as freshness_status from c""")
def u1_archived_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = B.chunks(spark, sf_dir).join(B.documents(spark, sf_dir).select("document_id", "freshness_status"), "document_id")
    return U.archive_chunks(cut.select("document_id", "chunk_id", "freshness_status"), B.relations(spark, sf_dir)).select("chunk_id", "freshness_status")


@query(f"""with {B.D} select document_id, case when document_id % 6 = 0 then concat('New ', document_id) else title end as title,
 case when document_id % 6 = 0 then 'hr' when document_id % 6 = 3 then 'ghost' else department end as department,
 case when document_id % 6 = 0 then 'Management,HR' when document_id % 6 = 3 then 'Management' else acl_csv end as acl from d""")
def u3_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = B.documents(spark, sf_dir), F.col("document_id")
    edits = docs.filter(n % 3 == 0).select("document_id", F.when(n % 6 == 0, F.concat(F.lit("New "), n)).alias("new_title"), F.lit(None).cast("string").alias("new_status"), F.lit(None).cast("string").alias("new_language"), F.when(n % 6 == 0, "hr").otherwise("ghost").alias("new_category"))
    return U.apply_edits(docs, edits, B.categories(spark)).select("document_id", "title", F.col("metadata")["department"].alias("department"), _csv(F.col("acl")).alias("acl"))


@query(f"""with {B.D} select document_id, case department when 'finance' then 'user' else department end as department,
 case when department = 'finance' then 'Management,HR,Finance,User' else acl_csv end as acl, department = 'finance' as migrated from d""")
def u5_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = spark.createDataFrame([("finance", "user")], "deleted_key string, replacement_key string")
    out = U.migrate_categories(B.documents(spark, sf_dir), moves, B.categories(spark))
    return out.select("document_id", F.col("metadata")["department"].alias("department"), _csv(F.col("acl")).alias("acl"), "migrated")


@query(f"""with {B.D}, g as (select document_id, department, acl_csv, case department when 'management' then 'Management' when 'hr' then 'Management,People' when 'finance' then 'Management,Finance' else 'Management,People,Finance,User' end as want from d)
 select department, count(*) as documents, count(*) filter (where acl_csv is distinct from want) as propagated from g group by department""")
def u6_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = B.categories(spark)
    new = old.withColumn("role_name", F.when(F.col("key") == "hr", "People").otherwise(F.col("role_name")))
    renamed = U.apply_renames(new, U.renamed_groups(old, new))
    out = U.propagate_acl(B.documents(spark, sf_dir), renamed)
    return out.groupBy(F.col("metadata")["department"].alias("department")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("propagated").cast("bigint")).alias("propagated"))


def _mirror(spark: SparkSession, sf_dir: str, documents: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks with what they inherited, after ``changed`` documents were written back to them."""
    inherited = documents.select("document_id", "language", "freshness_status", "acl", "metadata")
    cut = B.chunks(spark, sf_dir).select("document_id", "chunk_id").join(inherited, "document_id")
    out = U.mirrored(cut, changed)
    return out.select("chunk_id", "language", F.col("metadata")["department"].alias("department"), _csv(F.col("acl")).alias("acl"))


@query(f"""with {B.D}, {B.C} select chunk_id, case when document_id % 6 = 0 then 'xx' else language end as language,
 case when document_id % 6 = 0 then 'hr' when document_id % 6 = 3 then 'ghost' else department end as department,
 case when document_id % 6 = 0 then 'Management,HR' when document_id % 6 = 3 then 'Management' else acl_csv end as acl from c""")
def u3_edited_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = B.documents(spark, sf_dir), F.col("document_id")
    edits = docs.filter(n % 3 == 0).select("document_id", F.lit("t").alias("new_title"), F.lit(None).cast("string").alias("new_status"), F.when(n % 6 == 0, "xx").alias("new_language"), F.when(n % 6 == 0, "hr").otherwise("ghost").alias("new_category"))
    edited = U.apply_edits(docs, edits, B.categories(spark))
    return _mirror(spark, sf_dir, docs, edited.join(edits.select("document_id"), "document_id", "left_semi"))


@query(f"""with {B.D}, {B.C} select chunk_id, language, case department when 'finance' then 'user' else department end as department,
 case when department = 'finance' then 'Management,HR,Finance,User' else acl_csv end as acl from c""")
def u5_migrated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    moves = spark.createDataFrame([("finance", "user")], "deleted_key string, replacement_key string")
    return _mirror(spark, sf_dir, docs, U.migrate_categories(docs, moves, B.categories(spark)).filter("migrated"))


@query(f"""with {B.D}, {B.C} select chunk_id, language, department,
 case department when 'management' then 'Management' when 'hr' then 'Management,HR' when 'finance' then 'Management,Finance' else 'Management,HR,Finance,User' end as acl from c""")
def u6_propagated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    return _mirror(spark, sf_dir, docs, U.propagate_acl(docs, B.categories(spark)).filter("propagated"))


# ---- retrieval ---------------------------------------------------------------------------

CONFIG = SearchConfig(final_limit=8)
_PAIRS = f"""{B.D}, {B.C}, {B.Q},
sims as (select q.query_id, c.chunk_id, round(list_cosine_similarity(cast(e.embedding as double[]), q.vector), 6) as sim from c join embeddings e on e.vec_id = c.document_id, q where c.chunk_index = 0),
pairs as (select q.query_id, q.query, c.chunk_id, c.content, c.created_at from c, q where c.tenant_id in ('acme-prod', 'acme')
 and (list_contains(q.groups, 'Management') or coalesce(list_has_any(c.acl, list_concat(q.groups, ['User'])), false)) and (q.freshness = 'all' or c.freshness_status = 'current')),
scored as (select pairs.*, sim, coalesce(sim, 0.0) as score from pairs left join sims using (query_id, chunk_id)),
vec as (select *, row_number() over (partition by query_id order by sim is null, score desc, chunk_id) as rank from scored qualify rank <= 50),
terms as (select distinct query_id, unnest(regexp_extract_all(lower(query), '{B.WORDS_RE}')) as term from q),
post as (select term, chunk_id, count(*) as tf from (select chunk_id, unnest(regexp_extract_all(lower(content), '{B.WORDS_RE}')) as term from c) group by all),
ranks as (select query_id, chunk_id, round(0.1 * sum(tf), 6) as fts_rank from post join terms using (term) group by all),
key as (select s.*, r.fts_rank, row_number() over (partition by s.query_id order by r.fts_rank desc, s.chunk_id) as rank from scored s join ranks r using (query_id, chunk_id) qualify rank <= 50),
both_lists as (select query_id, chunk_id, coalesce(vec.content, key.content) as content, vec.rank as v_rank, key.rank as k_rank, vec.score as v_score, key.fts_rank from vec full join key using (query_id, chunk_id))"""
_KEY = "lower(substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 120))"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked, (searched, index) = B.queries(spark, sf_dir), B.library(spark, sf_dir)
    return R.vector_candidates(asked, searched, 50, B.AS_OF_YEAR), R.keyword_candidates(asked, searched, 50, B.AS_OF_YEAR, index)


@query(f"with {_PAIRS} select query_id, chunk_id, rank, score from vec")
def r1_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.vector_candidates(B.queries(spark, sf_dir), B.stored_chunks(spark, sf_dir), 50, B.AS_OF_YEAR)
    return found.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query(f"with {_PAIRS} select query_id, chunk_id, rank, score from vec")
def r1_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists from the stored vectors by pivots."""
    found = R.vector_candidates(B.queries(spark, sf_dir), B.stored_chunks(spark, sf_dir), 50, B.AS_OF_YEAR, index=B.vector_index(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query(f"with {_PAIRS} select query_id, chunk_id, rank, fts_rank, score from key")
def r6_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, index = B.library(spark, sf_dir)
    found = R.keyword_candidates(B.queries(spark, sf_dir), chunks, 50, B.AS_OF_YEAR, index)
    return found.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "fts_rank", "score")


@query()
def r6_postings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings each search's words have, and how many its search reads."""
    chunks, index = B.library(spark, sf_dir)
    asked = B.queries(spark, sf_dir)
    about = chunks.select("chunk_id", *P.SEEN)
    visible = lambda hits: hits.join(about, "chunk_id").join(asked.select("query_id", *P.ASKER), "query_id").filter(P.may_see(B.AS_OF_YEAR))
    reads, told = K.search_plan(index, R.query_terms(asked), visible, 50)
    return K.postings_read(told, reads)


def _changed(docs: DataFrame) -> DataFrame:
    """One document in ten with another text."""
    return docs.filter("document_id % 10 = 1").withColumn("text", F.concat(F.lit("the alpha of the "), "text"))


@query(f"with {_PAIRS.replace(B.DOCUMENTS_SQL, B.DOCUMENTS_SQL.replace('source_folder, text', chr(34) + 'source_folder' + chr(34) + ', case when doc_id % 10 = 1 then concat(' + chr(39) + 'the alpha of the ' + chr(39) + ', text) else text end as text'))} select query_id, chunk_id, rank, fts_rank from key")
def r6_updated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword search, by as few postings as lead to its results, after one document in ten was replaced in the stored index, which is not built again."""
    chunks, index = B.library(spark, sf_dir)
    mine = K.KeywordIndex(f"{store.shared_folder(spark)}/keywords-{uuid.uuid4().hex}", buckets=B.BUCKETS)
    K.build(mine, chunks)
    changed = _changed(B.documents(spark, sf_dir))
    cut = C.character_windows(changed.select("document_id", "text"), B.SIZE, B.OVERLAP).withColumn("chunk_id", F.col("document_id") * B.CHUNKS_AT_MOST + F.col("chunk_index"))
    gone = chunks.filter("document_id % 10 = 1")
    K.update(mine, gone.select("chunk_id"), cut)
    # A document's chunks all inherit the same.
    inherited = gone.filter("chunk_index = 0").drop("chunk_id", "chunk_index", "start", "content", "embedding", "metadata")
    vectors = gone.select("chunk_id", "embedding").filter("embedding is not null")
    fresh = cut.join(inherited, "document_id").join(vectors, "chunk_id", "left").withColumn("metadata", F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")))
    now = store.staged(chunks.filter("document_id % 10 <> 1").unionByName(fresh), "updated-chunks")
    found = R.keyword_candidates(B.queries(spark, sf_dir), now, 50, B.AS_OF_YEAR, mine, prune_above=0)
    return found.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "fts_rank")


_RRF = f"""{_PAIRS}, fused as (select *, round(coalesce(0.6::double / (60 + v_rank), 0) + coalesce(0.4::double / (60 + k_rank), 0), 9) as fused from both_lists),
 best as (select * from fused qualify row_number() over (partition by query_id, {_KEY} order by fused desc, v_rank nulls last, k_rank nulls last, chunk_id) = 1),
 top as (select query_id, row_number() over (partition by query_id order by fused desc, v_rank nulls last, k_rank nulls last, chunk_id) as rank, chunk_id, fused as score from best qualify rank <= 8)"""


@query(f"with {_RRF} select query_id, rank, chunk_id, score from top")
def r12_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("query_id", "rank", "chunk_id", "score")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, index = B.library(spark, sf_dir)
    found = R.retrieve(B.queries(spark, sf_dir), chunks, CONFIG, B.AS_OF_YEAR, index)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "score", "content")


@query(f"""with {_PAIRS} select query_id, chunk_id, rank, round(score + case when year(created_at) = {B.AS_OF_YEAR} then 0.25 else 0 end, 6) as score from key""")
def r8_freshness_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, index = B.library(spark, sf_dir)
    found = R.keyword_candidates(B.queries(spark, sf_dir), chunks, 50, B.AS_OF_YEAR, index)
    return R.boosted(found, 0.25, B.AS_OF_YEAR).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query(f"""with {B.D}, {B.C} select chunk_id, concat('chunk_index=', chunk_index, ',department=', case when document_id % 2 = 0 then 'own' else department end, ',source_folder=', source_folder) as metadata from c""")
def r9_result_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and chunk metadata in one map; every second chunk has a department of its own, which wins."""
    rows = B.searchable(spark, sf_dir)
    own = F.when(F.col("document_id") % 2 == 0, F.map_concat("metadata", F.create_map(F.lit("department"), F.lit("own")))).otherwise(F.col("metadata"))
    entries = F.array_sort(F.map_entries("merged_metadata"))
    return R.with_metadata(rows.withColumn("metadata", own)).select("chunk_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"))


@query(f"""with {_PAIRS}, fused as (select *, round(0.6::double * case when v_rank is null then 0 else greatest(0, v_score) end + 0.4::double * coalesce(fts_rank, 0) / greatest(coalesce(max(fts_rank) over (partition by query_id), 0), 0.1), 9) as fused from both_lists),
 best as (select * from fused qualify row_number() over (partition by query_id, {_KEY} order by fused desc, v_rank nulls last, k_rank nulls last, chunk_id) = 1),
 cut as (select query_id, row_number() over (partition by query_id order by fused desc, v_rank nulls last, k_rank nulls last, chunk_id) as rank, chunk_id, fused as score from best qualify rank <= 8)
 select query_id, rank, chunk_id, round(score, 6) as score from cut where score >= 0.2""")
def r13_score_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, keyword = _sides(spark, sf_dir)
    return R.fuse_scores(vector, keyword, 8, threshold=0.2).select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query(f"""with {_PAIRS}, v1 as (select *, {_KEY} as k from vec qualify row_number() over (partition by query_id, k order by rank) = 1),
 vv as (select * from v1 qualify row_number() over (partition by query_id order by rank) <= 5),
 k1 as (select key.*, {_KEY} as k from key), k2 as (select * from k1 where not exists (select 1 from vv where vv.query_id = k1.query_id and (vv.chunk_id = k1.chunk_id or vv.k = k1.k)) qualify row_number() over (partition by query_id, k order by rank) = 1),
 u as (select query_id, chunk_id, rank as place, 0 as list from vv union all select query_id, chunk_id, rank, 1 from k2)
 select query_id, row_number() over (partition by query_id order by list, place) as rank, chunk_id from u qualify rank <= 10""")
def r14_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, keyword = _sides(spark, sf_dir)
    return R.fuse_union(vector, keyword, 5, 5).select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id")


@query(f"""with {B.D}, {B.C}, {B.Q}, v as (select chunk_id, cast(e.embedding as double[]) as embedding from c join embeddings e on e.vec_id = c.document_id where chunk_index = 0)
 select query_id, chunk_id, row_number() over (partition by query_id order by round(list_cosine_similarity(embedding, vector), 6) desc, chunk_id) as rank from v, q qualify rank <= 10""")
def r1_vector_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k_blocks(B.queries(spark, sf_dir), B.searchable(spark, sf_dir), 10).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


# ---- context, passages -------------------------------------------------------------------


def _placed(cut: DataFrame) -> DataFrame:
    """Two chunks to a page, three to a section, and none to the first chunk's."""
    section = F.when(F.col("chunk_index") > 0, F.concat(F.lit("S"), F.floor(F.col("chunk_index") / 3)))
    return cut.withColumn("page_number", F.floor(F.col("chunk_index") / 2).cast("int")).withColumn("section_title", section)


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cut = _placed(B.stored_chunks(spark, sf_dir))
    around = cut.select("chunk_id", "document_id", "chunk_index", "page_number", "section_title")
    return _found(spark, sf_dir).withColumn("hit_id", F.col("chunk_id")).join(around, "chunk_id"), cut


@query(f"""with {_RRF}, h as (select top.query_id, c.* from top join c using (chunk_id)),
 ask as (select query_id, groups, freshness from q), near as (
 select 'siblings' as kind, h.query_id, h.chunk_id as hit_id, c.* from h join c using (document_id) where abs(c.chunk_index - h.chunk_index) <= 1
 union all select 'page', h.query_id, h.chunk_id, c.* from h join c using (document_id) where c.chunk_index // 2 = h.chunk_index // 2
 union all select 'section', h.query_id, h.chunk_id, c.* from h join c using (document_id) where c.chunk_index // 3 = h.chunk_index // 3 and c.chunk_index > 0 and h.chunk_index > 0)
 select kind, near.query_id, hit_id, chunk_id from near join ask using (query_id) where tenant_id in ('acme-prod', 'acme')
  and (list_contains(groups, 'Management') or coalesce(list_has_any(acl, list_concat(groups, ['User'])), false)) and (freshness = 'all' or freshness_status = 'current')""")
def x1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, cut = _hits(spark, sf_dir)
    asked = B.queries(spark, sf_dir)
    parts = [X.neighbours(hits, cut, k, 1, asked, B.AS_OF_YEAR).select(F.lit(k).alias("kind"), "query_id", "hit_id", "chunk_id") for k in ("siblings", "page", "section")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def x2_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with its hits' siblings around them."""
    config = SearchConfig(final_limit=8, context_expansion="siblings", context_expansion_size=2, context_max_tokens=700)
    chunks, index = B.library(spark, sf_dir)
    return R.retrieve(B.queries(spark, sf_dir), _placed(chunks), config, B.AS_OF_YEAR, index)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = _hits(spark, sf_dir)
    titles = B.documents(spark, sf_dir).select("document_id", "title", "freshness_status", F.col("acl").alias("allowed_groups"))
    return hits.join(titles, "document_id")


@query(f"""with {_RRF} select top.query_id, concat(case when top.query_id % 3 = 0 then 'Answer from:' else 'Stručně:' end, chr(10), string_agg(concat('[', rank, '] Title: ', title, ' (Section: ', case when chunk_index > 0 then concat('S', chunk_index // 3) else 'N/A' end, ', Page: ', chunk_index // 2, ')', chr(10), 'Content: ', content, chr(10)), concat(chr(10), '---', chr(10)) order by rank)) as prompt
 from top join c using (chunk_id) group by top.query_id""")
def x5_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the search's hits in the template of the tenant and locale who ask."""
    templates = spark.createDataFrame([("acme", "en", "Answer from:\n{context_str}"), ("default", "cs", "Stručně:\n{context_str}"), ("other", "cs", "?")], "tenant string, locale string, template string")
    told = X.evidence(_told(spark, sf_dir).withColumn("content", F.concat(F.lit(X.START), "content", F.lit(X.END))))
    asked = told.withColumn("tenant", F.lit("acme-prod")).withColumn("locale", F.when(F.col("query_id") % 3 == 0, "EN").otherwise("fr"))
    return X.templates_for(asked, templates).select("query_id", X.prompt(F.col("template"), F.col("context")).alias("prompt"))


@query(f"""with {_RRF} select top.query_id, count(*) as n, string_agg(concat_ws('|', document_id, chunk_id, title, chunk_index // 2, freshness_status, coalesce(acl_csv, '')), ';' order by rank) as sources from top join c using (chunk_id) group by top.query_id""")
def x6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = X.answer_sources(_told(spark, sf_dir))
    line = lambda s: F.concat_ws("|", s["document_id"], s["chunk_id"], s["title"], s["page_number"], s["freshness_status"], F.array_join(s["allowed_groups"], ","))
    return listed.select("query_id", F.size("sources").cast("bigint").alias("n"), F.array_join(F.transform("sources", line), ";").alias("sources"))


@query("""select conv_id, turn, case when turn % 4 = 0 then 'vector_pgvector' when turn % 4 = 1 then 'keyword_fts' else 'hybrid_rrf' end as label from conversations""")
def x9_strategy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("turn") % 4 == 0, "vector").when(F.col("turn") % 4 == 1, "keyword").when(F.col("turn") % 4 == 2, "hybrid")
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strategy_label(asked).alias("label"))


@query("""select concat(conv_id, '-', turn) as message_id, 1 + turn % 2 as place, case turn % 2 when 0 then concat('doc_', conv_id) else concat('doc_', conv_id + turn) end as source from conversations where role = 'assistant'""")
def x8_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.messages(spark, sf_dir)
    answers = rows.withColumn("content", F.concat("content", F.lit(" ["), 1 + F.col("turn") % 2, F.lit("] [Source 9]")))
    sources = rows.select("message_id", F.posexplode("sources").alias("k", "source")).select("message_id", (F.col("k") + 1).alias("place"), "source")
    return X.citations(answers, sources).select("message_id", F.col("place").cast("bigint").alias("place"), "source")


def _words(docs: DataFrame) -> DataFrame:
    at = docs.select("document_id", F.lit(1).alias("page_number"), F.posexplode(F.split("text", r"(?U)\s+")).alias("word_index", "word"))
    i = F.col("word_index")
    return at.withColumn("block_no", F.floor(i / 50)).withColumn("line_no", F.floor(i / 10)).withColumn("x0", i % 10 * 7).withColumn("y0", F.floor(i / 10) * 12).withColumn("x1", i % 10 * 7 + 6).withColumn("y1", F.floor(i / 10) * 12 + 10)


_LOCATED = rf"""{B.D}, {B.C}, w as (select document_id, unnest(regexp_split_to_array(text, '\s+')) as word, unnest(range(len(regexp_split_to_array(text, '\s+')))) as i from d where document_id % 20 = 0),
 v as (select *, regexp_replace(strip_accents(lower(word)), '[^a-z0-9]', '', 'g') as x from w),
 e as (select *, sum(length(x)) over (partition by document_id order by i) as until from v),
 j as (select document_id, string_agg(x, '' order by i) as joined from v group by document_id),
 p as (select chunk_id, document_id, regexp_replace(strip_accents(lower(content)), '[^a-z0-9]', '', 'g') as x from c where document_id % 20 = 0),
 f as (select p.*, strpos(joined, p.x) as begins from p join j using (document_id)),
 r as (select chunk_id, f.document_id, count(*) filter (where until < begins) as first_word, count(*) filter (where until < begins + length(f.x) - 1) as last_word from f join e using (document_id) where f.x <> '' and begins > 0 group by chunk_id, f.document_id)"""


def _located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The chunks of the documents asked for among all words of those documents."""
    asked = F.col("document_id") % 20 == 0
    words = _words(B.documents(spark, sf_dir).filter(asked))
    cut = B.chunks(spark, sf_dir).filter(asked).select("chunk_id", "document_id", F.lit(1).alias("page_number"), "content")
    return L.locate(cut, words), words


@query(f"with {_LOCATED} select p.chunk_id, case when r.chunk_id is null then 'none' else 'whole' end as level, first_word, last_word from p left join r using (chunk_id)")
def l2_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _located(spark, sf_dir)
    return found.select("chunk_id", "level", *[F.get("ranges", F.lit(0))[c].cast("bigint").alias(c) for c in ("first_word", "last_word")])


@query(f"""with {_LOCATED} select chunk_id, i // 50 as block_no, i // 10 as line_no, min(i % 10 * 7) as x0, min(i // 10 * 12) as y0, max(i % 10 * 7 + 6) as x1, max(i // 10 * 12 + 10) as y1 from r join w using (document_id) where i between first_word and last_word group by all""")
def l3_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the words that the chunks were located at."""
    found, words = _located(spark, sf_dir)
    return L.boxes(L.matched_words(found, words)).select("chunk_id", *[F.col(c).cast("bigint").alias(c) for c in ("block_no", "line_no", "x0", "y0", "x1", "y1")])


# ---- conversations, libraries ------------------------------------------------------------


@query("""select conv_id as thread_id, conv_id % 10 as user_id, count(*) as n_messages, max(turn) as last_turn from conversations group by conv_id""")
def v1_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = V.thread_list(B.threads(spark, sf_dir), B.messages(spark, sf_dir))
    return listed.select("thread_id", "user_id", "n_messages", F.minute("updated_at").cast("bigint").alias("last_turn"))


@query("""select conv_id as thread_id, conv_id % 10 as user_id, string_agg(concat_ws('|', concat(conv_id, '-', turn), role, text, case when role = 'assistant' then concat('doc_', conv_id, ',doc_', conv_id + turn) else '' end), ';' order by turn) as messages from conversations group by conv_id""")
def v2_thread_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = V.thread_detail(B.threads(spark, sf_dir), B.messages(spark, sf_dir))
    line = lambda m: F.concat_ws("|", m["message_id"], m["role"], m["content"], F.array_join(m["sources"], ","))
    return listed.select("thread_id", "user_id", F.array_join(F.transform("messages", line), ";").alias("messages"))


@query("""with n as (select conv_id, count(*) as n, max(turn) as last from conversations group by conv_id)
 select conv_id as thread_id, n + case when conv_id % 3 = 0 then 2 else 0 end as n_messages, case when conv_id % 3 = 0 then 90 else last end as minutes from n""")
def v5_append_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question and its answer, 90 minutes in, to every third thread."""
    threads, messages = B.threads(spark, sf_dir), B.messages(spark, sf_dir)
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    asked = threads.filter("thread_id % 3 = 0").select("thread_id", F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"))
    turns = asked.select(F.concat_ws("-", "thread_id", "role").alias("message_id"), "thread_id", F.lit(90).cast(messages.schema["turn"].dataType).alias("turn"), "role", F.lit("new").alias("content"), (start + F.make_interval(mins=F.lit(90))).alias("created_at"), F.array().cast("array<string>").alias("sources"))
    after, said = V.append_turns(threads, messages, turns)
    minutes = ((F.unix_timestamp("updated_at") - F.unix_timestamp(start)) / 60).cast("bigint")
    return V.thread_list(after, said).select("thread_id", "n_messages", minutes.alias("minutes"))


@query("""select distinct conv_id as user_id, case when conv_id % 3 = 0 then 'HR' when conv_id % 3 = 1 then 'Management,HR,Finance,User' else 'User' end as groups from conversations""")
def v8_default_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = B.threads(spark, sf_dir).select(F.col("thread_id").alias("user_id"))
    n = F.col("user_id") % 3
    groups = V.default_groups(F.when(n == 0, F.array(F.lit("HR"))), F.when(n == 1, "admin").otherwise("user"))
    return users.select("user_id", _csv(groups).alias("groups"))


@query("""select concat(conv_id, '-', turn) as message_id, row_number() over (partition by conv_id order by turn desc, concat(conv_id, '-', turn) desc) as back from conversations qualify back <= 6""")
def v3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.history(B.messages(spark, sf_dir)).select("message_id", F.col("back").cast("bigint").alias("back"))


@query("""with f as (select conv_id, min_by(text, turn) as t from conversations group by conv_id)
 select conv_id as thread_id, case when conv_id % 2 = 1 then concat('Thread ', conv_id) when length(t) > 50 then concat(substr(t, 1, 50), '...') else t end as title from f""")
def v4_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = B.messages(spark, sf_dir).groupBy("thread_id").agg(F.min_by("content", F.col("turn")).alias("q"))
    return B.threads(spark, sf_dir).join(first, "thread_id").select("thread_id", V.auto_title(F.col("title"), F.col("q"), F.lit(False)).alias("title"))


@query("""select conv_id as thread_id, concat('doc_', conv_id) as source from conversations where role = 'assistant' group by conv_id""")
def v7_latest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest_source(B.messages(spark, sf_dir))


@query("""with t as (select distinct conv_id from conversations where conv_id % 5 <> 0)
 select conv_id as thread_id, case when conv_id % 3 = 0 then concat('Named ', conv_id) when conv_id % 2 = 0 then 'New chat' else concat('Thread ', conv_id) end as title from t""")
def v6_rename_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads, n = B.threads(spark, sf_dir), F.col("thread_id")
    names = threads.select("thread_id", F.when(n % 3 == 0, F.concat(F.lit("  Named "), n, F.lit(" "))).otherwise("  ").alias("new_title"))
    return V.delete(V.rename(threads, names), threads.filter(n % 5 == 0)).select("thread_id", "title")


@query(f"""with {B.D}, {B.C}, n as (select document_id, count(*) as n from c group by document_id) select d.document_id, coalesce(n.n, 0) as n_chunks from d left join n using (document_id)""")
def j6_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = B.chunks(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return B.documents(spark, sf_dir).select("document_id").join(counts, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@query(f"""with {B.D} select 'folder' as kind, source_folder as name, count(*) as n from d group by source_folder union all select 'group', g, count(*) from (select unnest(acl) as g from d) group by g""")
def a1_folders_and_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    folders = docs.groupBy(F.col("source_folder").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("folder").alias("kind"), "name", "n")
    groups = docs.select(F.explode("acl").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("group").alias("kind"), "name", "n")
    return folders.unionByName(groups)
