"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, langid, license_scan, minhash, mixing, pii, quality, ranked_search, sharding, simhash, succession, url_graph, warc, word_runs
from .common import SPACED_WORD, forget, row_key, staged, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_fuzzy"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = staged(warc.write_archives(warc.page_records(pages)), "warc-archives")
    records = staged(warc.read_archives(archives, payloads=False), "warc-records")
    forget(archives)
    read = warc.checked_revisits(records)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(.*)$", 1).cast("long")
    checked = F.when(F.col("error").isNull(), number(F.col("record_id"))).otherwise(F.raise_error(F.col("error")).cast("long"))
    return read.select(checked.alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


OP3_SQL = """
with rows as (select page_id, coalesce(html, '') as payload, sha256(coalesce(html, '')) as digest from pages),
firsts as (select digest, min(page_id) as first from rows where octet_length(encode(payload)) >= 100 group by digest)
select r.page_id, cast(octet_length(encode(r.payload)) as bigint) as payload_bytes, r.digest as payload_digest,
  case when f.first is null or f.first = r.page_id then 'response' else 'revisit' end as record_type,
  case when f.first <> r.page_id then f.first end as refers_to
from rows r left join firsts f on r.digest = f.digest
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left", "base_failed", "kept")


OP4_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
grams as (select r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
inside as (select r, count(distinct p) as n from (select r, unnest([i, i+1, i+2]) as p from again) group by r),
lines as (select r, source, doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as k from d),
worded as (select r, source, doc_id, l, k, regexp_extract_all(l, '[^\x20\x09-\x0D]+') as lw from lines where regexp_matches(l, '[^\x20\x09-\x0D]')),
dups as (select r, count(*) as n from (select row_number() over (partition by r, l order by k) as c, r from worded) where c > 1 group by r),
normal as (select r, source, doc_id, len(lw) as n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as l from worded),
hosts as (select source, count(distinct doc_id) as n from d group by source),
common as (
  select a.source, a.l from (select source, l, count(distinct doc_id) as n from normal group by source, l) a
  join hosts h on a.source is not distinct from h.source where a.n > 20 and a.n > 0.05 * h.n),
gone as (select x.r, sum(x.n) as n from normal x join common c on x.source is not distinct from c.source and x.l = c.l group by x.r),
c as (
  select d.doc_id, len(d.w) as n_words, len(array_to_string(d.w, '')) as word_chars,
    len(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dups.n, 0) as n_dup_lines,
    coalesce(inside.n, 0) as n_repeat_words, gone.n as gone
  from d left join dups using (r) left join inside using (r) left join gone using (r)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as failed, n_words - coalesce(gone, 0) as n_left from c)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, cast(n_left as bigint) as n_left,
  failed as base_failed, not failed and not (gone is not null and (n_left < 50 or n_left < 0.2 * n_words)) as kept
from v
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))  # a null id has no remainder
    model = langid.train(docs.filter(~held_out))
    return langid.label_language(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(text).alias("text_hash"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    sharded = sharding.shard_rows(docs)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_graph.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A job of one's own takes the key from its secrets; this one makes the query's results repeatable.
PII_KEY = "key of the registered query"


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY).select("doc_id", "n_entities", "kinds", "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i+9], ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
lengths as (select distinct k from windows),
places as (
  select r, p, k, array_to_string(w[p:p+k-1], ' ') as t
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, lengths where len(w) >= k)),
hits as (select r, p, places.k, item_id from places join windows on places.t = windows.t and places.k = windows.k),
spots as (select r, count(distinct q) as n from (select r, unnest(range(p, p + k)) as q from hits) group by r),
found as (select r, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(spots.n, 0) as bigint) as n_hit, cast(coalesce(found.n, 0) as bigint) as n_items,
  sha256(coalesce(found.ids, '')) as items_sha256, coalesce(spots.n, 0) > 0 as contaminated
from d left join spots using (r) left join found using (r)
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.rank_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", "rank", "doc_id", "score")


OP11_SQL = r"""
with words as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
d as (select * from words where len(w) > 0),
b as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select cast(count(*) as bigint) as n_docs, cast(sum(len(w)) as bigint) as n_terms from d),
tf as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) where term in (select term from b) group by r, term),
weights as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, s group by term),
m as (select r, doc_id, 50 + (50 * cast(len(w) as bigint) * n_docs) // n_terms as m from d, s),
parts as (select r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) as part, doc_id from tf join weights using (term) join m using (r)),
scores as (select item_id, r, doc_id, sum(part) as score from parts join b using (term) group by all having sum(part) > 0)
select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score
from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scores) where rank <= 50
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside the next one by id: rows equal in id and text count as one in that order, and a null id comes first."""
    read = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = read.select("doc_id", "text", *row_key(read))
    prints = staged(minhash.minhash(docs.select("doc_id", "one", "two", F.char_length("text").cast("long").alias("n_chars"), "text")).drop("text"), "minhash-prints")
    order = succession.with_next(prints.dropDuplicates(["doc_id", "one", "two"]), ["doc_id", "one", "two"], ["one", "two", "fingerprint"])
    forget(prints)
    # The start of the next document's text goes to the one that asks for it; both joins read texts by the same key, so they share one exchange of texts.
    asks = order.select(F.col("next_one").alias("one"), F.col("next_two").alias("two"), F.col("one").alias("to_one"), F.col("two").alias("to_two"), F.floor(F.col("n_chars") / 4).cast("int").alias("part"), "n_chars", "fingerprint", "next_fingerprint")
    lent = docs.join(asks, ["one", "two"]).select("to_one", "to_two", F.col("doc_id").alias("next_id"), "part", "n_chars", "fingerprint", "next_fingerprint", F.substring("text", F.lit(1), F.col("part")).alias("lent"))
    if order.count() < docs.count():  # a next document that repeats lends its text once
        lent = lent.dropDuplicates(["to_one", "to_two"])
    both = docs.join(lent, (F.col("one") == F.col("to_one")) & (F.col("two") == F.col("to_two")))
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("part")).cast("int")), "lent"))
    edited = edited.withColumn("edited_fingerprint", minhash.fingerprint(F.col("edited")))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), minhash.as_hex(F.col("fingerprint")).alias("fingerprint"), minhash.as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        minhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), minhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "next_id",
    )


def _repeating(text: Column, number: Column) -> Column:
    """op13's texts: in one document in ten, by its number, a piece of it repeats from some word on to the end."""
    g = F.floor(number / 10)

    def from_there_on(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), again), F.lit(1), n), " ")

    words = F.regexp_extract_all(text, F.lit(f"({SPACED_WORD})"), F.lit(1))
    # The one-element array binds the words, so that they are found once.
    edited = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, from_there_on(w))), F.lit(0))
    return F.when(number % 10 == 0, F.coalesce(edited, text)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = docs.select("doc_id", _repeating(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = word_runs.periodic_runs(edited).select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), "runs", "collapsed")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(-1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
with h as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ord(c))), lambda crc, b:
      list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as h from documents),
a as (select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from h),
p as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from a),
d as (select r, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from p),
grams as (select r, n, i, array_to_string(w[i+1:i+6], ' ') as g from (select *, unnest(range(0, n - 5)) as i from d)),
pairs as (select x.r, x.i, x.i - y.i as q from grams x join grams y on x.r = y.r and x.g = y.g and x.i > y.i and 2 * (x.i - y.i) <= x.n),
spots as (select *, i - row_number() over (partition by r, q order by i) as spot from pairs),
met as (select r, q, min(i) - q as start, count(*) + 5 + q as length from spots group by r, q, spot),
runs as (select r, start, length, min(q) as q from met where length >= greatest(12, 2 * q) group by r, start, length),
best as (select distinct on (r) r, start, length, q from runs order by r, length desc, start, q),
listed as (select r, count(*) as n_runs, string_agg(concat(start, ',', length, ',', q, chr(10)), '' order by start, q) as lines from runs group by r),
gone as (select distinct r, unnest(range(start + q, start + length)) as i from runs),
words as (select r, unnest(w) as x, unnest(range(n)) as i from d),
left_over as (select words.r, string_agg(x, ' ' order by words.i) as t from words left join gone on words.r = gone.r and words.i = gone.i where gone.r is null group by words.r)
select d.doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(start as bigint) as start, cast(length as bigint) as length, cast(q as bigint) as period,
  cast(1000 * length // q as bigint) as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from d left join best using (r) left join listed using (r) left join left_over using (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_source_mix, op3_warc, op4_quality, op5_language, op6_shards, op7_url_filter, op8_simhash, op9_surrogates, op10_decontamination, op11_ranked_search, op12_minhash, op13_periodic_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_quality": OP4_SQL, "op10_decontamination": OP10_SQL, "op11_ranked_search": OP11_SQL, "op13_periodic_runs": OP13_SQL}
