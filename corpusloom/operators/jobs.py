"""Whole jobs, from files or requests to the documents and chunks tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..hooks import Embedder, with_embeddings
from . import chunking as C
from . import governance as U
from . import ingest as I
from . import tagging as G


def guarded(split: C.Split) -> C.Split:
    """A split whose failure on one text leaves that text without chunks instead of ending the job."""

    def tried(text: str) -> list[str]:
        try:
            return split(text)
        except Exception:  # reported by the document keeping its old chunks
            return []

    def tried_together(texts: list[str]) -> list[list[str]]:
        try:
            return split.many(texts)
        except Exception:  # one of them fails: each by itself, so that it alone goes without
            return [tried(t) for t in texts]

    if hasattr(split, "many"):
        tried.many = tried_together
    return tried


def split_failures(pages: DataFrame, split: C.Split) -> DataFrame:
    """(document_id, page_number, reason) of the pages (document_id, page_number, text) on which a split fails; blank pages aren't split.

    For the pages of a job that kept the chunks of documents whose split failed: ``guarded``
    lets the job go on, and this tells why.
    """
    kind = pages.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, number, text in zip(batch["document_id"], batch["page_number"], batch["text"], strict=True):
                try:
                    if text and text.strip():
                        split(text)
                except Exception as e:  # any failure of a plugged-in split is what is asked for
                    rows.append((doc, number, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "reason"])

    return pages.select("document_id", F.col("page_number").cast("int").alias("page_number"), "text").mapInPandas(run, f"document_id {kind}, page_number int, reason string")


def direct_records(requests: DataFrame, run_time: Column, embed: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of requests (source_type, source_uri, title, document_type, language, acl, metadata, content): one chunk each, number 0, with the document's access and metadata."""
    fields = ["source_type", "source_uri", "title", "document_type", "language", "content"]
    number = F.sha2(F.to_json(F.struct(*fields)), 256)
    rows = requests.withColumn("document_id", number).dropDuplicates(["document_id"])
    documents = rows.select("document_id", *fields[:-1], run_time.alias("created_at"), F.lit("current").alias("freshness_status"), I.checksum(F.col("content")).alias("checksum"), "acl", run_time.alias("ingested_at"), "metadata")
    chunks = rows.select(F.sha2(F.concat_ws("#", "document_id", F.lit(0)), 256).alias("chunk_id"), "document_id", F.lit(0).alias("chunk_index"), "content", "language", "acl", "metadata", F.lit("current").alias("freshness_status"))
    return documents, chunks if embed is None else with_embeddings(chunks, embed)


def found_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text) of stored documents, from pages (path, page_number, text) of the files that are there.

    A document's file is the one at its path; where there is none, the first by path of those
    with its base name. Documents without either have no pages.
    """
    base = lambda path: F.element_at(F.split(path, "/"), -1)
    files = pages.select("path").distinct().withColumn("at", I.relative_path(F.col("path")))
    wanted = documents.select("document_id", I.uri_path(F.col("source_uri")).alias("at"))
    exact = wanted.join(files.groupBy("at").agg(F.min("path").alias("path")), "at").select("document_id", "path")
    named = files.groupBy(base(F.col("at")).alias("name")).agg(F.min("path").alias("path"))
    rest = wanted.join(exact, "document_id", "left_anti").withColumn("name", base(F.col("at"))).join(named, "name").select("document_id", "path")
    return exact.unionByName(rest).join(pages, "path").select("document_id", "page_number", "text")


def rechunked(documents: DataFrame, chunks: DataFrame, pages: DataFrame, split: C.Split, mode: str = C.ISOLATED, overlap: int = 0, embed: Embedder | None = None) -> DataFrame:
    """The chunks table with every stored document split anew from its file; ``pages``: (path, page_number, text).

    Documents whose file is missing, that split to nothing or whose split fails keep the
    chunks they have. New chunks inherit language, access, metadata and freshness.
    """
    cut = C.split_pages(found_pages(documents, pages), guarded(split), mode, overlap)
    fresh = I.chunk_rows(cut, documents)
    if embed is not None:
        fresh = with_embeddings(fresh, embed)
    done = cut.select("document_id").distinct()
    missing = [c for c in chunks.columns if c not in fresh.columns]
    kinds = {f.name: f.dataType for f in chunks.schema}
    fresh = fresh.withColumns({c: F.lit(None).cast(kinds[c]) for c in missing}).select(chunks.columns)
    return I.replaced(chunks, done, fresh)


def analysed(files: DataFrame, pages: DataFrame, keywords: DataFrame, categories: DataFrame, run_date: Column) -> DataFrame:
    """What the rules say of every file: (path, tenant_id, checksum, released, language, department, acl).

    ``files``: (path, tenant_id, content, modified); ``pages``: (path, page_number, text);
    ``keywords``: (key, term) of the categories. Stands in for a model's answers.
    """
    texts = G.page_texts(pages.withColumnRenamed("path", "document_id"))
    dated = G.first_date(F.get(G.date_candidates(F.col("full_text")), F.lit(0)))
    told = texts.select(F.col("document_id").alias("t_path"), dated.alias("said"), G.language_by_stop_words(tokens(F.col("full_text"))).alias("language"))
    terms = pages.filter("page_number <= 2").select(F.col("path").alias("document_id"), F.explode(tokens(F.col("text"))).alias("term"))
    kinds = G.category_by_keywords(terms, keywords).withColumnsRenamed({"document_id": "c_path", "category_key": "said_key"})
    rows = files.select("path", "tenant_id", I.checksum(F.col("content")).alias("checksum"), "modified")
    joined = rows.join(told, F.col("path") == F.col("t_path"), "left").join(kinds, F.col("path") == F.col("c_path"), "left")
    joined = joined.withColumn("department", F.coalesce("said_key", F.lit("user")))
    joined = joined.join(F.broadcast(categories.select("key", "allowed_groups")), F.col("department") == F.col("key"), "left")  # configuration
    released = G.release_date(F.col("said"), F.lit(None).cast("date"), F.col("modified"), run_date)
    return joined.select("path", "tenant_id", "checksum", released.alias("released"), F.coalesce("language", F.lit(next(iter(G.STOP_WORDS)))).alias("language"), "department", U.category_groups(categories).alias("acl"))


def full_reindex(files: DataFrame, pages: DataFrame, keywords: DataFrame, categories: DataFrame, run_time: Column, split: C.Split, mode: str = C.ISOLATED, overlap: int = 0, embed: Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, relations) of all files: analysed, put in the order of their dates, related to earlier ones, split and embedded.

    Documents and relations hold no texts and are kept while the job runs (persist(), which
    a lost executor makes Spark work out again); unpersist them once all three are written.
    """
    known = analysed(files, pages, keywords, categories, run_time.cast("date"))
    metadata = U.merged(I.folder_metadata(I.relative_path(F.col("path"))), F.create_map(F.lit("department"), F.col("department"), F.lit("created_at"), F.col("released").cast("string")))
    rows = known.select("path", "tenant_id", "checksum", "language", "acl", F.lit("current").alias("freshness_status"), metadata.alias("metadata"))
    documents = I.document_rows(rows, run_time).persist()
    numbered = pages.withColumn("document_id", F.sha2(I.file_uri(F.col("path")), 256))
    ordered = G.chronological(documents, F.col("metadata")["created_at"])
    sentences = numbered.select("document_id", F.explode(C.sentences(F.col("text"))).alias("sentence"))
    relations = G.relations_by_rule(sentences, ordered.join(G.relation_candidates(documents).select("document_id"), "document_id", "left_semi")).persist()
    cut = C.split_pages(numbered, guarded(split), mode, overlap)
    chunks = U.archive_chunks(I.chunk_rows(cut, documents), relations)
    if embed is not None:
        chunks = with_embeddings(chunks, embed)
    return U.apply_relations(documents, relations), chunks, relations
