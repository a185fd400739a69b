"""Ingest: paths, checksums, change detection, document and chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ACL = ("Public",)
#: Metadata keys that name the folder of a document.
FOLDER_KEYS = ("source_folder", "folder")


def relative_path(path: Column) -> Column:
    """What follows the last /data/, else the base name; forward slashes."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.contains(unix, F.lit("/data/")), F.element_at(F.split(unix, "/data/"), -1)).otherwise(F.element_at(F.split(unix, "/"), -1))


def file_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), relative_path(path))


def uri_path(uri: Column) -> Column:
    """The path in file://path and azure://container/path; other values as they are."""
    return F.when(uri.startswith("file://"), F.substr(uri, F.lit(8))).when(uri.startswith("azure://"), F.regexp_extract(uri, r"^azure://[^/]*/(.*)$", 1)).otherwise(uri)


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def title_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def folder_metadata(path: Column) -> Column:
    """A map with the folder under both keys; empty for files at the root."""
    folder = folder_of(path)
    empty = F.create_map().cast("map<string,string>")
    return F.when(folder != "", F.create_map(*[x for k in FOLDER_KEYS for x in (F.lit(k), folder)])).otherwise(empty)


def type_of(path: Column) -> Column:
    return F.when(F.contains(F.lower(path), F.lit("policy")), "policy").otherwise("document")


def safe_name(name: Column) -> Column:
    kept = F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "")
    return F.when(kept == "", name).otherwise(kept)


def created_at(metadata: Column, run_time: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(metadata["created_at"]), run_time)


def classify(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``incoming`` (source_uri, checksum, ...) with ``existing_id`` and ``change``: new, unchanged or changed.

    A path that is stored under several addresses is one document, that of the smallest id.
    """
    known = existing.groupBy(uri_path(F.col("source_uri")).alias("path")).agg(F.min(F.struct("document_id", "checksum")).alias("e"))
    known = known.select("path", F.col("e.document_id").alias("existing_id"), F.col("e.checksum").alias("existing_checksum"))
    joined = incoming.withColumn("path", uri_path(F.col("source_uri"))).join(known, "path", "left")
    change = F.when(F.col("existing_id").isNull(), "new").when(F.col("checksum") == F.col("existing_checksum"), "unchanged").otherwise("changed")
    return joined.withColumn("change", change).drop("path", "existing_checksum")


def refreshed(stored: DataFrame, updates: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``stored`` (documents or chunks) with the non-null values of ``updates`` by document_id."""
    new = updates.select("document_id", *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = stored.join(new, "document_id", "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def replaced(stored: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` without the documents of ``gone``, and ``fresh`` rows; for documents and chunks alike."""
    return stored.join(gone.select("document_id"), "document_id", "left_anti").unionByName(fresh)


def document_rows(files: DataFrame, run_time: Column) -> DataFrame:
    """Rows of the documents table from (path, tenant_id, content, metadata, acl, language, freshness_status); a ``checksum`` may stand for the content."""
    path = relative_path(F.col("path"))
    uri = F.concat(F.lit("file://"), path)
    return files.select(
        F.sha2(uri, 256).alias("document_id"), "tenant_id", F.lit("file").alias("source_type"), uri.alias("source_uri"), title_of(path).alias("title"), type_of(path).alias("document_type"), "language",
        created_at(F.col("metadata"), run_time).alias("created_at"), F.coalesce("freshness_status", F.lit("current")).alias("freshness_status"), (F.col("checksum") if "checksum" in files.columns else checksum(F.col("content"))).alias("checksum"),
        F.coalesce("acl", F.array(*[F.lit(g) for g in DEFAULT_ACL])).alias("acl"), run_time.alias("ingested_at"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def chunk_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks (document_id, chunk_index, content, page_number, section_title) with what they inherit."""
    inherited = documents.select("document_id", "tenant_id", "language", "acl", "metadata", "freshness_status", "created_at")
    joined = chunks.join(inherited, "document_id")
    return joined.withColumn("chunk_id", F.sha2(F.concat_ws("#", "document_id", "chunk_index"), 256)).withColumn("content_hash", checksum(F.col("content")))


def by_rules(files: DataFrame, rules: DataFrame, name: Column) -> DataFrame:
    """The first rule (ord, needle, acl, freshness_status, department) whose needle the lower-cased name holds; a null needle fits all.

    ``rules`` is a configuration table of a few rows, collected into one array literal side.
    """
    listed = F.broadcast(rules.agg(F.array_sort(F.collect_list(F.struct("ord", "needle", "acl", "freshness_status", "department"))).alias("rules")))
    first = F.get(F.filter("rules", lambda r: r["needle"].isNull() | F.contains(F.lower(name), r["needle"])), F.lit(0))
    return files.crossJoin(listed).withColumn("rule", first).select(*files.columns, "rule.acl", "rule.freshness_status", "rule.department")
