"""Incremental ingest: new and changed text files become documents and chunks, run after run.

A batch reads its files once, into a table of its own; documents, chunks, errors and metrics
come from that. The store's documents lie in slots by a hash of their id, so a batch looks
up earlier versions in the slots of its own documents alone, and there their checksums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import window_array
from ..operators.ingest import checksum, file_uri
from ..sources.store import file_system

DOCUMENTS = "document_id string, source_uri string, checksum string, text string, batch bigint"
CHUNKS = "document_id string, chunk_index int, content string, batch bigint"
METRICS = "batch bigint, rows_in bigint, new bigint, changed bigint, unchanged bigint, rejected bigint"
ERRORS = "path string, reason string, batch bigint"
PROGRESS = "batch bigint, step int, phase string, processed bigint, total bigint, error string, at timestamp"
#: Parts of the documents table; a batch opens those of its own documents.
SLOTS = 256


def slot_of(document_id: Column) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(SLOTS)).cast("int")


def versions(spark: SparkSession, store: str, slots: list[int] | None = None) -> DataFrame:
    """(document_id, batch, checksum) of every version, of some slots or of all; no texts."""
    rows = spark.read.schema(f"{DOCUMENTS}, run bigint, slot int").parquet(f"{store}/documents")
    return (rows if slots is None else rows.filter(F.col("slot").isin(slots))).select("document_id", "batch", "checksum")


def current(spark: SparkSession, store: str) -> DataFrame:
    """The newest version of every document in the store."""
    live = versions(spark, store).groupBy("document_id").agg(F.max("batch").alias("batch"))
    rows = spark.read.schema(DOCUMENTS).parquet(f"{store}/documents").select("document_id", "source_uri", "checksum", "text", "batch")
    return rows.join(live, ["document_id", "batch"]).select("document_id", "batch", "source_uri", "checksum", "text")


def current_chunks(spark: SparkSession, store: str) -> DataFrame:
    live = versions(spark, store).groupBy("document_id").agg(F.max("batch").alias("batch"))
    return spark.read.schema(CHUNKS).parquet(f"{store}/chunks").join(live, ["document_id", "batch"])


def progress(spark: SparkSession, store: str) -> DataFrame:
    """The last step of every batch: its phase, files done of all, and what ended it."""
    rows = spark.read.schema(PROGRESS).parquet(f"{store}/progress").select("batch", "step", "phase", "processed", "total", "error", "at")
    return rows.groupBy("batch").agg(F.max_by(F.struct("phase", "processed", "total", "error", "at"), "step").alias("p")).select("batch", "p.*")


def _incoming(batch: DataFrame, batch_id: int) -> DataFrame:
    """What a batch's files are: (path, slot, document_id, source_uri, checksum, text, modified, reason); a reason tells why a file is no document."""
    uri = file_uri(F.col("path"))
    reason = F.when(~F.lower("path").endswith(".txt"), F.concat(F.lit("unsupported extension: "), F.regexp_extract("path", r"(\.[^./]*)?$", 1))).when(~F.expr("is_valid_utf8(content)"), "no UTF-8 text")
    number = F.sha2(uri, 256)
    return batch.select("path", slot_of(number).alias("slot"), number.alias("document_id"), uri.alias("source_uri"), checksum(F.col("content")).alias("checksum"), F.when(reason.isNull(), F.decode("content", "UTF-8")).alias("text"), F.col("modificationTime").alias("modified"), reason.alias("reason"), F.lit(batch_id).cast("bigint").alias("batch"))


def ingest_batch(batch: DataFrame, batch_id: int, store: str, size: int, overlap: int) -> None:
    """Versions are appended under the batch's number; a batch that runs again overwrites its own folders, so retries add nothing."""
    spark = batch.sparkSession
    for name, schema in (("documents", f"{DOCUMENTS}, slot int"), ("chunks", CHUNKS), ("metrics", METRICS), ("errors", ERRORS), ("progress", PROGRESS)):
        empty = spark.createDataFrame([], schema).write.mode("ignore")
        (empty.partitionBy("slot") if name == "documents" else empty).parquet(f"{store}/{name}/run=-1")
    place = lambda name: f"{store}/{name}/run={batch_id}"
    step = 0

    def tell(phase: str, processed: int = 0, total: int = 0, error: str | None = None) -> None:
        nonlocal step
        row = spark.createDataFrame([(batch_id, step, phase, processed, total, error)], PROGRESS.rsplit(",", 1)[0]).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append" if step else "overwrite").parquet(place("progress"))
        step += 1

    def written(rows: DataFrame, name: str, mode: str = "overwrite", by: str | None = None) -> int:
        """Rows that a write made, counted on their way."""
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode)
        (writer.partitionBy(by) if by else writer).parquet(place(name))
        return seen.get["n"]

    total = 0
    try:
        tell("reading")
        total = written(_incoming(batch, batch_id), "incoming")
        incoming = spark.read.parquet(place("incoming"))
        rejected = written(incoming.filter("reason is not null").select("path", "reason", "batch"), "errors")
        tell("comparing", rejected, total)
        good = incoming.filter("reason is null")
        rows = good.groupBy("document_id").agg(F.max(F.struct("modified", "source_uri", "checksum", "text", "slot")).alias("v")).select("document_id", "v.source_uri", "v.checksum", "v.text", "v.slot")
        slots = [r[0] for r in good.select("slot").distinct().collect()]  # SLOTS numbers at most
        earlier = versions(spark, store, slots).filter(F.col("batch") < batch_id)
        before = earlier.groupBy("document_id").agg(F.max_by("checksum", "batch").alias("old"))
        change = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("checksum"), "unchanged").otherwise("changed")
        marked = rows.join(before, "document_id", "left").withColumn("change", change).withColumn("batch", F.lit(batch_id).cast("bigint"))
        of = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
        seen = Observation()
        told = marked.observe(seen, F.count(F.lit(1)).alias("n"), of("new"), of("changed"), of("unchanged"))
        told.filter("change <> 'unchanged'").select("document_id", "source_uri", "checksum", "text", "batch", "slot").write.mode("overwrite").partitionBy("slot").parquet(place("documents"))
        counts = seen.get
        tell("splitting", rejected + counts["unchanged"], total)
        fresh = spark.read.schema(f"{DOCUMENTS}, slot int").parquet(place("documents"))
        cut = fresh.select("document_id", F.posexplode(window_array(F.col("text"), size, overlap)).alias("chunk_index", "w"), "batch")
        written(cut.select("document_id", "chunk_index", F.col("w.content").alias("content"), "batch"), "chunks")
        spark.createDataFrame([(batch_id, total, counts["new"], counts["changed"], counts["unchanged"], rejected)], METRICS).coalesce(1).write.mode("overwrite").parquet(place("metrics"))
        where, fs = file_system(spark, place("incoming"))
        fs.delete(where, True)
        tell("done", total, total)
    except Exception as e:
        tell("failed", 0, total, str(e)[:2000])
        raise


def start(spark: SparkSession, folder: str, store: str, checkpoint: str, size: int = 1500, overlap: int = 250) -> StreamingQuery:
    """Takes in all files that are there and ends; run it again for what comes later. Only text files become documents."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(folder)
    return files.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, store, size, overlap)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
