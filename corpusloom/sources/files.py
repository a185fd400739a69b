"""Reading files and configuration, writing snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_page

EXTENSIONS = (".pdf", ".txt")
#: The categories that hold where no configuration is given.
DEFAULT_CATEGORIES = (
    (0, "management", "Management", "Leadership and organisation", "Management", ("Management",)),
    (1, "hr", "HR", "People and personnel", "HR", ("Management", "HR")),
    (2, "finance", "Finance", "Money and contracts", "Finance", ("Management", "Finance")),
    (3, "user", "User", "For everyone", "User", ("Management", "HR", "Finance", "User")),
)
CATEGORY_SCHEMA = "ord int, key string, label string, description string, role_name string, allowed_groups array<string>"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def scan_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, modificationTime, length, content of all files below with an extension, in any case; a missing folder is empty."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    wanted = "|".join(e.replace(".", r"\.") for e in extensions)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.lower("path").rlike(f"(?:{wanted})$"))


def text_pages(files: DataFrame) -> DataFrame:
    """A text file is one page, number 1, as it is."""
    return files.filter(F.lower("path").endswith(".txt")).select("path", F.lit(1).alias("page_number"), F.decode("content", "UTF-8").alias("text"))


def cleaned_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", clean_page(F.coalesce("text", F.lit(""))))


def rejected(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files of unknown kind, with a reason."""
    wanted = "|".join(e.replace(".", r"\.") for e in extensions)
    return files.filter(~F.lower("path").rlike(f"(?:{wanted})$")).select("path", F.concat(F.lit("unsupported extension: "), F.regexp_extract("path", r"(\.[^./]*)?$", 1)).alias("reason"))


def load_categories(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The configured categories in order, or the default ones."""
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([(o, k, a, d, r, list(g)) for o, k, a, d, r, g in DEFAULT_CATEGORIES], CATEGORY_SCHEMA)
    kind = "struct<key:string,label:string,description:string,role_name:string,allowed_groups:array<string>>"
    read = spark.read.schema(f"categories array<{kind}>").option("multiLine", True).json(path)
    return read.select(F.posexplode("categories").alias("ord", "c")).select("ord", "c.key", "c.label", "c.description", "c.role_name", "c.allowed_groups")


def write_snapshot(documents: DataFrame, chunks: DataFrame, folder: str, number: int) -> None:
    """A full refresh: both tables under a new number, chunks by tenant, and a mark once they are whole, by which readers switch."""
    place = f"{folder}/snapshot={number}"
    documents.write.mode("overwrite").parquet(f"{place}/documents")
    chunks.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{place}/chunks")
    jvm, sc = documents.sparkSession._jvm, documents.sparkSession.sparkContext
    mark = jvm.org.apache.hadoop.fs.Path(f"{place}/_whole")
    mark.getFileSystem(sc._jsc.hadoopConfiguration()).create(mark, True).close()


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of the newest whole snapshot."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot=*/_whole")
    marks = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    places = [m.getPath().getParent().toString() for m in marks or []]
    if not places:
        raise FileNotFoundError(f"no whole snapshot in {folder}")
    newest = max(places, key=lambda p: int(p.rsplit("=", 1)[1]))
    return spark.read.parquet(f"{newest}/documents"), spark.read.parquet(f"{newest}/chunks")


def document_chunks(chunks: DataFrame, document_id) -> DataFrame:
    return chunks.filter(F.col("document_id") == document_id).orderBy("chunk_index")
