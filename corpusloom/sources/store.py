"""Tables that are kept in the folder that all machines share, and used again as long as what they were made from is the same."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in a session on this machine alone, one of our own where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def mark(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.create(where, True).close()


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = file_system(spark, path)
    return fs.exists(where)


def print_of(spark: SparkSession, *paths: str) -> str:
    """Changes with the name, length or time of any file below the paths."""
    digest = hashlib.sha256()
    for path in paths:
        where, fs = file_system(spark, path)
        files, told = fs.listFiles(where, True), []
        while files.hasNext():
            f = files.next()
            told.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
        digest.update("\n".join([path, *sorted(told), ""]).encode())
    return digest.hexdigest()[:16]


def kept(spark: SparkSession, label: str, made_from: tuple[str, ...], build: Callable[[str], None]) -> str:
    """A folder that ``build`` has filled; it is filled once for each state of the files ``made_from``, and only a whole one counts."""
    folder = f"{shared_folder(spark).rsplit('/', 1)[0]}/corpusloom-{label}-{print_of(spark, *made_from)}"
    if not exists(spark, f"{folder}/_whole"):
        build(folder)
        mark(spark, f"{folder}/_whole")
    return folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once, and its size is known to the planner."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
