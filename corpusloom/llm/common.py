"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whole input row, kept under one name so that no input column can clash with a working column.
ROW = "_cl_row"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of text whose A-Z are lower case already.
LOWERED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bare(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    return F.struct(*[bare(c) for c in df.columns]).alias(ROW)


def unpacked(df: DataFrame, columns: list[str], outputs: dict[str, Column]) -> DataFrame:
    """The packed input columns followed by the outputs; an output replaces an input column of its name."""
    taken = {name.lower() for name in outputs}
    kept = [F.col(ROW)["" + c].alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in outputs.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in a session on this machine alone, one of our own where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete staged tables. For those alone whose readers have all been staged themselves; others are left as they are."""
    for table in tables:
        if path := getattr(table, "staged_path", None):
            jvm, sc = table.sparkSession._jvm, table.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes, ``one`` and ``two``, of all columns: rows that agree on both are equal. Maps are hashed as JSON."""
    parts = [F.to_json(F.struct(bare(f.name))) if "map<" in f.dataType.simpleString() else bare(f.name) for f in df.schema]
    # A null is skipped by the hash, so its place is told apart by the flag.
    flags = F.concat_ws("", *[p.isNull().cast("int").cast("string") for p in parts])
    return [F.xxhash64(F.lit(k), flags, *parts).alias(name) for k, name in ((1, "one"), (2, "two"))]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() does just that, and faster, for pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lowered_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({LOWERED_WORD})"), F.lit(1))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, so that reruns and retried tasks agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))
