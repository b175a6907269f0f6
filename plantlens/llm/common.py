"""Shared pieces: table access, tables in the shared folder, byte-level word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a temporary one, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the lineage ends there and lost executors cost no rework.

    The tables of a result must outlive it; they go when the shared folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more, such as those of a round before the last."""
    for df in tables:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, as texts are long; a number the session names stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def byte_map(keep: set[int]) -> bytes:
    """A table for bytes.translate: A-Z to a-z, bytes of `keep` as they are, any other to a space."""
    out = bytearray(b" " * 256)
    for b in keep:
        out[b] = b
    for b in range(ord("A"), ord("Z") + 1):
        if b in keep:
            out[b] = b + 32
    return bytes(out)


#: Words of letters, digits and all non-ASCII characters (their UTF-8 bytes are 0x80 and up).
ALNUM = byte_map({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})
#: Words between ASCII white space.
SPACED = byte_map(set(range(256)) - {0x20, *range(0x09, 0x0E)})


def utf8(text: str | None) -> bytes:
    """Null is empty; a lone surrogate, which Parquet cannot hold, is replaced."""
    return text.encode("utf-8", "replace") if text else b""


def alnum_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM).split()


def spaced_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(SPACED).split()
