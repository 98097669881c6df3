"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.sources.tables import table

__all__ = ["WORD", "Scratch", "binary", "cut", "dealt", "kept", "record_batch", "row_hash", "shared_dir", "slices", "strings", "table", "unused"]

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run gets a temporary one, and a cluster an error, as its machines would not see each other's files."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="evigraph-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder: later jobs read them there, whatever executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many partitions as there are cores: for narrow rows that are written next, or returned.

    A file for each partition of a shuffle would be many small ones; on a local folder Hadoop also starts three processes (chmod) for each."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def kept(df: DataFrame) -> DataFrame:
    """The rows, kept on the executors' disks from the first job that reads them until unpersist(): for tables that no result depends on. No file is written for them, and what an executor loses is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


class Scratch:
    """A folder below the shared one for tables between jobs. What isn't dropped before goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.store.mkdirs(folder)
        self.store.deleteOnExit(folder)

    def written(self, name: str, df: DataFrame) -> DataFrame:
        """The rows of df, written as a table and read again: a plan of its own."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self.store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def row_hash(id_col: str | Column) -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many signs before it as make it none of df's; names are equal whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in pieces of bounded bytes; a single longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and (size + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def record_batch(columns: dict[str, tuple[pa.DataType, object]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for t, v in columns.values()], names=list(columns))
