"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and the pattern for a run of it.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset a temporary folder, but only with a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = context.getConf().get("spark.checkpoint.dir")
        if given is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="lodestream-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` in so many partitions at most: where a session deals small tables out widely, each task costs more than its rows and leaves files of its own."""
    return df if partitions is None else df.coalesce(partitions)


def enough_partitions(spark: SparkSession, shares: int) -> int:
    """A partition for each share of the work, but two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, shares)


class Scratch:
    """Tables of one operator's work in the shared folder: compressed columns, all removed when it is done; once ``partitions`` is set, each in so many files at most."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.partitions: int | None = None

    def few(self, df: DataFrame) -> DataFrame:
        return few(df, self.partitions)

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        self.few(df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> Iterator[None]:
    """While it lasts Arrow batches have so many rows and bytes at most, so texts and packed columns take little memory beside the heap."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in most}
    for k, v in most.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh_name(name: str, df: DataFrame) -> str:
    """``name``, or a longer one where ``df`` has such a column (in any case of letters)."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def sha60(sha_hex: Column) -> Column:
    """The leading 60 bits of a hexadecimal digest, as a long that is never negative."""
    return F.conv(F.substring(sha_hex, 1, 15), 16, 10).cast("long")


def word_count(column: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    trimmed = F.btrim(column, F.lit(WORD_SPACE))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, WORD_GAP))).otherwise(0).cast("long")
