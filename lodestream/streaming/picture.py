"""The picture's change log: deltas with gapless numbers, and what they add up to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Whole-object upserts and removals between two states: key, op, value."""
    old = before.select(F.col(key).alias("key"), F.col(value).alias("old"))
    new = after.select(F.col(key).alias("key"), F.col(value).alias("value"))
    op = F.when(F.col("value").isNull(), "remove").when(F.col("old").isNull() | (F.col("old") != F.col("value")), "upsert")
    return old.join(new, "key", "full_outer").withColumn("op", op).where("op is not null").select("key", "op", "value")


def numbered(delta: DataFrame, last_seq: int) -> DataFrame:
    """Numbers from ``last_seq`` + 1 on, by key. A delta is what one step changed, not the whole picture."""
    return delta.withColumn("seq", (F.row_number().over(Window.orderBy("key")) + last_seq).cast("long"))


def snapshot(log: DataFrame) -> DataFrame:
    """The picture that a log adds up to: the last upsert of each key that is not removed after it."""
    last = log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("last"))
    return last.where("last.op = 'upsert'").select("key", "last.value", "last.seq")


def resume(log: DataFrame, last_seen: int) -> tuple[str, DataFrame]:
    """What a client that has seen ``last_seen`` gets: the deltas after it, or a snapshot if the log does not reach back."""
    first = log.agg(F.min("seq")).first()[0]
    if first is not None and first <= last_seen + 1:
        return "deltas", log.where(F.col("seq") > last_seen)
    return "snapshot", snapshot(log)


#: Batches after which the picture is kept whole, so that a batch reads that and the few deltas after it.
KEEP_EVERY = 20


def _kept(spark: SparkSession, folder: str, before: int) -> int:
    """The last batch before ``before`` at which the picture was kept; -1 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))  # noqa: E731  a half-written one does not count
    names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((n for p in names if (n := int(p.getName().partition("=")[2])) < before and whole(p)), default=-1)


def standing(spark: SparkSession, path: str, before: int) -> tuple[DataFrame, int]:
    """The picture (key, value) as batches before ``before`` left it, and the last number given: from the last kept picture and the deltas after it."""
    kept = _kept(spark, f"{path}.kept", before)
    rows = spark.createDataFrame([], "key string, op string, value string, seq long")
    if kept >= 0:
        rows = spark.read.schema(rows.schema).parquet(f"{path}.kept/batch={kept}")
    try:
        rows = rows.unionByName(spark.read.parquet(path).where((F.col("batch") > kept) & (F.col("batch") < before)).select("key", "op", "value", "seq"))
    except AnalysisException:  # the first batch: there is no log yet
        pass
    last = rows.agg(F.max("seq")).first()[0] or 0
    return snapshot(rows.where("key IS NOT NULL")).select("key", "value"), last


def publish(stream: DataFrame, path: str, key: str, value: str, order: str, checkpoint: str, keep_every: int = KEEP_EVERY):
    """Append each micro-batch's changes to the log at ``path``: the latest row of each key by ``order``, where its value is new; null removes.

    Numbers go on from the last one without a gap. What a batch reads is the picture as last
    kept and the deltas since, so it does not grow with the log. A batch that is run again
    finds both as they were before it and writes its own folders anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(value), F.col(order)).alias("value"))
        known, last = standing(spark, path, number)
        known = known.withColumnRenamed("value", "old")
        op = F.when(F.col("value").isNull() & F.col("old").isNotNull(), "remove").when(F.col("value").isNotNull() & ~F.col("old").eqNullSafe(F.col("value")), "upsert")
        delta = latest.join(known, "key", "left").withColumn("op", op).where("op is not null").select("key", "op", "value")
        numbered(delta, last).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % keep_every == 0:
            now, last = standing(spark, path, number + 1)
            mark = spark.createDataFrame([(None, "mark", None, last)], "key string, op string, value string, seq long")  # the last number, also if that was a removal
            now.select("key", F.lit("upsert").alias("op"), "value", F.lit(0).cast("long").alias("seq")).unionByName(mark).write.mode("overwrite").parquet(f"{path}.kept/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def record(log: DataFrame, run_id: str) -> DataFrame:
    """The lines of a recording: a greeting, then every change, as JSON in the order of their numbers."""
    hello = log.sparkSession.createDataFrame([(0, "hello", None, None)], "seq long, op string, key string, value string")
    rows = hello.unionByName(log.select("seq", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")))
    line = F.to_json(F.struct(F.lit(run_id).alias("run_id"), F.when(F.col("seq") > 0, F.col("seq")).alias("seq"), "op", "key", "value"))
    return rows.orderBy("seq").select(line.alias("value"))


def health(query) -> dict:
    """Counters of a running query: its last batch, rows taken and rates."""
    progress = query.lastProgress or {}
    return {"batch": progress.get("batchId"), "rows": progress.get("numInputRows", 0), "rows_per_second": progress.get("processedRowsPerSecond", 0.0), "active": query.isActive, "error": str(query.exception()) if query.exception() else None}
