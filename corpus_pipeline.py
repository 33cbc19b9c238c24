"""The corpus pipeline: five stages from raw documents to shards of training text.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
``run`` writes its rows as Parquet in the shared checkpoint folder and reads them again
for the next one. All stages but the last return the columns of ``documents``; the last
adds the shard, the slot and the size.

Defined results of every stage: null and empty texts are documents without words; rows are
judged each by its own text, also where ids repeat or are null; rows that repeat are copies;
an empty table gives no rows; further columns are passed on, whatever their names (but for
``shard``, ``slot`` and ``size``, which the last stage sets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import decontaminate, mixing, ngram_join, quality_cnn, sharding
from lodestream.llm.common import Scratch, checkpoint, enough_partitions, few, fresh_name, table

#: Documents whose score is under it are rejected.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network does not reject; fitted on labelled documents of the input."""
    network = quality_cnn.train(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    return quality_cnn.accepted(docs, network, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join: that with the least id, null last; rows are linked each by its own text, also where ids repeat."""
    key = fresh_name("__row", docs)
    rows = Scratch(spark).keep(docs.withColumn(key, F.monotonically_increasing_id()))
    linked = ngram_join.link_documents(rows, id_col=key).select(F.col("id").alias(key), F.col("component_id").alias("__component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("row"))).alias("first")
    most = enough_partitions(spark, rows.rdd.getNumPartitions())  # those of the scan, which follow the bytes
    found = few(rows.select("doc_id", key).join(linked, key), most)
    kept = few(found.groupBy("__component").agg(first), most).select(F.col("first.row").alias(key))
    return few(rows.join(kept, key, "left_semi"), most).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each time that it takes the whole document, and one for each part of a document at an end of the seeded run."""
    return mixing.take(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in contiguous shards of nearly equal bytes, equal texts together; a copy of a text has its own slot."""
    return sharding.shard_rows(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Learned filters and graph components are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    try:
        for _, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir))
        return checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        scratch.remove()
