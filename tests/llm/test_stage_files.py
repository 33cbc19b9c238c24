"""Stages of the pipeline leave few files of a small table, however many partitions the session shuffles to."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_join_tasks import wide


def test_stages_leave_few_files(spark):
    texts = [(i, f"some words of text {i} and {i % 7} more", "en", f"s{i % 3}", 30) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    most = 2 * spark.sparkContext.defaultParallelism
    want = corpus_pipeline.mixed(spark, docs, "").groupBy("doc_id").count().collect()
    with wide(spark):
        mixed, sharded = corpus_pipeline.mixed(spark, docs, ""), corpus_pipeline.sharded(spark, docs, "")
        assert mixed.rdd.getNumPartitions() <= most and sharded.rdd.getNumPartitions() <= most
        assert sorted(mixed.groupBy("doc_id").count().collect()) == sorted(want)
        assert sharded.select("shard", "slot").distinct().count() == 200
        assert sharded.agg(F.count("*")).first()[0] == 200
