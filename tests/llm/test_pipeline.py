"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
from lodestream.llm import decontaminate, ngram_join

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
        if name == "near_duplicates":
            linked = ngram_join.link_documents(docs)
            assert linked.where("id <> component_id").count() == 0
            assert counts[-1] == ngram_join.link_documents(before).select("component_id").distinct().count()
        if name == "decontamination":
            assert decontaminate.contaminated_pairs(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    assert docs.select("shard", "slot").distinct().count() == counts[5] and docs.where("shard not between 0 and 23").count() == 0
