"""Stages of the pipeline against brute force that shares no code with them."""

import corpus_pipeline
from test_pairs import SCHEMA, brute_components, corpus, rows, sets_of


def test_near_duplicates_are_brute_force(spark):
    docs = rows(corpus())
    root = brute_components({i: sets_of(t) for i, t in enumerate(corpus())})
    want = [docs[i] for i in sorted(set(root.values()))]
    got = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "").collect()), key=lambda r: r[0])
    assert got == want and len(want) < len(docs)
