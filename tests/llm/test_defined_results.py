"""Nulls, empty tables, repeats, clashing names and large ids."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import labelled, preference, quality_cnn, registry, toxicity_gru

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def conversations(spark, tmp_path):
    def put(rows):
        path = str(tmp_path / str(len(rows)))
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pair_id string, a string, is_chosen int").write.parquet(f"{path}/conversations.parquet")
        return path

    return put


def test_pairs_of_large_and_negative_ids(spark, conversations):
    import duckdb

    big = 1 << 60
    ids = [big, big + 1, big + 2, -1, -2, -3, 0, 1, (1 << 63) - 1]
    rows = [(i, t, "user" if t == 0 else "assistant", f"text {i % 3} {t}", "x", "y", 1) for i in ids for t in (0, 1)] * 2
    path = conversations([*rows, (None, 0, None, None, "x", "y", 1), (4, None, None, None, "x", "y", 1)])
    got = registry.queries()["op6_preference"](spark, path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    want = duck.execute(registry.oracle_sql()["op6_preference"])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert {r["pair_id"] for r in got.collect()} == {big // 2, big // 2 + 1, -1, -2, 0, 2, (1 << 62) - 1}


def test_preference_of_no_rows_and_of_long_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_pairs(empty, F.col("conv_id"), F.lit(True)).count() == 0
    rows = [(c, t, "assistant", "same" if t < 900 else f"{c}") for c in (0, 1) for t in range(1000)]
    one = preference.format_pairs(spark.createDataFrame(rows, empty.schema), F.shiftright("conv_id", 1), F.col("conv_id") == 0).first()
    assert one["n_prompt_turns"] == 900 and len(one["chosen_spans"]) == 100


@pytest.mark.parametrize("module", [quality_cnn, toxicity_gru])
def test_classifiers_on_odd_tables(spark, module):
    docs = spark.createDataFrame([(1, "a b", "en", "a", 1), (1, "a c", "en", "a", 1), (None, None, "en", "a", 0), (None, "", "en", "a", 0), (2, "x " * 100_000, "en", "a", 0)], DOCS).withColumn("__score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (3, 0, 0), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    network = module.train(docs, labels, held_out=9)
    assert module.score(docs.limit(0), network).count() == 0
    scores = module.score(docs, network).collect()
    assert len(scores) == 5 and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] is None}) == 1
    assert module.train(docs.limit(0), labels) is not None and module.train(docs, labels.limit(0)) is not None


def test_accepted_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "a", 1), (None, None, None, None, None)], DOCS).withColumn("__score", F.lit("clash"))
    network = quality_cnn.Network()
    scores = [r["score"] for r in quality_cnn.score(docs, network).collect()]
    kept = quality_cnn.accepted(docs, network, min(scores))
    assert kept.columns == docs.columns and kept.count() == 2
    assert quality_cnn.accepted(docs, network, 1.1).count() == 0
    assert next(iter(network.scores(pa.array(["a b"]))))[0] == pytest.approx(scores[0])


def test_sample_takes_one_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, "b", "en", "a", 1), (1, "c", "en", "a", 1), (2, None, "en", "a", 1), (3, "both", "en", "a", 1)], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1)], "doc_id long, quality int")
    assert labelled.sample(docs, labels, "quality", 5, 9, 10) == (["c", ""], [1, 0])
