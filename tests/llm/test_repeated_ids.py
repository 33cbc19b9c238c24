"""Near duplicates of rows whose ids repeat or are null."""

import corpus_pipeline


def test_rows_are_linked_by_their_own_text(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(40)) for w in ("a", "b", "c", "d"))
    rows = [(5, one), (5, two), (5, three), (1, three), (None, four), (None, four), (None, one), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got.collect())) == [(False, 1, three), (False, 5, one), (False, 5, two), (False, 7, ""), (False, 7, ""), (True, 0, four)]
