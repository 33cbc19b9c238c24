"""What the language model's counting sends at once."""

import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import bloom_lm
from lodestream.llm.words_np import mix64

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_counts_go_out_in_small_batches_and_none_is_lost():
    keys = [np.sort(mix64(np.arange(s, s + 5000, dtype=np.uint64))) for s in (1, 9000)]
    held = [(k, np.arange(len(k))) for k in keys]
    batches = list(bloom_lm._sent(held, 700))
    assert max(b.num_rows for b in batches) <= bloom_lm.SENT_BLOCKS
    numbers = [n for b in batches for n in b.column(0).to_pylist()]
    assert numbers == sorted(set(numbers))
    for i, (k, n) in enumerate(held):
        got = [np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for b in batches for x in b.column(c)]) for c in (1 + 2 * i, 2 + 2 * i)]
        assert (got[0].view(np.uint64) == k).all() and (got[1] == n).all()


def test_model_takes_small_batches(spark, monkeypatch):
    """Arrow batches are small in both passes over the texts, and the session is left as it was."""
    seen, before = [], spark.conf.get(BATCH)
    for name in ("train", "score"):
        real = getattr(bloom_lm, name)
        monkeypatch.setattr(bloom_lm, name, lambda *a, real=real: seen.append(int(spark.conf.get(BATCH))) or real(*a))
    docs = spark.createDataFrame([(i, f"a b c {i % 3}") for i in range(30)], "doc_id long, text string")
    assert bloom_lm.score_documents(docs, F.lit(False)).count() == 30
    assert len(seen) == 2 and max(seen) <= 1000 and spark.conf.get(BATCH) == before
