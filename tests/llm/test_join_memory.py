"""What the n-gram join sends and holds: signatures as many as can be spoiled, hot buckets cut, small Arrow batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import ngram_join
from lodestream.llm.words_np import mix64

SCHEMA = "doc_id long, text string"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("percent", [50, 65, 80, 90])
def test_similar_sets_share_a_signature_at_any_threshold(percent):
    """Sets at the largest difference allowed, for each size of band."""
    rng, signer = np.random.default_rng(3), ngram_join.Signer([], percent)
    for n in [8, 15, 16, 40, 63, 100, 127, 128, 250, 500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = ngram_join.most_different(n, n, percent) // 2
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]))
            if gone:
                assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
                assert len(np.intersect1d(signer.of(a), signer.of(b)))


def test_no_more_signatures_are_sent_than_can_be_spoiled():
    signer = ngram_join.Signer([], 80)
    a = mix64(np.arange(500, dtype=np.uint64))
    different = ngram_join.most_different(500, 511, 80)
    assert len(signer.of(np.sort(a))) < 2 * different + 1 + 2 * ngram_join.most_different(500, 625, 80) + 1


def test_a_hot_bucket_is_sent_as_what_tells_that_it_is_hot():
    """Buckets of up to ``most`` nodes are whole, and none is called hot that is not."""
    rng, most = np.random.default_rng(4), 5
    signs = np.repeat(mix64(np.arange(40, dtype=np.uint64)) & ngram_join._TOKEN, np.arange(1, 41))
    a = (signs << np.uint64(16)) | rng.integers(0, 3, len(signs)).astype(np.uint64)
    b = rng.integers(-9, 9, len(a))
    a, b = np.concatenate((a, a)), np.concatenate((b, b))  # each twice
    nodes = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        nodes.setdefault(x >> 16, set()).add((x & 0xFFFF, y))
    got = {}
    for x, y in zip(*(v.tolist() for v in ngram_join._enough(*ngram_join._in_order(a, b), most)), strict=True):
        assert (x & 0xFFFF, y) not in got.setdefault(x >> 16, set())
        got[x >> 16].add((x & 0xFFFF, y))
    assert got.keys() == nodes.keys() and any(len(v) > most for v in nodes.values())
    for sign, found in nodes.items():
        assert got[sign] <= found and len(got[sign]) == min(len(found), most + 1)
    back = ngram_join._unpacked([pa.scalar(ngram_join._packed(v)) for v in (a, b)])
    assert (back == np.concatenate((a, b.view(np.uint64)))).all()


def test_join_takes_small_batches(spark, monkeypatch):
    """Arrow batches of the texts are small while the join runs, and the session is left as it was."""
    seen, before = [], spark.conf.get(BATCH)
    real = ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda *a: seen.append(int(spark.conf.get(BATCH))) or real(*a))
    texts = [(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {i // 2}") for i in range(60)]
    docs = spark.createDataFrame(texts, SCHEMA)
    rows = ngram_join.link_documents(docs).where(F.col("component_id") == 0).count()
    assert rows == 60 and max(seen) <= 1000 and spark.conf.get(BATCH) == before


def test_no_stage_of_the_join_needs_two_python_workers_for_a_task(spark, monkeypatch):
    """Steps in Python that follow each other without an exchange each hold a worker while the task runs."""
    from pyspark.sql import DataFrame

    plans, real = [], DataFrame.mapInArrow
    for kind in {type(spark.range(1)), DataFrame}:
        real = kind.mapInArrow
        monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, real=real, **b: (plans.append(real(self, *a, **b)), plans[-1])[1])
    shared = " ".join(f"s{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{shared} {i % 20} x{i % 7} y{i % 3}") for i in range(60)], SCHEMA)
    ngram_join.link_documents(docs, most=4).count()
    assert len(plans) > 5
    for df in plans:
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = [i for i, line in enumerate(lines) if "MapInArrow" in line]
        for a, b in zip(at, at[1:]):
            assert any(word in line for line in lines[a:b] for word in ("Join", "Aggregate", "Repartition", "Sort", "Union"))
