"""The n-gram join of a small table takes few tasks and files, however many partitions the session shuffles to."""

from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pytest

from lodestream.llm import components, ngram_join
from lodestream.llm.common import Scratch

WIDE = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@contextmanager
def wide(spark):
    before = {k: spark.conf.get(k) for k in WIDE}
    for k, v in WIDE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def brute(edges):
    root = {x: x for e in edges for x in e}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((of(a), of(b)))
        root[b] = a
    return {x: of(x) for x in root if of(x) != x}


@pytest.mark.parametrize("share", [4, 1 << 18])
def test_components_with_one_and_many_shares(spark, monkeypatch, share):
    """A chain, a hub, pairs and a ring, as numbers and as structs; with small shares star rounds follow."""
    monkeypatch.setattr(components, "EDGES", share)
    edges = [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 540)] + [(900 + 2 * i, 901 + 2 * i) for i in range(9)] + [(-i, -(i % 7) - 1) for i in range(1, 8)] + [(3, 3)]
    rng = np.random.default_rng(1)
    edges = [edges[i][:: rng.choice([1, -1])] for i in rng.permutation(len(edges))]
    numbers = spark.createDataFrame(edges, "u long, v long")
    assert {r["u"]: r["v"] for r in components.stars(numbers).collect()} == brute(edges)
    pairs = [((x // 7, x % 7), (y // 7, y % 7)) for x, y in edges]
    structs = spark.createDataFrame(pairs, "u struct<hi: int, lo: long>, v struct<hi: int, lo: long>")
    assert {tuple(r["u"]): tuple(r["v"]) for r in components.stars(structs).collect()} == brute(pairs)


def test_a_small_join_writes_few_files_and_takes_no_star_round(spark, monkeypatch):
    files, rounds, real = [], [], Scratch.keep

    def keep(self, df):
        out = real(self, df)
        files.append(len([*Path(self.folder.removeprefix("file:")).joinpath(str(self.tables)).glob("part-*")]))
        return out

    digest = components._digest
    monkeypatch.setattr(Scratch, "keep", keep)
    monkeypatch.setattr(components, "_digest", lambda edges: rounds.append(1) or digest(edges))
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [(i, f"{shared} {i % 20} x{i % 7} y{i % 3}") for i in range(300)] + [(i, " ".join(f"w{(i // 2) * 50 + j}" for j in range(40)) + f" {i}") for i in range(300, 900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    with wide(spark):
        found = ngram_join.link_documents(docs, most=4)
        got = {r["id"]: r["component_id"] for r in found.collect()}
    assert found.rdd.getNumPartitions() <= 64  # two unions of 2 for each core and the scan
    assert len(files) > 5 and max(files) <= 2 * spark.sparkContext.defaultParallelism
    assert not rounds
    assert len(got) == 900 and {got[i] for i in range(300)} == {0} and all(got[i] == i - i % 2 for i in range(300, 900))
