"""Ranked search, centroid clustering and language-model scores against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import bloom_lm, centroids, impact_search, registry
from lodestream.llm.common import Scratch
from lodestream.llm.words_np import column_bytes

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, item_id long, term long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 7, 8) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.mark.parametrize("name", ["op11_impact_search", "op12_centroids"])
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in columns) for r in got.collect())


# ranked search


def terms(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=20):
    found = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in found]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(w for _, c in found for w in c)
    out = []
    for item, text in items:
        rows = []
        for (i, c), size in zip(found, lengths, strict=True):
            score = 0
            for w in terms(text):
                if c[w]:
                    m = 100 - 25 + 25 * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return out


def texts_of(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "x-y", "A1", "a1", "łódź", "b\x00c", "\U0001f600"]
    made = [" ".join(rng.choices(words, weights=[1 / (1 + i) for i in range(len(words))], k=rng.choice([1, 3, 8, 30, 200]))) for _ in range(n)]
    return [*made, *made[:15], None, "", "  -- ", "w1 " * 5000]


@pytest.mark.parametrize(("docs_in_segment", "text_in_segment", "items_in_block", "pairs"), [(4096, 1 << 24, 256, 1 << 19), (7, 1 << 24, 2, 1 << 19), (1000, 900, 3, 0)])
def test_ranking(spark, monkeypatch, docs_in_segment, text_in_segment, items_in_block, pairs):
    monkeypatch.setattr(impact_search, "SEGMENT_DOCS", docs_in_segment)
    monkeypatch.setattr(impact_search, "SEGMENT_BYTES", text_in_segment)
    monkeypatch.setattr(impact_search, "BLOCK_ITEMS", items_in_block)
    monkeypatch.setattr(impact_search, "BLOCK_TERMS", 5)
    monkeypatch.setattr(impact_search, "BROADCAST_PAIRS", pairs)
    texts = texts_of(3)
    ids = [None if i in (4, 9) else 50 if i in (20, 21, 22) else 1000 - i for i in range(len(texts))]
    items = [(1, "w1 w1 W1 w30 łódź"), (2, ""), (3, None), (4, "absent words"), (5, "w59 A1 absent"), (6, " ".join(f"w{i}" for i in range(60)) * 2), (6, "Ünï \U0001f600"), (None, "b c"), (9, "w3 " * 300)]
    got = impact_search.rank_documents(frame(spark, texts, ids).repartition(3), frame(spark, [t for _, t in items], [i for i, _ in items]), item_id_col="doc_id")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=key) == sorted(ranked(list(zip(ids, texts, strict=True)), items), key=key)


def test_ranking_of_no_rows(spark):
    docs, none = frame(spark, ["a b", None]), frame(spark, []).where("doc_id = 0")
    assert impact_search.rank_documents(none, docs, item_id_col="doc_id").count() == 0
    assert impact_search.rank_documents(docs, none, item_id_col="doc_id").count() == 0
    assert impact_search.rank_documents(frame(spark, [None, ""]), docs, item_id_col="doc_id").count() == 0


def sliced(values):
    bits = (values.astype(object)[None] >> np.arange(50).astype(object)[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)


def unsliced(x):
    bits = np.unpackbits(x.view(np.uint8), axis=2, bitorder="little").astype(object)
    return sum(bits[s] << s for s in range(len(x)))


def test_carry_arithmetic_and_top():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 40, (3, 128)), rng.integers(0, 1 << 20, (3, 128))
    total = sliced(a)
    impact_search._add(total, sliced(b)[:20], 5)
    assert (unsliced(total) == a.astype(object) + (b.astype(object) << 5)).all()
    weights = np.array([0, 1, 13817])
    assert (unsliced(impact_search._multiplied(sliced(b)[:20], weights)) == b.astype(object) * weights.astype(object)[:, None]).all()
    few = rng.integers(0, 4, (3, 128)) * (rng.random((3, 128)) < 0.3)
    few[2] = 0
    for k in (1, 5, 20, 100):
        items, docs, score = impact_search.best(sliced(few), k)
        for i in range(3):
            want = sorted((-few[i, d], d) for d in range(128) if few[i, d])[:k]
            assert sorted((-s, d) for j, d, s in zip(items, docs, score, strict=True) if j == i) == want


# centroids


def clustered(rows, k=8, rounds=10, size=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [int(n) * 1024 // int(d) for n, d in (x.as_integer_ratio() for x in v)]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    away = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min((away(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(col) // own.count(j) for col in zip(*(v for (_, v), o in zip(kept, own, strict=True) if o == j), strict=True)] if j in own else c[j] for j in range(len(c))]
    last = [(i, *near(v)) for i, v in kept]
    fits = lambda x: x if x < 1 << 63 else None
    inertia = [sum(d for _, d, o in last if o == j) for j in range(len(c))]
    return [(i, o, fits(d), fits(inertia[o]), fits(sum(inertia)), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, d, o in last]


VECTORS = "vec_id long, embedding array<double>, label int, cluster string, v long"


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "few"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 64).tolist()) for i in range(90)]
    if kind == "ties":  # a small grid: equal distances and equal vectors
        rows = [(i, (rng.integers(-1, 2, 64) * (np.arange(64) < 3)).astype(float).tolist()) for i in range(150)]
    if kind == "large":
        rows = [(i, (rng.normal(0, 1, 64) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(60)] + [(100, [1e300] + [0.5] * 63), (101, [-1e-300] + [1e6] * 63)]
    if kind == "few":
        rows = rows[:5]
    rows += [(rows[0][0], rows[1][1]), (None, rows[2][1]), (None, rows[2][1])]
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [math.nan] + [0.0] * 63), (204, [math.inf] + [0.0] * 63), (205, [None] + [0.0] * 63), (206, [0.0] * 65)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + bad], VECTORS).repartition(5)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=key) == sorted(clustered(rows), key=key)


def test_clusters_of_no_rows(spark):
    df = spark.createDataFrame([(1, None, 1, "x", 2)], VECTORS)
    assert centroids.cluster(df).count() == 0 and centroids.cluster(df.where("vec_id = 2")).count() == 0


def test_intervals_hold_the_exact_distance():
    rng = np.random.default_rng(2)
    for scale in (1, 50, 5000, 1 << 20, (1 << 27) - 1):
        v, c = rng.integers(-scale, scale + 1, (200, 64)), rng.integers(-scale, scale + 1, (8, 64))
        c[3:] = c[2] + rng.integers(-1, 2, (5, 64))  # so near to each other that float32 cannot tell them apart
        c = np.clip(c, -scale, scale)
        low, high = centroids.Screen(c.tolist()).intervals(v)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) - sum(int(a) ** 2 for a in x) for y in c] for x in v], float)
        assert (low <= exact).all() and (exact <= high).all()
        near = centroids.Screen(c.tolist()).assign(v)
        assert near.tolist() == [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))[1] for x in v]


# language model


def tokens(text):
    return [*re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def scores(rows):
    """Exact base scores, and the model's with counts at their levels but no error of the filter."""
    held = {n: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for n, (i, _) in enumerate(rows)}
    one, two = Counter(), Counter()
    for n, (_, t) in enumerate(rows):
        if not held[n]:
            one.update(tokens(t))
            two.update(zip(tokens(t), tokens(t)[1:], strict=False))
    total, distinct = sum(one.values()), len(one)
    middle = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0
    out = []
    for n, (i, t) in enumerate(rows):
        found, score = tokens(t), 0.0
        for before, w in zip([0, *found], found, strict=False):
            alone = (min(middle(one[w]), total) + 1) / (total + distinct + 1)
            context = middle(one[before]) if before != 0 else 0
            score += math.log10((min(middle(two[before, w]), context) + bloom_lm.MU * alone) / (context + bloom_lm.MU) if context else alone)
        out.append((i, held[n], len(found), sum(one[w] > 0 for w in found), total, sum(math.log10((one[w] + 1) / (total + distinct + 1)) for w in found), score))
    return out


@pytest.mark.parametrize(("broadcast_words", "section", "held"), [(1 << 19, 96 << 20, 1 << 21), (20, 3000, 50), (0, 1 << 20, 1 << 21)])
def test_language_model(spark, monkeypatch, broadcast_words, section, held):
    monkeypatch.setattr(bloom_lm, "BROADCAST_WORDS", broadcast_words)
    monkeypatch.setattr(bloom_lm, "SECTION_BYTES", section)
    monkeypatch.setattr(bloom_lm, "HELD", held)
    monkeypatch.setattr(bloom_lm, "BLOCK_TEXT", 2000)
    texts = texts_of(5, 60)
    ids = [None if i in (3, 8) else 11 if i in (20, 21) else i for i in range(len(texts))]
    got = bloom_lm.score_documents(frame(spark, texts, ids).repartition(4), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, hashes=30)  # so many that the filter's errors do not show
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[5], 6))
    rows, want = sorted(map(tuple, got.collect()), key=key), sorted(scores(list(zip(ids, texts, strict=True))), key=key)
    assert [r[:5] for r in rows] == [r[:5] for r in want] and sum(r[1] for r in rows) > 3
    assert np.allclose([r[5] for r in rows], [r[5] for r in want], rtol=1e-12) and np.allclose([r[6] for r in rows], [r[6] for r in want], rtol=1e-9)


def test_language_model_of_no_rows(spark):
    assert bloom_lm.score_documents(frame(spark, []).where("doc_id = 0"), F.lit(False)).count() == 0
    rows = bloom_lm.score_documents(frame(spark, ["a b", None]), F.lit(True)).orderBy("doc_id").collect()  # nothing to learn from
    assert [tuple(r) for r in rows] == [(0, True, 3, 0, 0, 0.0, 0.0), (1, True, 1, 0, 0, 0.0, 0.0)]


def test_the_filter_never_reads_too_little(spark):
    docs = frame(spark, texts_of(6, 300))
    scratch = Scratch(spark)
    try:
        model = bloom_lm.train(docs, scratch)
        one = Counter()
        for r in docs.collect():
            one.update(tokens(r["text"]))
        assert (model.tokens, model.distinct) == (sum(one.values()), len(one))
        section = model.section(0).value
        words = [w for w in one if w is not None]
        found, _ = bloom_lm.tokens(*column_bytes(pa.array(words)))
        levels = np.zeros(len(found), np.uint8)
        section.read(bloom_lm.grams(found, 1), levels)
        stored = np.array([one[w].bit_length() for w in words])
        assert (levels[found != bloom_lm.END] >= stored).all()
        strange, first = bloom_lm.tokens(*column_bytes(pa.array([f"unknown{i}" for i in range(20_000)])))
        levels = np.zeros(len(strange), np.uint8)
        section.read(bloom_lm.grams(strange, 1), levels)
        assert np.mean(levels[strange != bloom_lm.END] > 0) < 2 * 2.0**-bloom_lm.HASHES
    finally:
        scratch.remove()


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    row = registry.op13_bloom_lm(spark, SF).where("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert row["model"] / row["n"] > row["base"] / row["n"] + 0.15
