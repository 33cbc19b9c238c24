"""Similarity join, exact dedup, sharding and mixing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import exact_dedup, mixing, ngram_join, sharding
from lodestream.llm.components import stars
from lodestream.llm.words_np import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def rows(texts, sources=("a", "b")):
    return [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([1, 3, 5, 6, 9, 40, 120, 300]))) for _ in range(60)]
    for base in list(texts[20:45]):  # near copies at all distances, and copies
        for edits in (0, 1, 2, 4, 8):
            words = base.split(" ")
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    shared = " ".join(rng.choices(WORDS, k=60))  # a passage that many share, and a large group of near copies
    texts += [shared + " " + " ".join(rng.choices(WORDS, k=40)) for _ in range(60)]
    for _ in range(80):
        words = (shared + " " + shared[::-1]).split(" ")
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    return [*texts, None, "", "  \n", "UPPER Case Words Are Equal Here", "upper case words are equal here", "ÄÖ äö"]


def sets_of(text):
    w = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(found):
    parent = {i: i for i in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(found)
    for x in ids:
        for y in ids:
            if x < y and found[x] and found[y]:
                same = len(found[x] & found[y])
                if 100 * same >= 80 * (len(found[x]) + len(found[y]) - same):
                    a, b = root(x), root(y)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("most", [4, 64])  # the first makes most buckets hot, so tiles decide
def test_join_is_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    docs = spark.createDataFrame(rows(corpus()), SCHEMA)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(docs, most=most).collect()}
    found = {i: sets_of(t) for i, t in enumerate(corpus())}
    want = brute_components(found)
    assert {i: g[0] for i, g in got.items()} == {i: len(s) for i, s in found.items()}
    assert {i: g[1] for i, g in got.items()} == want
    assert max(Counter(want.values()).values()) > 20


def test_join_where_buckets_have_others_than_the_least(spark, monkeypatch):
    """Chains of near copies of which few are similar to the least one, over a passage that all share; ids repeat and names clash."""
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rng, texts = random.Random(6), []
    for _ in range(3):
        words = rng.choices(WORDS, k=80)
        for _ in range(60):
            words = list(words)
            for _ in range(rng.choice([1, 1, 1, 2])):  # two edits may end the chain
                words[rng.randrange(30)] = rng.choice(WORDS)
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "hi", "lo", 0) for i, t in enumerate(texts)], SCHEMA).withColumnsRenamed({"lang": "hi", "source": "lo", "n_chars": "sign"})
    want = brute_components({i: sets_of(t) for i, t in enumerate(texts)})
    got = {r["id"]: r["component_id"] for r in ngram_join.link_documents(docs, most=2, rounds=1).collect()}
    assert got == want and len(set(want.values())) > 3


def test_join_of_an_empty_table_and_null_ids(spark):
    assert ngram_join.link_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f", "en", "a", 1), (4, "a b c d e f", "en", "a", 1)], SCHEMA)
    assert {r["component_id"] for r in ngram_join.link_documents(docs).collect()} == {4}


def test_similar_sets_share_a_signature():
    rng, signer = np.random.default_rng(2), ngram_join.Signer([], 80)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 31, 33, 63, 64, 65, 130, 500, 2000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(rng.integers(0, n // 9 + 1))
            add = int(rng.integers(0, n // 9 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 100 * same >= 80 * (len(a) + len(b) - same) and same < max(len(a), len(b)):  # equal sets are one node
                assert len(np.intersect1d(signer.of(a), signer.of(b)))
                assert abs(ngram_join.size_class(len(a)) - ngram_join.size_class(len(b))) <= ngram_join.classes_apart(80)


def test_shingles_do_not_depend_on_neighbours():
    texts = ["a b c d e f", "", "g", "a b c d e f"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    found = list(shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets))
    assert list(map(len, found)) == [2, 0, 1, 2] and (found[0] == found[3]).all()


def test_stars_are_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (5, 6), (6, 7), (8, 7), (20, 21), *((100, i) for i in range(101, 160)), *((i, i + 1) for i in range(200, 260))]
    found = {r["u"]: r["v"] for r in stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {2: 1, 3: 1, 9: 1, 6: 5, 7: 5, 8: 5, 21: 20} | dict.fromkeys(range(101, 160), 100) | dict.fromkeys(range(201, 261), 200)


@pytest.mark.parametrize("support", [0.001, 0.05, 0.5])
def test_exact_dedup(spark, support):
    texts = ["hot"] * 300 + [f"t{i % 90}" for i in range(200)] + [None, "", "", "Hot", "é"]
    table = [*rows(texts), (3, "hot", "en", "a", 1), (299, "hot", "en", "b", 2), (None, "hot", "en", "a", 1), (None, "null id", "en", "a", 1), (None, "null id", "en", "a", 1), (299, "t7", "en", "a", 1)]
    got = exact_dedup.exact_groups(spark.createDataFrame(table, SCHEMA), support=support).collect()
    groups = defaultdict(list)
    for r in table:
        groups[hashlib.sha256((r[1] or "").encode()).digest()].append(r[0])
    want = Counter()
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), digest) for i in ids)
    assert Counter((r["id"], r["keep_id"], r["group_size"], bytes(r["digest"])) for r in got) == want
    kept = Counter(bytes(r["digest"]) for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    clash = spark.createDataFrame(table, SCHEMA).withColumnsRenamed({"lang": "__row", "source": "digest", "n_chars": "r"})
    left = exact_dedup.survivors(clash, support=support)
    assert left.columns == clash.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == Counter((max((i for i in ids if i is not None), default=None), t) for t, ids in by_text(table).items())
    assert exact_dedup.exact_groups(clash.limit(0)).count() == exact_dedup.survivors(clash.limit(0)).count() == 0


def by_text(table):
    groups = defaultdict(list)
    for r in table:
        groups[r[1] or ""].append(r[0])
    return groups


def brute_capacity(sizes, n):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if (g := sharding.greedy(sizes, c, n)) and len(g) <= n)


@pytest.mark.parametrize("seed", range(5))
def test_smallest_capacity_is_exact(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, 9, 40]) for _ in range(80)] + [300] * (seed % 2)
    best = brute_capacity(sizes, 7)
    assert sharding.smallest_capacity(sizes, 7, 1, sum(sizes)) == best
    ends = sharding.even_cuts(sizes, best, 7)
    assert ends[-1] == len(sizes) and ends == sorted(ends) and len(ends) == 7
    assert max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends, strict=False)) <= best


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 4)  # so blocks have to be looked into
    texts = ["hot text " * 5] * 60 + [f"text {i % 150} " * (1 + i % 7) for i in range(400)] + [None, "", "ü"]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r["id"]: r for r in sharding.shard_by_bytes(docs, n_shards=6).collect()}
    size = {i: len((t or "").encode()) + 8 for i, t in enumerate(texts)}
    assert {i: r["size"] for i, r in got.items()} == size
    assert all(r["crc"] == zlib.crc32((texts[i] or "").encode()) for i, r in got.items())
    by_text = defaultdict(set)
    for i, t in enumerate(texts):
        by_text[t or ""].add(got[i]["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    slots = defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:15], 16)
    groups = Counter()
    for t in texts:
        groups[key(t or "")] += len((t or "").encode()) + 8
    total = sum(groups.values())
    order = sorted(groups, key=lambda k: (groups[k] * sharding.HEAVY_PARTS < total, k))
    loads = Counter()
    for r in got.values():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= brute_capacity([groups[k] for k in order], 6)
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = docs.withColumnsRenamed({"lang": "k", "n_chars": "size"}).withColumn("r", F.lit("clash"))
    assert sharding.shard_rows(clash, n_shards=6).count() == len(texts)


def test_sharding_of_equal_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 4)  # many salts and sub-blocks
    table = [(None if i % 3 else 5, "hot " * 9 if i % 2 else f"text {i % 40} " * 4, "en", "a", 0) for i in range(600)]
    docs = spark.createDataFrame(table * 2, SCHEMA)
    rows_ = sharding.shard_rows(docs, n_shards=6).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows_) == Counter((t[0], t[1]) for t in table * 2)
    slots = defaultdict(list)
    for r in rows_:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r["shard"] for r in rows_ if r["text"] == t}) == 1 for t in {r["text"] for r in rows_})


def test_sainte_lague_takes_the_highest_quotients():
    rng = random.Random(4)
    for _ in range(40):
        goals = [Fraction(rng.randrange(0, 50)) for _ in range(6)]
        caps = [rng.choice([2, 10, 1000]) for _ in goals]
        seats, previous = rng.randrange(0, 60), None
        want = [0] * 6
        for _ in range(seats):
            open_ = [i for i in range(6) if goals[i] and want[i] < caps[i]]
            if open_:
                want[max(open_, key=lambda i: (goals[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(goals, caps, seats) == want
        previous = want
        assert all(a <= b for a, b in zip(mixing.sainte_lague(goals, caps, max(0, seats - 3)), previous, strict=True))


def test_mixing(spark):
    rng = random.Random(9)
    table = [(i, " ".join(["x"] * rng.randrange(0, 200)) if i % 31 else None, "en", rng.choice(["a", "b", "ç", None, "tiny"] if i % 50 == 0 else ["a", "a", "b", "ç", None]), 0) for i in range(600)]
    docs = spark.createDataFrame(table, SCHEMA)
    got = mixing.mix(docs).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in mixing.mix(docs.repartition(3)).collect()] or sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    words = Counter()
    for r in table:
        words[r[3]] += len((r[1] or "").split())
    order = sorted((k for k in words if k is not None)) + [None]
    goal = dict(zip(order, mixing.targets([words[k] for k in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], sum(words.values())), strict=True))
    taken, by_id = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        by_id[r["id"]] = r
        assert r["taken"] <= 3 * r["size"] and abs(r["target"] - float(goal[r["source"]])) < 1e-6 and r["source_size"] == words[r["source"]]
    assert sum(goal.values()) == sum(words.values()) and all(g <= 3 * words[k] for k, g in goal.items())
    found, block = mixing.shares(words)
    for share in found:  # every shard takes its quota of blocks, but for the last block of a round, which may be short
        by_shard = Counter()
        for r in got:
            if r["source"] == share.key:
                for p in r["pieces"]:
                    assert 0 <= p["from"] and p["from"] + p["words"] <= r["size"]
                    by_shard[p["shard"]] += p["words"]
        assert all(abs(by_shard[t] - q * block) <= block * 3 for t, q in enumerate(share.by_shard))
        assert sum(by_shard.values()) == taken[share.key]
    for k in order:
        assert abs(taken[k] - goal[k]) <= max(2 * mixing.BLOCK_WORDS, 0.02 * goal[k])
    mixed = Counter()
    for r in mixing.take(docs).collect():
        mixed[r["doc_id"]] += len((r["text"] or "").split())
    assert mixed == Counter({i: r["taken"] for i, r in by_id.items() if r["taken"]})


def test_mixing_is_brute_force(spark, monkeypatch):
    """Each word of the seeded streams by hand; ids repeat and are null, names clash, one text is long."""
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    rng = random.Random(3)
    table = [(None if i % 5 == 0 else i // 2, " ".join(f"{i}.{j}" for j in range(5000 if i == 7 else rng.randrange(0, 60))), "x", rng.choice(["a", "a", "b", None]), 0) for i in range(150)]
    docs = spark.createDataFrame(table, SCHEMA).withColumnsRenamed({"lang": "pieces"}).withColumn("h", F.lit(1))
    got = mixing.mix(docs).collect()
    words = Counter()
    for t in table:
        words[t[3]] += len(t[1].split())
    found, block = mixing.shares(words)
    out = Counter(w for r in mixing.take(docs).collect() for w in r["text"].split())
    assert sum(out.values()) == sum(r["taken"] for r in got)
    for share in found:
        mine = [out[w] for t in table if t[3] == share.key for w in t[1].split()]
        rounds, rest = divmod(share.bounds(block)[-1], share.words)
        assert Counter(mine) == Counter({rounds: share.words - rest, rounds + 1: rest}) - Counter({rounds + 1: 0})
    assert mixing.mix(docs.limit(0)).count() == mixing.take(docs.limit(0)).count() == 0


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([10, 1000, 1000], [5, 2, 1], 2010) == [30, Fraction(1980 * 2, 3), Fraction(1980, 3)]
    assert mixing.targets([0, 0], [5, 2], 0) == [0, 0]
