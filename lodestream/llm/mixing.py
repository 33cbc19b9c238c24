"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source is a seeded stream of its documents' words, cut into blocks of an
equal number of words. The mix consists of M such blocks, allocated to sources by
the highest quotients target / (2 * blocks + 1). The method is house monotone, so
the seats of the first t shards are themselves an apportionment and the difference
of neighbouring ones gives every shard its integer quota of each source. The shards
then select their blocks: a source's blocks stand in a seeded order, the selection
begins at a seeded one, and each shard takes as many as its quota says from where the
shard before it ended, round and round. So a source is repeated evenly, and only
documents at the shards' edges are taken in part.

Targets: weights of all sources share the total; a target above ``most_repeats``
times its source's size stays there and the excess is shared again by weight.

The driver holds one row per source (its words, weight and quotas): the weights are
given per source and so known there. Rows of documents are placed in their stream
in two levels, bucket sums first and then sums inside a bucket; buckets are as many
as keep ``BUCKET_ROWS`` rows each on average, so a hot source is spread over many.

Defined results: null text has no words and takes none; a null source is a source
of its own, last in order; an empty table gives no rows; rows that repeat an id or
have none are documents of their own, placed by their text (rows equal in both get the
same total between them on every run). Other columns are passed on by ``take`` whatever
their names; very long texts are cut where a block ends, like others.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import WORD_SPACE, Scratch, checkpoint, enough_partitions, few, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 20240601
SHARDS = 8
#: Rows in a bucket of a source's stream on average, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 1 << 15, 1024
#: Words in a block, at most; small targets make it smaller, so that rounding stays under a hundredth of them.
BLOCK_WORDS = 64


@dataclass
class Share:
    """What the mix takes of one source."""

    key: str | None
    words: int
    weight: int
    target: Fraction
    blocks: int = 0
    quota: int = 0
    first: int = 0
    by_shard: tuple[int, ...] = ()

    def bounds(self, block: int) -> list[int]:
        """Where each shard's part ends, in words from the first block on, round and round; 0 before the first."""
        found, at = [0], 0
        for quota in self.by_shard:
            at += quota
            rounds, rest = divmod(at, self.blocks) if self.blocks else (0, 0)
            begin, end = self.first * block, self.first + rest
            inside = min(end * block, self.words) - begin if end <= self.blocks else self.words - begin + (end - self.blocks) * block
            found.append(rounds * self.words + inside)
        return found


def targets(words: list[int], weights: list[int], total: int, most: int = MOST_REPEATS) -> list[Fraction]:
    """Shares of the total by weight, none above ``most`` times its words."""
    found = [Fraction(0)] * len(words)
    free, left = [i for i in range(len(words)) if weights[i] > 0], Fraction(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > most * words[i]]
        if not over:
            for i in free:
                found[i] = weights[i] * unit
            break
        for i in over:
            found[i] = Fraction(most * words[i])
            left -= found[i]
        free = [i for i in free if i not in set(over)]
    return found


def sainte_lague(goals: list[Fraction], caps: list[int], seats: int) -> list[int]:
    """Seats by the highest quotients goal / (2 * seats + 1), none above its cap; ties go to the first."""
    total = sum(goals)
    if not total or seats <= 0:
        return [0] * len(goals)
    spare = seats - len(goals)
    # with this divisor no one has a seat that the highest quotients do not give, and few are missing
    got = [min(c, int(g * spare / total + Fraction(1, 2))) if spare > 0 else 0 for g, c in zip(goals, caps, strict=True)]
    heap = [(-g / (2 * s + 1), i) for i, (g, s, c) in enumerate(zip(goals, got, caps, strict=True)) if g and s < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-goals[i] / (2 * got[i] + 1), i))
    return got


def shares(words: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED, shards: int = SHARDS) -> tuple[list[Share], int]:
    """The share of each source, by code points with null last, and the words in a block."""
    keys = sorted((k for k in words if k is not None), key=lambda k: [*map(ord, k)]) + [None] * (None in words)
    given = [weights[i % len(weights)] for i in range(len(keys))]
    goals = targets([words[k] for k in keys], given, sum(words.values()), most)
    block = max(1, min([BLOCK_WORDS, *(int(g / 100) for g in goals if g)]))
    found = [Share(k, words[k], w, g, -(-words[k] // block)) for k, w, g in zip(keys, given, goals, strict=True)]
    caps = [most * s.blocks for s in found]
    seats = round(sum(goals, Fraction(0)) / block)
    steps = [sainte_lague(goals, caps, seats * (t + 1) // shards) for t in range(shards)]
    for i, share in enumerate(found):
        share.quota = steps[-1][i]
        share.by_shard = tuple(b[i] - a[i] for a, b in zip([[0] * len(found), *steps], steps, strict=False))
        share.first = int(hashlib.sha256(f"{seed}/{share.key!r}".encode()).hexdigest(), 16) % share.blocks if share.blocks else 0
    return found, block


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, pieces.

    ``pieces`` are what the shards take of a document: shard, first word, words.
    """
    sized = checkpoint(docs.select(*_sized(id_col, text_col, source_col, seed)))
    return _place(sized, sized, weights, most, seed, shards).select("id", "source", "size", "source_size", "target", "taken", "pieces")


def _sized(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"), F.xxhash64(text, F.lit(seed)).alias("tie")]


def _place(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], most: int, seed: int, shards: int) -> DataFrame:
    """``rows`` (with what ``sized`` has) and what the mix takes of each row; bucket sums come from ``sized``."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    found, block = shares({r["source"]: int(r["words"]) for r in totals}, weights, most, seed, shards)
    buckets = max(BUCKETS, max((r["n"] for r in totals), default=0) // BUCKET_ROWS)
    ends = [f"end{t}" for t in range(shards + 1)]
    given = [("n" if s.key is None else "s" + s.key, s.words, float(s.target), s.first * block, *s.bounds(block)) for s in found]
    params = sized.sparkSession.createDataFrame(given, "skey string, source_size long, target double, begin long, " + ", ".join(f"{e} long" for e in ends))

    keys = {"skey": _source_key(F.col("source")), "bucket": F.pmod(F.col("h"), F.lit(buckets))}
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.withColumns(keys).groupBy("skey", "bucket").agg(F.sum("size").alias("n")).select("skey", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_at"))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumns(keys)
        .withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["skey", "bucket"])
        .join(params, "skey")  # its size is known: broadcast only under the session's threshold
        .withColumn("at", F.col("bucket_at") + F.col("before"))
    )

    # in words from the first block on, a document that holds its begin has two parts
    at, size, begin, words, end = (F.col(c) for c in ("at", "size", "begin", "source_size", ends[-1]))
    split = F.greatest(F.lit(0), F.least(begin - at, size))
    part = lambda x, first, n: F.struct(x.cast("long").alias("x"), first.cast("long").alias("from"), F.least(n, end - x).cast("long").alias("n"))
    parts = [part(place + r * words, first, n) for r in range(most) for place, first, n in ((F.greatest(at - begin, F.lit(0)), split, size - split), (words - begin + at, F.lit(0), split))]
    shard_of = lambda x: sum((F.when(x >= F.col(e), 1).otherwise(0) for e in ends[1:-1]), F.lit(0))
    edges = F.array(*ends)

    def of_shards(p: Column) -> Column:
        def one(t: Column) -> Column:
            lo, hi = F.greatest(p["x"], F.get(edges, t)), F.least(p["x"] + p["n"], F.get(edges, t + 1))
            return F.struct(t.alias("shard"), (p["from"] + lo - p["x"]).alias("from"), (hi - lo).alias("words"))

        return F.transform(F.sequence(shard_of(p["x"]), shard_of(p["x"] + p["n"] - 1)), one)

    taken = F.transform(F.filter(F.array(*parts), lambda p: p["n"] > 0), of_shards)
    pieces = F.filter(F.flatten(taken), lambda p: p["words"] > 0)
    return placed.withColumn("pieces", pieces).withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"]))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``.

    A document stands there once for each time that it is taken whole; a part of one is
    a row with that part's words and the white space between them, and its own count of
    characters. Texts move once, with their bucket.
    """
    rows = Scratch(docs.sparkSession).keep(docs.select(*_sized(id_col, text_col, source_col, seed), F.struct(*docs.columns).alias("row")))
    placed = _place(rows, rows.select("source", "size", "h"), weights, most, seed, shards)
    each = placed.select("row", "size", F.explode("pieces").alias("piece"))
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0))
    some = F.rtrim(F.array_join(F.slice(words, (F.col("piece")["from"] + 1).cast("int"), F.col("piece")["words"].cast("int")), ""), F.lit(WORD_SPACE))
    out = each.withColumn("part", F.when(F.col("piece")["words"] < F.col("size"), some))
    changed = {text_col: F.coalesce("part", F.col("row")[text_col]), chars_col: F.coalesce(F.length("part").cast("long"), F.col("row")[chars_col])}
    most = enough_partitions(docs.sparkSession, rows.rdd.getNumPartitions())  # those of the scan, which follow the bytes
    return few(out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns]), most)
