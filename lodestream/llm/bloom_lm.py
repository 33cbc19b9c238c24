"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counting: each task adds up the words and pairs of words of its texts, and sends them on by
block of the filter; a block's task merges these to exact counts. A count c is held as its
level 1 + floor(log2 c): the filter has the n-gram with every level from 1 to that. So a
count is read by asking for level 1, 2, ... until one is missing, and what is read is never
under the level that was stored; a level too much is read with chance 2^-hashes at most, or so.
Every block of the filter has as many bits as what it holds asks for, so the chance is
the same at any size, and the number of blocks follows the bytes of text, so a block stays small.

Scoring: the filter is broadcast to the workers in sections of about ``SECTION_BYTES``; where
there are more than one, the texts pass once for each and carry the levels found so far (two
bytes a token). So no broadcast grows with the corpus, but the passes do. With c~ the
middle of what a level stands for, N training tokens and V distinct ones, a token w after v has
P(w | v) = (min(c~(vw), c~(v)) + MU P(w)) / (c~(v) + MU) and P(w) = (c~(w) + 1) / (N + V + 1).

The base score needs exact counts of single words: the most frequent (``BROADCAST_WORDS`` at
most) are broadcast, and the other words of a text are joined with their counts; sums of these are
taken in decimals, so they do not depend on the order of rows.

A text's tokens are its words with A-Z in lower case and one end; words are told apart by
64-bit hashes. Defined results: null and empty texts have one token, the end; a row with a
null id is not held out and is learned from; rows that repeat are learned from and scored each on its own; an
empty table gives no rows, and with nothing to learn from every token is unknown. Very long
texts are read in full. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, checkpoint, small_batches
from lodestream.llm.words_np import blocks, grams, mix64, words

HASHES, MU = 6, 4.0
BLOCK_TEXT, SECTION_BYTES = 1 << 18, 96 << 20
BROADCAST_WORDS = 1 << 19
#: Tokens that are looked up together (or those of one text, if these are more).
READ_TOKENS = 1 << 18
#: Distinct n-grams that a task holds before it sends them on; blocks that go in one Arrow batch.
HELD, SENT_BLOCKS = 3 << 19, 128

END = np.uint64(0x5851F42D4C957F2D)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
_SQUARE = np.uint64(0x9E3779B1)

COUNTS = "block long, words binary, word_counts binary, pairs binary, pair_counts binary"
FILTER = "block long, n_bits long, bits binary, words binary, word_counts binary, tokens long, distinct long"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text's begin (and the end)."""
    hashes, first = words(data, offsets)
    rows = np.arange(len(first) - 1)
    out = np.full(len(hashes) + len(rows), END)
    out[np.arange(len(hashes)) + np.repeat(rows, np.diff(first))] = hashes
    return out, first + np.arange(len(first))


def pairs(found: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; of no meaning for the first of a text."""
    return np.concatenate((np.zeros(min(1, len(found)), np.uint64), grams(found, 2)))


def _token_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, tokens and where each text's begin, of so many rows that they have READ_TOKENS."""
    held, n, row = [], 0, 0

    def joined(end: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        sizes = np.cumsum([0, *(len(found) for found, _ in held)])
        first = [f[:-1] + at for (_, f), at in zip(held, sizes[:-1].tolist(), strict=True)]
        return row, end, np.concatenate([found for found, _ in held]), np.concatenate([*first, sizes[-1:]])

    for _, end, data, offsets in blocks(column):
        held.append(tokens(data, offsets))
        n += len(held[-1][0])
        if n >= READ_TOKENS:
            yield joined(end)
            held, n, row = [], 0, end
    if held:
        yield joined(row + sum(len(f) - 1 for _, f in held))


def block_of(keys: np.ndarray, n_blocks: int) -> np.ndarray:
    """Rises with the key."""
    return ((keys >> _32) * np.uint64(n_blocks)) >> _32


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c), exact up to 2^53


#: The middle of what each level stands for.
MIDDLES = np.array([0.0] + [(2.0 ** (j - 1) + 2.0**j - 1) / 2 for j in range(1, 64)])


def _places(mixed: np.ndarray, number: int, n_bits: np.ndarray) -> np.ndarray:
    """Where the number-th bit of a key stands among n_bits; the square keeps keys of a small step from asking for one bit again and again."""
    return ((((mixed & _LOW) + np.uint64(number) * (mixed >> _32) + np.uint64(number * number) * _SQUARE) & _LOW) * n_bits) >> _32


def filled(keys: np.ndarray, levels: np.ndarray, hashes: int) -> tuple[int, np.ndarray]:
    """A block of the filter: number of bits, and the bytes."""
    n_bits = 8 * max(8, math.ceil(int(levels.sum()) * hashes / math.log(2) / 8))
    bits, mixed = np.zeros(n_bits, bool), mix64(keys)
    for level in range(int(levels.max(initial=0))):
        mixed, levels = mixed[levels > level], levels[levels > level]
        for i in range(hashes):
            bits[_places(mixed, level * hashes + i, np.uint64(n_bits))] = True
    return n_bits, np.packbits(bits, bitorder="little")


class Section:
    """Blocks of the filter whose number has one remainder."""

    def __init__(self, rows: pa.Table, n_blocks: int, sections: int, remainder: int, hashes: int) -> None:
        self.n_blocks, self.sections, self.remainder, self.hashes = n_blocks, np.uint64(sections), np.uint64(remainder), hashes
        count = (n_blocks - remainder + sections - 1) // sections
        self.n_bits, self.start = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
        at = rows["block"].to_numpy() // sections
        sizes = rows["n_bits"].to_numpy().astype(np.uint64)
        self.n_bits[at], self.start[at] = sizes, np.cumsum(sizes) - sizes
        self.data = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(x.as_buffer(), np.uint8) for x in rows["bits"]]])

    def read(self, keys: np.ndarray, levels: np.ndarray) -> None:
        """Set the levels of the keys that belong here; each is asked for once, and in their order, in which the filter's blocks stand."""
        keys, back = np.unique(keys, return_inverse=True)
        block = block_of(keys, self.n_blocks)
        left = np.flatnonzero(block % self.sections == self.remainder)
        own = (block[left] // self.sections).astype(np.int64)
        left, own = left[self.n_bits[own] > 0], own[self.n_bits[own] > 0]
        asked, mixed, n_bits, start = left, mix64(keys[left]), self.n_bits[own], self.start[own]
        found, level = np.zeros(len(keys), np.uint8), 0
        while len(left) and level < len(MIDDLES) - 1:
            for i in range(self.hashes):
                at = _places(mixed, level * self.hashes + i, n_bits) + start
                has = (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                left, mixed, n_bits, start = left[has], mixed[has], n_bits[has], start[has]
            level += 1
            found[left] = level
        mine = np.zeros(len(keys), bool)
        mine[asked] = True
        np.copyto(levels, found[back], where=mine[back])


@dataclass
class Model:
    """What was learned: the filter's table, its size, and the most frequent words with their counts."""

    table: DataFrame
    n_blocks: int
    sections: int
    tokens: int
    distinct: int
    bound: int
    hashes: int
    frequent: tuple[np.ndarray, np.ndarray]

    def section(self, number: int) -> Broadcast:
        rows = self.table.where(F.col("block") % self.sections == number).select("block", "n_bits", "bits").toArrow()  # SECTION_BYTES or so
        return self.table.sparkSession.sparkContext.broadcast(Section(rows, self.n_blocks, self.sections, number, self.hashes))


def _vocabulary(table: DataFrame) -> DataFrame:
    def unpack(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), "<i8")), pa.array(np.frombuffer(counts.as_buffer(), "<i8"))], ["word", "count"])

    return table.select("words", "word_counts").mapInArrow(unpack, "word long, count long")


def _counted(found: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([np.empty(0, np.int64), *counts]))
    return keys, total


def _sent(held: list[tuple[np.ndarray, np.ndarray]], n_blocks: int) -> Iterator[pa.RecordBatch]:
    """One row for each block that any of the words and pairs belong to, ``SENT_BLOCKS`` at once."""
    of = [block_of(keys, n_blocks).astype(np.int64) for keys, _ in held]
    numbers = np.unique(np.concatenate(of))
    cuts = [np.append(np.searchsorted(block, numbers), len(block)).tolist() for block in of]
    for start in range(0, len(numbers), SENT_BLOCKS):
        some = numbers[start : start + SENT_BLOCKS]
        columns = [pa.array(some)]
        for (keys, counts), cut in zip(held, cuts, strict=True):
            ends = cut[start : start + len(some) + 1]
            for values in (keys.astype("<u8", copy=False), counts.astype("<i8", copy=False)):
                columns.append(pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["block", "words", "word_counts", "pairs", "pair_counts"])


def _merged(rows: pa.Table, hashes: int) -> pa.Table:
    def total(keys: str, counts: str) -> tuple[np.ndarray, np.ndarray]:
        return _counted(*[[np.frombuffer(x.as_buffer(), kind) for x in rows[c]] for c, kind in ((keys, "<u8"), (counts, "<i8"))])

    words, word_counts = total("words", "word_counts")
    both, both_counts = total("pairs", "pair_counts")
    n_bits, bits = filled(np.concatenate((words, both)), level_of(np.concatenate((word_counts, both_counts))), hashes)
    values = [rows["block"][0].as_py(), n_bits, bits.tobytes(), words.tobytes(), word_counts.tobytes(), int(word_counts.sum()), len(words)]
    return pa.table({c.split()[0]: pa.array([v], pa.binary() if "binary" in c else pa.int64()) for c, v in zip(FILTER.split(", "), values, strict=True)})


def train(docs: DataFrame, scratch: Scratch, text_col: str = "text", hashes: int = HASHES) -> Model:
    """Learn from all texts; the filter is a table in ``scratch``."""
    size = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    n_blocks = 1 + ((size[0] or 0) + size[1]) // BLOCK_TEXT

    def count(batches):
        held = [([], []), ([], [])]
        holds = 0

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                found, first = tokens(data, offsets)
                after = np.ones(len(found), bool)
                after[first[:-1]] = False
                for (keys, counts), new in zip(held, (grams(found, 1), pairs(found)[after]), strict=True):
                    one, n = np.unique(new, return_counts=True)
                    keys.append(one)
                    counts.append(n)
                    holds += len(one)
                if holds > HELD:
                    summed = [_counted(*x) for x in held]
                    held = [([k], [n]) for k, n in summed]
                    if (left := sum(len(k) for k, _ in summed)) > HELD // 2:
                        yield from _sent(summed, n_blocks)
                        held, left = [([], []), ([], [])], 0
                    holds = left
        if holds:
            yield from _sent([_counted(*x) for x in held], n_blocks)

    sent = docs.select(text_col).mapInArrow(count, COUNTS)
    table = scratch.keep(sent.groupBy("block").applyInArrow(lambda rows: _merged(rows, hashes), FILTER))
    n_tokens, distinct, n_bytes = (x or 0 for x in table.agg(F.sum("tokens"), F.sum("distinct"), F.sum(F.octet_length("bits"))).first())
    bound, frequent = 0, [np.empty(0, np.int64)] * 2
    if distinct:
        steps = _vocabulary(table).groupBy(F.floor(4 * F.log2("count")).alias("step")).agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("step")).collect()  # some 250 rows at most
        many = np.cumsum([r["n"] for r in steps])
        fits = int(np.searchsorted(many, BROADCAST_WORDS, "right"))
        bound = steps[fits - 1]["least"] if fits else 1 << 62
        known = _vocabulary(table).where(F.col("count") >= bound).toArrow()  # BROADCAST_WORDS at most
        order = np.argsort(known["word"].to_numpy())
        frequent = [known["word"].to_numpy()[order], known["count"].to_numpy()[order]]
    return Model(table, n_blocks, max(1, math.ceil(n_bytes / SECTION_BYTES)), n_tokens, distinct, bound, hashes, tuple(frequent))


def probabilities(word_levels: np.ndarray, pair_levels: np.ndarray, first: np.ndarray, n_tokens: int, distinct: int) -> np.ndarray:
    """log10 P of each token, from what the filter says of it and of its pair."""
    single = np.minimum(MIDDLES[word_levels], n_tokens)
    alone = (single + 1) / (n_tokens + distinct + 1)
    before = np.concatenate((np.zeros(min(1, len(single))), single[:-1]))
    before[first[:-1]] = 0
    together = np.where(before > 0, np.minimum(MIDDLES[pair_levels], before), 0)
    return np.log10(np.where(before > 0, (together + MU * alone) / (before + MU), alone))


SCORED = "row long, id long, n_tokens long, n_known long, logs double, score double, rest array<long>, times array<long>"


def score(docs: DataFrame, model: Model, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score."""
    n_tokens, distinct, sections = model.tokens, model.distinct, model.sections
    frequent = docs.sparkSession.sparkContext.broadcast(model.frequent)
    complete = len(model.frequent[0]) == distinct

    def read(section: Broadcast, batch: pa.RecordBatch, found_before: bool):
        """Tokens of a batch's texts by blocks, with their levels and those of their pairs."""
        for row, end, found, first in _token_runs(batch.column(1)):
            levels = np.zeros((2, len(found)), np.uint8)
            if found_before:
                for a, b, old in zip(first[:-1].tolist(), first[1:].tolist(), batch.column(2).slice(row, end - row), strict=True):
                    levels[:, a:b] = np.frombuffer(old.as_buffer(), np.uint8).reshape(2, b - a)
            single = grams(found, 1)
            section.value.read(single, levels[0])
            section.value.read(pairs(found), levels[1])
            yield row, end, first, single, levels

    def carry(section: Broadcast, found_before: bool):
        def run(batches):
            for batch in batches:
                seen = [levels[:, a:b].tobytes() for _, _, first, _, levels in read(section, batch, found_before) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seen, pa.binary())], ["id", "text", "seen"])

        return run

    def last(section: Broadcast, found_before: bool):
        def run(batches):
            number = TaskContext.get().partitionId() << 33
            keys, counts = frequent.value
            for batch in batches:
                for row, end, first, single, levels in read(section, batch, found_before):
                    begin, size = first[:-1], np.diff(first)
                    logs = np.add.reduceat(probabilities(levels[0], levels[1], first, n_tokens, distinct), begin)
                    at = np.minimum(np.searchsorted(keys, single.view(np.int64)), max(0, len(keys) - 1))
                    known = keys[at] == single.view(np.int64) if len(keys) else np.zeros(len(single), bool)
                    exact = np.where(known, counts[at] if len(keys) else 0, 0)
                    rest, times, cuts = _rest(single, first, ~known) if not complete else (np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(end - row + 1, np.int64))
                    lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (rest, times)]
                    columns = [pa.array(number + np.arange(end - row)), batch.column(0).slice(row, end - row), pa.array(size), pa.array(np.add.reduceat(known.astype(np.int64), begin)), pa.array(np.add.reduceat(np.log10(exact + 1.0), begin)), pa.array(logs), *lists]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])
                    number += end - row

        return run

    state = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    for number in range(sections - 1):
        held = model.section(number)
        state = scratch.keep(state.mapInArrow(carry(held, number > 0), "id long, text string, seen binary"))
        held.unpersist()
    scored = state.mapInArrow(last(model.section(sections - 1), sections > 1), SCORED)
    least = math.log10(n_tokens + distinct + 1)
    plain = F.col("logs") - F.col("n_tokens") * F.lit(least)
    if complete:
        return scored.select("id", "n_tokens", "n_known", plain.alias("base_score"), "score")
    scored = scratch.keep(scored)
    rare = _vocabulary(model.table).where(F.col("count") < model.bound)
    asked = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    digits = F.round(F.log10(F.col("count") + 1) * 1e15).cast("decimal(20,0)") * F.col("times").cast("decimal(18,0)")
    joined = asked.join(rare, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(digits.cast("decimal(38,0)")).alias("digits"))
    both = scored.drop("rest", "times").join(joined, "row", "left")
    extra = F.coalesce(F.col("digits").cast("double") / 1e15, F.lit(0.0))
    return both.select("id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (plain + extra).alias("base_score"), "score")


def _rest(single: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each text among those asked for, how often each stands there, and where a text's begin."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))[which]
    keys = single[which]
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])))) if len(keys) else np.empty(0, np.int64)
    return keys[new].view(np.int64), np.diff(np.append(new, len(keys))), np.searchsorted(rows[new], np.arange(len(first)))


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES) -> DataFrame:
    """Learn from the rows that are not held out, then score all: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a condition over the id alone; where it is null the row is learned from.
    """
    out = F.coalesce(held_out, F.lit(False))
    scratch = Scratch(docs.sparkSession)
    try:
        with small_batches(docs.sparkSession):
            model = train(docs.where(~out), scratch, text_col, hashes)
            scored = score(docs, model, scratch, id_col, text_col).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
            named = scored.withColumnRenamed("id", id_col)
            return checkpoint(named.select(F.col(id_col), out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    finally:
        scratch.remove()
