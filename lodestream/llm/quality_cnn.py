"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over every byte of the whole text. Their
rectified responses are averaged inside overlapping chunks of ``2 * HALF`` bytes that
cover the document, max-pooled over the chunks (and averaged over all of them), and a
dense layer combines the pooled values into one probability. Two more input channels
tell the filters what a few bytes cannot show: that a word equals the one before, and
that the five words from here on stood in the text before.

A filter bank over one-hot bytes is a sum of table rows, so convolution is ``WIDTH``
gathers per byte. Memory is bounded by ``BLOCK`` bytes, or one text if that is longer.

It is fitted on at most ``PER_CLASS`` labelled texts per label (whole texts).

Defined results: null and empty texts have no bytes and get the score of the biases alone;
without labelled rows scores come from the unfitted network. Rows that repeat get the same
score each; an empty table gives no rows; very long texts are read in full. Only the text
is an input, other columns are passed on as they are, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.labelled import sample
from lodestream.llm.words_np import IS_SPACE, blocks, grams, row_ranges, run_hashes, runs

WIDTH, FILTERS, HALF = 5, 12, 128
BLOCK = 1 << 18
PER_CLASS, EPOCHS, BATCH, RATE, DECAY, SEED = 600, 9, 32, 0.01, 1e-4, 7
PAD = 256


class Inputs:
    """Padded bytes of some texts with their channels and chunk bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lengths = np.diff(offsets)
        self.texts = len(lengths)
        gap = WIDTH - 1
        of = np.repeat(np.arange(self.texts), lengths)
        self.symbols = np.full(len(data) + gap * (self.texts + 1), PAD, dtype=np.int16)
        at = np.arange(len(data)) + gap * of
        self.symbols[at] = data
        self.at = at
        self.flags = self._flags(data, offsets)
        halves = -(-lengths // HALF)
        self.full = np.flatnonzero(lengths > 0)
        self.half_of = np.repeat(np.arange(self.texts), halves)
        within = np.arange(len(self.half_of)) - np.repeat(np.cumsum(halves) - halves, halves)
        self.half_start = offsets[self.half_of] + within * HALF
        self.half_size = np.minimum(HALF, offsets[self.half_of + 1] - self.half_start)
        self.last_half = np.append(self.half_of[1:] != self.half_of[:-1], True) if len(self.half_of) else np.empty(0, bool)
        self.single = self.last_half & (within == 0)
        self.first_half = np.flatnonzero(within == 0)
        self.lengths = lengths

    @staticmethod
    def _flags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """0 to 3 for each byte: the word equals the one before, and its five words stood before."""
        starts, ends = runs(~IS_SPACE[data], offsets)
        flags = np.zeros(len(data), dtype=np.int8)
        if not len(starts):
            return flags
        hashes, first = run_hashes(data, starts, ends), row_ranges(starts, offsets)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        value = np.zeros(len(starts), dtype=np.int8)
        value[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        five = grams(hashes, 5)
        if len(five):
            key = five + row[: len(five)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(key, kind="stable")
            again = np.zeros(len(five), dtype=bool)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            again &= row[4:] == row[: len(five)]
            value[: len(five)] += 2 * again.astype(np.int8)
        np.copyto(flags, np.repeat(np.append(np.int8(0), value), np.diff(np.concatenate(([0], starts, [len(data)])))))
        return flags


class Network:
    """Filter tables, the channels' table and the dense layer."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.15, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        self.tables[:, PAD] = 0
        self.channels = rng.normal(0, 0.15, (4, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.dense = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.out = np.zeros(1, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.channels, self.bias, self.dense, self.out]

    def forward(self, x: Inputs, keep: bool = False):
        pooled = np.zeros((x.texts, 2 * FILTERS), dtype=np.float32)
        if not len(x.at):
            return self._probability(pooled), (pooled, None, None)
        z = np.take(self.channels + self.bias, x.flags, axis=0)
        for j in range(WIDTH):
            z += np.take(self.tables[j], x.symbols[x.at + j], axis=0)
        np.maximum(z, 0, out=z)
        halves = np.add.reduceat(z, x.half_start, axis=0)
        size = x.half_size.astype(np.float32)
        chunk, chunk_size = halves.copy(), size.copy()
        inner = ~x.last_half
        chunk[:-1][inner[:-1]] += halves[1:][inner[:-1]]
        chunk_size[:-1][inner[:-1]] += size[1:][inner[:-1]]
        mean = chunk / chunk_size[:, None]
        mean[x.last_half & ~x.single] = -1  # the last half belongs to the chunk before it
        pooled[x.full, :FILTERS] = np.maximum.reduceat(mean, x.first_half, axis=0)
        pooled[x.full, FILTERS:] = np.add.reduceat(halves, x.first_half, axis=0) / x.lengths[x.full, None]
        return self._probability(pooled), (pooled, z if keep else None, (mean, chunk_size) if keep else None)

    def _probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.dense + self.out[0], -30, 30)))

    def gradients(self, x: Inputs, y: np.ndarray) -> list[np.ndarray]:
        p, (pooled, z, chunks) = self.forward(x, keep=True)
        error = ((p - y) / len(y)).astype(np.float32)
        to_pooled = error[:, None] * self.dense
        g_tables, g_channels = np.zeros_like(self.tables), np.zeros_like(self.channels)
        if z is not None:
            mean, chunk_size = chunks
            by_half = np.zeros((len(x.half_of), FILTERS), dtype=np.float32)
            top = pooled[x.half_of, :FILTERS]
            for f in range(FILTERS):
                hit = np.flatnonzero(mean[:, f] == top[:, f])
                _, one = np.unique(x.half_of[hit], return_index=True)  # the first chunk that has the maximum
                hit = hit[one]
                g = to_pooled[x.half_of[hit], f] / chunk_size[hit]
                by_half[hit, f] += g
                pair = ~x.last_half[hit]
                by_half[hit[pair] + 1, f] += g[pair]
            by_half += to_pooled[x.half_of, FILTERS:] / x.lengths[x.half_of, None]
            g_z = np.repeat(by_half, x.half_size, axis=0) * (z > 0)
            for f in range(FILTERS):
                weights = g_z[:, f]
                g_channels[:, f] = np.bincount(x.flags, weights, 4)
                for j in range(WIDTH):
                    g_tables[j, :, f] = np.bincount(x.symbols[x.at + j], weights, PAD + 1)
            g_tables[:, PAD] = 0
        return [g_tables, g_channels, g_channels.sum(0), pooled.T @ error, np.array([error.sum()], np.float32)]

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
        if not texts:
            return self
        rng = np.random.default_rng(seed)
        y = np.asarray(labels, dtype=np.float32)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for start in range(0, len(order), BATCH):
                rows = order[start : start + BATCH]
                step += 1
                grads = self.gradients(_inputs([texts[i] for i in rows]), y[rows])
                for p, g, (m, v) in zip(self.parameters(), grads, moments, strict=True):
                    g = g + DECAY * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in blocks(column, BLOCK):
            yield self.forward(Inputs(data, offsets))[0]


def _inputs(texts: list[str]) -> Inputs:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return Inputs(np.frombuffer(b"".join(raw), np.uint8), offsets)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Network:
    return Network().fit(*sample(docs, labels, target, folds, held_out, per_class))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    schema = "doc_id long, score double"

    def run(batches):
        for batch in batches:
            found = [*network.scores(batch.column(1))]
            values = np.concatenate(found).astype(np.float64) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, network: Network, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = [*network.scores(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(found) >= threshold)) if found else batch

    return docs.mapInArrow(run, docs.schema)
