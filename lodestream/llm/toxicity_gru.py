"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words (runs of letters, A-Z lower-cased) are cut into windows of ``WINDOW``
words, each ``OVERLAP`` words into the next, so that the windows cover the whole text.
A word enters as two vectors: one of a hashed word table and the mean of its character
trigrams' vectors of a hashed table. Words and trigrams of fewer than ``MIN_DOCS`` training
texts have no vector of their own, so none of them can stand for a single text. Two gated
recurrent passes, one in each direction, read a window; attention pools their states into
one vector and a dense layer gives the window's probability. The score of a text is that
of its most toxic window.

Training is by multiple instances: a text's label holds for its highest windows. So that
the first of these are no random ones, a word's vector starts from how much more often it
stands in toxic training texts. Training uses at most ``PER_CLASS`` labelled texts per
label (whole texts).

Defined results: null and empty texts, and others without words, get the score of the
biases alone; without labelled rows all words are unknown. Rows that repeat get the same
score each; an empty table gives no rows. Only the id and the text are read, so names of
other columns cannot clash; a null id stays null. Very long texts are read in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.labelled import sample
from lodestream.llm.words_np import LOWER, blocks, mix64, row_ranges, run_hashes, runs

WINDOW, OVERLAP = 48, 12
WORD_SLOTS, CHAR_SLOTS, WORD_SIZE, CHAR_SIZE, HIDDEN = 1 << 16, 1 << 14, 8, 8, 8
PER_CLASS, EPOCHS, BATCH, RATE, SEED = 900, 10, 24, 0.02, 13
#: Training texts in which a word or trigram must stand to be known, and the weight of a word's first evidence.
MIN_DOCS, EVIDENCE = 3, 0.3
#: How much more an error on a toxic text weighs, as these are fewer.
TOXIC_WEIGHT = 2.0
#: Windows that a text's label holds for, by label; decay of the tables; share of words whose own vector is hidden in training.
TOP, DECAY, HIDE = (4, 1), 0.02, 0.3
BLOCK = 1 << 19

IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


class Windows:
    """Distinct words of some texts, and the texts' windows as indices into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends = runs(IS_LETTER[data], offsets)
        first = row_ranges(starts, offsets)
        self.texts = len(offsets) - 1
        if len(starts):
            distinct, at, self.words = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
            self.slots = (distinct % np.uint64(WORD_SLOTS)).astype(np.int64)
            self.grams, self.gram_of = self._trigrams(data, starts[at], ends[at])
        else:
            self.words = self.slots = self.grams = self.gram_of = np.empty(0, np.int64)
        counts = np.diff(first)
        step = WINDOW - OVERLAP
        n = np.where(counts > 0, np.maximum(1, -(-(counts - OVERLAP) // step)), 0)
        self.text = np.repeat(np.arange(self.texts), n)
        within = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        self.start = first[self.text] + within * step
        self.length = np.minimum(WINDOW, first[self.text + 1] - self.start)
        self.text_start = np.cumsum(n) - n
        self.per_text = n

    @staticmethod
    def _trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all character trigrams of the words, a boundary at either end, and the word of each."""
        lengths = ends - starts
        of = np.repeat(np.arange(len(starts)), lengths)
        within = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = starts[of] + within
        here = data[at].astype(np.uint64)
        before = np.where(within > 0, data[np.maximum(at - 1, 0)], 0).astype(np.uint64)
        after = np.where(within < lengths[of] - 1, data[np.minimum(at + 1, len(data) - 1)], 0).astype(np.uint64)
        code = mix64((before << np.uint64(16)) | (here << np.uint64(8)) | after)
        return (code % np.uint64(CHAR_SLOTS)).astype(np.int64), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            # the last slots: an unknown or hidden word, an unknown trigram
            "word": np.concatenate([draw(0.01, WORD_SLOTS, WORD_SIZE), np.zeros((1, WORD_SIZE), np.float32)]),
            "char": np.concatenate([draw(0.03, CHAR_SLOTS, CHAR_SIZE), np.zeros((1, CHAR_SIZE), np.float32)]),
            "in": draw(0.3, 2, WORD_SIZE + CHAR_SIZE, 3 * HIDDEN),
            "in_bias": np.zeros((2, 3 * HIDDEN), np.float32),
            "state": draw(0.3, 2, HIDDEN, 3 * HIDDEN),
            "attend": draw(0.3, 2 * HIDDEN),
            "dense": draw(0.5, 2 * HIDDEN),
            "out": np.zeros(1, np.float32),
        }
        self.known_words, self.known_grams = np.zeros(WORD_SLOTS, bool), np.zeros(CHAR_SLOTS, bool)

    def _start(self, texts: list[str], y: np.ndarray) -> None:
        """Find the known words and trigrams, and let words begin with what their training texts say."""
        words, grams = np.zeros((WORD_SLOTS, 2)), np.zeros(CHAR_SLOTS)
        for text, label in zip(texts, y.astype(int), strict=True):
            x = _windows([text])
            words[np.unique(x.slots), label] += 1
            grams[np.unique(x.grams)] += 1
        seen, share = words.sum(1), np.clip(y.mean(), 0.01, 0.99)
        self.known_words, self.known_grams = seen >= MIN_DOCS, grams >= MIN_DOCS
        toxic = (words[:, 1] + 4 * share) / (seen + 4)
        evidence = np.clip(np.log(toxic / (1 - toxic)) - np.log(share / (1 - share)), -2, 4)
        self.p["word"][:-1, 0] = EVIDENCE * evidence * self.known_words

    def _known(self, x: Windows) -> Windows:
        if len(x.slots):
            x.slots = np.where(self.known_words[x.slots], x.slots, WORD_SLOTS)
            x.grams = np.where(self.known_grams[x.grams], x.grams, CHAR_SLOTS)
        return x

    def _vectors(self, x: Windows) -> np.ndarray:
        chars = np.empty((len(x.slots), CHAR_SIZE), np.float32)
        count = np.bincount(x.gram_of, minlength=len(x.slots))
        first = np.cumsum(count) - count
        if len(x.grams):
            chars[:] = np.add.reduceat(self.p["char"][x.grams], first, axis=0) / count[:, None]
        return np.concatenate([self.p["word"][x.slots], chars], axis=1)

    def forward(self, x: Windows, pick: np.ndarray, keep: bool = False):
        """Probability of the windows ``pick``; with ``keep`` also what the gradients need."""
        n, length = len(pick), x.length[pick]
        steps = int(length.max()) if n else 0
        vectors = self._vectors(x)
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        held = []
        mask = np.arange(steps)[:, None] < length[None]
        whole = bool(mask.all())
        for way in (0, 1):
            gates = vectors @ self.p["in"][way] + self.p["in_bias"][way]
            u = self.p["state"][way]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps):
                at = np.minimum(t, length - 1) if way == 0 else np.maximum(length - 1 - t, 0)
                word = x.words[x.start[pick] + at]
                given, own = gates[word], h @ u
                zr = given[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN]
                zr = _sigmoid(zr)
                z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], own[:, 2 * HIDDEN :]
                new = np.tanh(given[:, 2 * HIDDEN :] + r * hn)
                after = new + z * (h - new)
                if not whole:
                    after = np.where(mask[t][:, None], after, h)
                if keep:
                    held.append((way, t, at, word, h, z, r, hn, new))
                h = after
                if way == 0 or whole:
                    states[steps - 1 - t if way else t, :, way * HIDDEN : (way + 1) * HIDDEN] = h
                else:
                    on = np.flatnonzero(mask[t])
                    states[at[on], on, HIDDEN:] = h[on]
        if not steps:
            return np.empty(0, np.float32), None
        weight = states @ self.p["attend"]
        weight = np.where(mask, weight, -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        context = np.einsum("tn,tnk->nk", weight, states)
        p = _sigmoid(context @ self.p["dense"] + self.p["out"][0])
        return p, (vectors, states, mask, weight, context, held, length) if keep else None

    def gradients(self, x: Windows, pick: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        p, (vectors, states, mask, weight, context, held, length) = self.forward(x, pick, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        error = ((p - y) * share).astype(np.float32)
        g["dense"] = context.T @ error
        g["out"] = np.array([error.sum()], np.float32)
        to_context = error[:, None] * self.p["dense"]
        to_weight = np.einsum("nk,tnk->tn", to_context, states)
        to_logit = weight * (to_weight - (weight * to_weight).sum(0))
        to_states = weight[:, :, None] * to_context + to_logit[:, :, None] * self.p["attend"]
        g["attend"] = np.einsum("tn,tnk->k", to_logit, states)
        to_vectors = np.zeros_like(vectors)
        to_h = {0: np.zeros((len(pick), HIDDEN), np.float32), 1: np.zeros((len(pick), HIDDEN), np.float32)}
        rows = np.arange(len(pick))
        for way, t, at, word, h, z, r, hn, new in reversed(held):
            on = mask[t][:, None]
            d = to_h[way] + np.where(on, to_states[at, rows, way * HIDDEN : (way + 1) * HIDDEN], 0)
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (h - new) * z * (1 - z)
            d_hn = d_new * r
            d_r = d_new * hn * r * (1 - r)
            own = np.where(on, np.concatenate([d_z, d_r, d_hn], axis=1), 0)
            given = np.where(on, np.concatenate([d_z, d_r, d_new], axis=1), 0)
            g["state"][way] += h.T @ own
            to_h[way] = np.where(on, d * z, d) + own @ self.p["state"][way].T
            g["in"][way] += vectors[word].T @ given
            g["in_bias"][way] += given.sum(0)
            np.add.at(to_vectors, word, given @ self.p["in"][way].T)
        np.add.at(g["word"], x.slots, to_vectors[:, :WORD_SIZE])
        count = np.bincount(x.gram_of, minlength=len(x.slots))
        np.add.at(g["char"], x.grams, (to_vectors[:, WORD_SIZE:] / np.maximum(count, 1)[:, None])[x.gram_of])
        g["char"][CHAR_SLOTS] = 0
        return g

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
        if not texts:
            return self
        rng = np.random.default_rng(seed)
        y = np.asarray(labels, np.float32)
        self._start(texts, y)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            rate = RATE * (1 - epoch / epochs) + 1e-3
            for start in range(0, len(order), BATCH):
                rows = order[start : start + BATCH]
                x = self._known(_windows([texts[i] for i in rows]))
                if not len(x.text):
                    continue
                p, _ = self.forward(x, np.arange(len(x.text)))
                rank = np.lexsort((-p, x.text))  # windows of a text, the most toxic first
                place = np.arange(len(rank)) - x.text_start[x.text[rank]]
                top = np.where(y[rows] > 0, TOP[1], TOP[0])
                pick = rank[place < top[x.text[rank]]]
                share = np.where(y[rows] > 0, TOXIC_WEIGHT, 1.0)[x.text[pick]] / (np.minimum(x.per_text, top)[x.text[pick]] * len(rows))
                x.slots = np.where(rng.random(len(x.slots)) < HIDE, WORD_SLOTS, x.slots)
                step += 1
                for k, grad in self.gradients(x, pick, y[rows][x.text[pick]], share.astype(np.float32)).items():
                    m, v = moments[k]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                    if k in ("word", "char"):
                        self.p[k] *= 1 - DECAY * rate
                self.p["word"][WORD_SLOTS] = 0
        return self

    def scores(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in blocks(column, BLOCK):
            x = self._known(Windows(data, offsets))
            p, _ = self.forward(x, np.arange(len(x.text)))
            found = np.full(x.texts, _sigmoid(self.p["out"])[0], np.float64)
            full = np.flatnonzero(x.per_text)
            if len(full):
                found[full] = np.maximum.reduceat(p, x.text_start[full])
            yield found


def _windows(texts: list[str]) -> Windows:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return Windows(np.frombuffer(b"".join(raw), np.uint8), offsets)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Network:
    return Network().fit(*sample(docs, labels, target, folds, held_out, per_class))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for batch in batches:
            found = [*network.scores(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.empty(0))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
