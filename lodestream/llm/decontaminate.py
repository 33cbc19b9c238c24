"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share seeds (``min_match`` words in a row) are
tiled: the longest match of words that no tile covers yet is marked, again and again,
down to ``min_match`` words; of equally long ones the first in the document, then in the
item. The length of the longest match is found by halving: whether any free windows of n
words are equal is told by running Karp-Rabin hashes, and what they tell is verified by
the words themselves before it is marked. So work grows with the words of the two texts
and the tiles, not with the pairs of equal words, also in repetitive texts. A document is
contaminated by an item if the tiles cover at least ``threshold`` of the item's words; as
tiles may stand in any order, reordered passages are caught as well.

The benchmark is read in blocks of at most ``BLOCK_TEXT`` bytes, each broadcast on its own
(so no broadcast grows with the benchmark or the documents). One block meets every
document map-side and without a shuffle. Where there are more, a filter of all seeds
(``FILTER_BITS`` at most) first picks the documents that have any; only these meet the
blocks.

Defined results: null and empty texts match nothing; items of fewer than ``min_match``
words are too short to be evidence and never match; rows that repeat (documents or items)
each give their own rows, and each row is judged by its own text, also where ids repeat
or are null; empty tables give no rows. Very long and repetitive texts are tiled in full.
Columns besides the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch
from lodestream.llm.words_np import IS_SPACE, LOWER, blocks, grams, mix64, rolling, row_ranges, run_hashes, runs, windows_of

MIN_MATCH, THRESHOLD = 5, 0.5
BLOCK_TEXT = 16 << 20
FILTER_BITS = 1 << 28
SCHEMA = "doc_id long, item_id long, item_words int, covered_words int, coverage double, tiles int, longest_tile int"


def _longest(doc: np.ndarray, item: np.ndarray, hashed: tuple, least: int, most: int, free: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int] | None:
    """Length of the longest match of free words, and where it begins in either text."""
    counts = [np.concatenate(([0], np.cumsum(f))) for f in free]

    def found(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        places = [np.flatnonzero(c[n:] - c[:-n] == n) if len(c) > n else np.empty(0, np.int64) for c in counts]
        a, b = (windows_of(h, p, n) for h, p in zip(hashed, places, strict=True))
        hit = np.isin(a, b)
        return places[0][hit], a[hit], places[1], b

    lo, hi = least - 1, most
    while lo < hi:
        middle = (lo + hi + 1) // 2
        if len(found(middle)[0]):
            lo = middle
        else:
            hi = middle - 1
    for n in range(lo, least - 1, -1):  # the first try succeeds unless hashes of different words are equal
        at, value, item_at, item_value = found(n)
        for i, v in zip(at.tolist(), value, strict=True):
            for j in item_at[item_value == v].tolist():
                if np.array_equal(doc[i : i + n], item[j : j + n]):
                    return n, i, j
    return None


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (position in the document, in the item, words), longest first. Words are numbers; negative ones equal nothing."""
    hashed = rolling(doc), rolling(item)
    free = doc >= 0, item >= 0
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= min_match and (best := _longest(doc, item, hashed, min_match, most, free)):
        n, i, j = best
        free[0][i : i + n] = free[1][j : j + n] = False
        tiles.append((i, j, n))
        most = n
    return tiles


def _spread(hits: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n words the windows of k words that begin at ``hits`` cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + k, -1)
    return np.cumsum(edges[:-1]) > 0


class Items:
    """Some benchmark items: their words as numbers, and their windows of ``min_match`` words by hash."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int, threshold: float) -> None:
        self.min_match, self.threshold = min_match, threshold
        self.number: dict[bytes, int] = {}
        self.ids, self.words, self.windows, of = [], [], [], []
        for item_id, text in items:
            raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
            ends = np.array([0, len(raw)])
            starts, stops = runs(~IS_SPACE[raw], ends)
            windows = grams(run_hashes(raw, starts, stops), min_match)
            if len(windows):
                of.append(np.full(len(windows), len(self.ids)))
                self.ids.append(item_id)
                self.windows.append(windows)
                data = raw.tobytes()
                self.words.append(np.array([self.number.setdefault(data[a:b], len(self.number)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        hashes = np.concatenate([np.empty(0, np.uint64), *self.windows])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.of = hashes[order], np.concatenate([np.empty(0, np.int64), *of])[order]

    def _candidates(self, seeds: np.ndarray) -> np.ndarray:
        """Items of which the distinct seeds might cover enough."""
        lo, hi = np.searchsorted(self.hashes, seeds, "left"), np.searchsorted(self.hashes, seeds, "right")
        size = hi - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        shared = np.bincount(self.of[at], minlength=len(self.ids))
        return np.flatnonzero((shared > 0) & (shared * self.min_match >= self.threshold * self.lengths))

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Row, item and tiles of each pair whose tiles cover enough of the item."""
        k = self.min_match
        if not len(self.hashes):
            return
        for row, end, data, offsets in blocks(column):
            data = LOWER[data]
            starts, stops = runs(~IS_SPACE[data], offsets)
            first = row_ranges(starts, offsets)
            windows = grams(run_hashes(data, starts, stops), k)
            at = np.minimum(np.searchsorted(self.hashes, windows), len(self.hashes) - 1)
            hits = np.flatnonzero(self.hashes[at] == windows)
            of_row = np.searchsorted(first, hits, "right") - 1
            hits = hits[hits + k <= first[of_row + 1]]
            cuts = np.searchsorted(hits, first)
            for r in range(end - row):
                mine = hits[cuts[r] : cuts[r + 1]]
                if not len(mine):
                    continue
                seeds = np.unique(windows[mine])
                for item in self._candidates(seeds).tolist():
                    shared = np.flatnonzero(np.isin(self.windows[item], seeds))
                    if _spread(shared, int(self.lengths[item]), k).sum() < self.threshold * self.lengths[item]:
                        continue
                    near = mine[np.isin(windows[mine], self.windows[item])] - first[r]
                    tiles = self._tiles(data, starts, stops, int(first[r]), int(first[r + 1]), near, item)
                    if sum(t[2] for t in tiles) >= self.threshold * self.lengths[item]:
                        yield row + r, item, tiles

    def _tiles(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, a: int, b: int, near: np.ndarray, item: int) -> list[tuple[int, int, int]]:
        """Tiles of the words a to b with the item; only words in windows at ``near`` can match."""
        inside = np.flatnonzero(_spread(near, b - a, self.min_match))
        gaps = np.concatenate(([0], np.cumsum(np.diff(inside) > 1)))  # one word between runs that equals nothing
        doc = np.full(len(inside) + int(gaps[-1]), -1, np.int64)
        where = np.arange(len(inside)) + gaps
        doc[where] = [self.number.get(data[s:e].tobytes(), -1) for s, e in zip(starts[a + inside].tolist(), stops[a + inside].tolist(), strict=True)]
        place = np.zeros(len(doc), np.int64)
        place[where] = inside
        return [(int(place[i]), j, n) for i, j, n in tile(doc, self.words[item], self.min_match)]


def _blocks_of(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        if held and size + len(row[1]) > limit:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def _shared(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, threshold: float) -> tuple[list[Broadcast], np.ndarray]:
    """The blocks, and the distinct seeds' places in a filter as large as their number asks for."""
    context, found, seeds = benchmark.sparkSession.sparkContext, [], [np.empty(0, np.uint64)]
    for held in _blocks_of(benchmark, id_col, text_col, BLOCK_TEXT):
        items = Items(held, min_match, threshold)
        seeds.append(np.unique(items.hashes))
        found.append(context.broadcast(items))
    if len(found) < 2:
        return found, np.empty(0, np.uint8)
    total = sum(map(len, seeds))
    bits = min(FILTER_BITS, 1 << max(20, int(16 * total).bit_length()))
    filled = np.zeros(bits // 8, np.uint8)
    for some in seeds:
        at = (mix64(some) & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(filled, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return found, filled


def _with_seeds(filled: Broadcast, k: int, column: pa.Array) -> np.ndarray:
    """Whether each text has a window that the filter knows."""
    known, found = filled.value, np.zeros(len(column), bool)
    mask = np.uint64(len(known) * 8 - 1)
    for row, _, data, offsets in blocks(column):
        data = LOWER[data]
        starts, stops = runs(~IS_SPACE[data], offsets)
        first = row_ranges(starts, offsets)
        at = (mix64(grams(run_hashes(data, starts, stops), k)) & mask).astype(np.int64)
        hits = np.flatnonzero(known[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        of_row = np.searchsorted(first, hits, "right") - 1
        found[row + of_row[hits + k <= first[of_row + 1]]] = True
    return found


def _keep(docs: DataFrame, text_col: str, wanted) -> DataFrame:
    """The rows for whose texts ``wanted`` (a function of their column) says so, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item whose tiles cover at least ``threshold`` of the item."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared, filled = _shared(benchmark, item_id_col, item_text_col, min_match, threshold)
    if len(shared) > 1:
        known = source.sparkSession.sparkContext.broadcast(filled)
        source = Scratch(source.sparkSession).keep(_keep(source, "text", lambda column: _with_seeds(known, min_match, column)))
    names, types = [x.split()[0] for x in SCHEMA.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
    found = source.sparkSession.createDataFrame([], SCHEMA)
    for number, block in enumerate(shared):

        def scan(batches, block=block):
            items = block.value
            for batch in batches:
                rows = []
                for row, item, tiles in items.matches(batch.column(1)):
                    length, covered = int(items.lengths[item]), sum(t[2] for t in tiles)
                    rows.append((batch.column(0)[row].as_py(), items.ids[item], length, covered, covered / length, len(tiles), max(t[2] for t in tiles)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        one = source.mapInArrow(scan, SCHEMA)
        found = found.unionByName(one) if number else one
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose own text no item contaminates, with all their columns."""
    shared, filled = _shared(benchmark, item_id_col, item_text_col, min_match, threshold)

    def without(block: Broadcast):
        def clean(column: pa.Array) -> np.ndarray:
            keep = np.ones(len(column), bool)
            keep[[row for row, _, _ in block.value.matches(column)]] = False
            return keep

        return clean

    if len(shared) < 2:
        return _keep(docs, text_col, without(shared[0])) if shared else docs
    known, scratch = docs.sparkSession.sparkContext.broadcast(filled), Scratch(docs.sparkSession)
    suspects = scratch.keep(_keep(docs, text_col, lambda column: _with_seeds(known, min_match, column)))
    for block in shared:
        suspects = scratch.keep(_keep(suspects, text_col, without(block)))
    return _keep(docs, text_col, lambda column: ~_with_seeds(known, min_match, column)).unionByName(suspects)
