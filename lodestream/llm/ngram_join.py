"""N-gram Jaccard join of documents with PartEnum signatures.

A document's set holds the hashes of its distinct ``k``-word shingles. Sets of sizes
2^j to 2^(j+1) - 1 form band j. For the pairs whose larger set is in band j the feature
domain is cut into partitions and each of these into ``PARTS`` parts; of every partition
all subsets of ``PARTS`` - 1 parts are enumerated, and the elements that a set has in such
a subset are one signature. Sets that are similar enough differ in at most
h = (|r| + |s|) (1 - t) / (1 + t) elements. Where a partition holds one of these, the
subset without its part is still shared; the first element in a partition spoils
``PARTS`` - 1 signatures at most and further ones the one that is left, so with P partitions
all but (PARTS - 1) min(h, P) + min(P, max(0, h - P)) of r's signatures are s's too. It suffices
to keep, in an order that all sets share, one more than that: two similar sets then have
one in common. (A set with too few non-empty signatures for that keeps all, the empty ones
included.) A set belongs to its own band and, if a larger partner can be there, to the
next. Sets that can only be similar to their equals have no signature.

Signatures that many sets share (those of passages that many documents hold) go to the
end of the order, and the sets that had one choose anew; which are such is told by a filter
of a fixed size, whose false positives only move a signature back for all sets alike.
After ``ROUNDS`` such rounds only sets remain that consist of widely shared passages almost
entirely, such as large groups of near copies. Of their buckets all sets are first compared
with one of them, the least, so a group of g near copies takes g pairs. Sets of other
components than the least one's are then compared with all in the bucket, in tiles and by
parity sketches, which never reject a similar pair: a spanning forest of what they allow
first, and then, in tiles of which a pair of the forest was not similar, all pairs of
different components.

Candidates are checked exactly: sizes and sketches first, then the sets themselves.
Equal sets are one node from the start, and links join nodes to components.

Defined results: documents without a word have no set, size 0, and are their own
component; so are null texts. Rows with a null id are linked like others and take their
component's least id that is not null. An id that repeats with different texts stands for
several documents, each linked by its own text. An empty table gives no rows. Very long
texts are read in full. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, checkpoint, enough_partitions, small_batches
from lodestream.llm.components import stars
from lodestream.llm.words_np import blocks, mix64, shingle_sets

K, PERCENT = 5, 80
#: Parts of a partition; partitions for each element in which the largest sets of a band may differ (over 1/2, or all signatures could be spoiled).
PARTS, SPREAD = 3, 0.7
#: A bucket of more nodes than this is hot; rounds of choosing anew.
HOT, ROUNDS = 16, 2
TILE = 2048
CLASS = 1.06
FILTER_BITS = 1 << 26
#: Nodes that a task remembers at once to pass over copies.
SEEN = 1 << 18
#: Signatures that a task holds before it sends them on; signatures of a block, or so.
HELD, BLOCK = 1 << 19, 1 << 17
#: Shingles for each partition of the tables between the steps, at least.
SHARE = 1 << 19
#: Signatures have 48 bits and are even; odd ones mark the sets that choose anew.
_TOKEN, _MARK = np.uint64((1 << 48) - 2), np.uint64(1)
_WEIGHTS = mix64(np.arange(7, 7 + PARTS, dtype=np.uint64)) | np.uint64(1)


def most_different(n: int, m: int, percent: int) -> int:
    """Elements in which sets of n and m elements can differ at a Jaccard similarity of ``percent``."""
    return (n + m) * (100 - percent) // (100 + percent)


def most_spoiled(different: int, partitions: int) -> int:
    """Signatures that so many differing elements can spoil."""
    return (PARTS - 1) * min(different, partitions) + min(partitions, max(0, different - partitions))


def classes_apart(percent: int) -> int:
    return math.ceil(math.log(100 / percent) / math.log(CLASS)) + 1


def band(n: int) -> int:
    return n.bit_length() - 1


@cache
def _places(j: int, percent: int) -> np.ndarray:
    """A number for each partition of band j and subset of its parts, which names the signature's place."""
    partitions = 1 + math.ceil(SPREAD * most_different((2 << j) - 1, (2 << j) - 1, percent))
    return mix64(np.arange(partitions * PARTS, dtype=np.uint64) + (np.uint64(j + 1) << np.uint64(40))).reshape(partitions, PARTS)


class Signer:
    """Signatures of sets; ``hot``: for each round so far the filter of hot signatures."""

    def __init__(self, hot: list[np.ndarray], percent: int) -> None:
        self.hot, self.percent = hot, percent

    def _all(self, found: np.ndarray, j: int) -> tuple[np.ndarray, int]:
        """All signatures of a set in band j, ordered, and how many of them to keep."""
        n, places = len(found), _places(j, self.percent)
        different = most_different(n, min((2 << j) - 1, n * 100 // self.percent), self.percent)
        if not different:
            return np.empty(0, np.uint64), 0
        keep = most_spoiled(different, len(places)) + 1
        part = (found >> np.uint64(32)) * np.uint64(places.size) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        held = np.zeros(places.size, np.uint64)
        held[part[first].astype(np.int64)] = mix64(np.add.reduceat(mix64(found), first)) | np.uint64(1)
        # the subset without part c: the sum of the others, each by a weight of its own
        weighed = held.reshape(places.shape) * _WEIGHTS
        others = weighed.sum(1, dtype=np.uint64)[:, None] - weighed
        full = others != 0
        signs = mix64(others[full] + places[full]) & _TOKEN
        if len(signs) < keep:
            signs = np.concatenate([signs, mix64(places[~full]) & _TOKEN])
            keep = len(signs)
        return np.sort(signs), keep

    def of(self, found: np.ndarray) -> np.ndarray:
        """The signatures that a set has in this round; none if no earlier round was left open."""
        n, kept = len(found), [np.empty(0, np.uint64)]
        for b in (band(n), band(n) + 1) if n else ():
            if b > band(n) and n * 100 // self.percent < 1 << b:
                continue
            signs, keep = self._all(found, b)
            prefix, last = signs[:keep], np.zeros(len(signs), dtype=bool)
            for hot in self.hot:
                if not _known(hot, prefix).any():
                    prefix = signs[:0]
                    break
                last |= _known(hot, signs)
                prefix = np.concatenate([signs[~last], signs[last]])[:keep]
            kept.append(prefix)
        return np.concatenate(kept)


def sketch(found: np.ndarray) -> bytes:
    """Parities of the numbers of elements in 4 * 2^band cells (64 at least)."""
    cells = max(64, 4 << band(len(found)))
    return np.packbits(np.bincount((mix64(found) & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1).tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of packed parities, folded to ``size`` bytes."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def size_class(n: int) -> int:
    """Sizes by factors of ``CLASS``: classes further apart than ``classes_apart`` have no similar sets."""
    return min(255, int(math.log(n) / math.log(CLASS)))


def node_of(found: np.ndarray) -> tuple[int, int]:
    """A set's size class (8 bits) and 72 bits that identify it: 16 and 64 (signed)."""
    if not len(found):
        return 0, 0
    total = mix64(np.array([found.sum(), mix64(found ^ np.uint64(0x5851F42D4C957F2D)).sum()], dtype=np.uint64))
    return size_class(len(found)) << 8 | int(total[0] >> np.uint64(56)), int(total[1:].view(np.int64)[0])


def _sets(batch: pa.RecordBatch, k: int):
    for row, _, data, offsets in blocks(batch.column(1)):
        for i, found in enumerate(shingle_sets(data, offsets, k)):
            yield row + i, found


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


@dataclass(frozen=True)
class Texts:
    """Documents (id, text), and filters of the ids that a pass takes; they are applied in the pass itself, as a step of their own takes a second Python worker for each task."""

    rows: DataFrame
    filters: tuple[Broadcast, ...] = ()

    def only(self, wanted: DataFrame) -> Texts:
        """The documents whose id a filter of the wanted nodes' ids holds, and those without an id."""
        return Texts(self.rows, (*self.filters, self.rows.sparkSession.sparkContext.broadcast(_filter_of(wanted))))

    def map(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        filters = self.filters

        def some(batches):
            for batch in batches:
                for held in filters:
                    ids = batch.column(0)
                    batch = batch.filter(pa.array(_known(held.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | np.asarray(ids.is_null())))
                yield batch

        return self.rows.mapInArrow(lambda batches: run(some(batches)), schema)


def documents_to_nodes(source: Texts, k: int) -> DataFrame:
    """id, hi, lo, n and sketch of every row."""
    schema = "id long, hi int, lo long, n long, sketch binary"

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield _rows(schema, [(ids[row], *node_of(found), len(found), sketch(found) if len(found) else None) for row, found in _sets(batch, k)])

    return source.map(run, schema)


def _signatures(batches, signer: Signer, k: int, marks: bool):
    """a (48 bits of signature, 16 of the node) and b (64 of the node) of every node's round, some ``HELD`` at once. After the first round a mark of each node that chose anew goes with them."""
    seen: set[int] = set()
    held_a, held_b, count = [], [], 0
    for batch in batches:
        for _, found in _sets(batch, k):
            hi, lo = node_of(found)
            if not len(found) or (node := hi << 64 | lo & 0xFFFFFFFFFFFFFFFF) in seen:  # copies within a task
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            signs = signer.of(found)
            if marks and len(signs) and signer.hot:
                signs = np.append(signs, mix64(np.array([lo]).view(np.uint64)) & _TOKEN | _MARK)
            if len(signs):
                held_a.append((signs << np.uint64(16)) | np.uint64(hi))
                held_b.append(np.full(len(signs), lo, np.int64))
                count += len(signs)
            if count >= HELD:
                yield np.concatenate(held_a), np.concatenate(held_b)
                held_a, held_b, count = [], [], 0
    if count:
        yield np.concatenate(held_a), np.concatenate(held_b)


def signature_rows(source: Texts, k: int, percent: int, hot: list[np.ndarray]) -> DataFrame:
    """Signatures of every node's round, a row each."""
    shared = source.rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for a, b in _signatures(batches, Signer(shared.value, percent), k, False):
            for start in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + (1 << 16)]) for c in (a.view(np.int64), b)], ["a", "b"])

    return source.map(run, "a long, b long")


def _in_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows by a (unsigned), then b."""
    order = np.argsort(a)
    a, b = a[order], b[order]
    same = a[1:] == a[:-1]
    at = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    b[at] = b[at[np.lexsort((b[at], a[at]))]]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    return a[new], b[new]


def _enough(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket ``most`` + 1 nodes at most, which tell that it is hot; distinct rows in order."""
    sign = a >> np.uint64(16)
    keep = np.ones(len(a), dtype=bool)
    keep[most + 1 :] = sign[most + 1 :] != sign[: -most - 1]
    return a[keep], b[keep]


def _packed(values: np.ndarray) -> bytes:
    """Bytes of 64-bit values by their place, so that those which are alike in sorted values compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: list[pa.Scalar]) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T).view(np.uint64).ravel() for x in raw])


def signature_blocks(source: Texts, k: int, percent: int, hot: list[np.ndarray], most: int, n_blocks: int) -> DataFrame:
    """The signatures of ``signature_rows`` and the marks, packed by blocks of the signature; of a bucket with more than ``most`` nodes in a task's share only as many as tell that it is hot."""
    shared = source.rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for a, b in _signatures(batches, Signer(shared.value, percent), k, True):
            a, b = _enough(*_in_order(a, b), most)
            block = ((a >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
            numbers, first = np.unique(block, return_index=True)
            cuts = np.append(first, len(a)).tolist()
            for some in range(0, len(numbers), 64):
                ends = list(zip(cuts[:-1], cuts[1:], strict=True))[some : some + 64]
                columns = [pa.array([_packed(v[x:y]) for x, y in ends], pa.binary()) for v in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[some : some + 64].astype(np.int64)), *columns], ["block", "a", "b"])

    return source.map(run, "block long, a binary, b binary")


PAIR = "xh int, xl long, yh int, yl long"
TILE_PAIR = "sign long, i int, j int, " + PAIR
ENDS = ["xh", "xl", "yh", "yl"]


def _bucket_pairs(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that share a bucket of at most ``most`` nodes, hot signatures, and rows that are marks; distinct rows in order."""
    at = np.arange(len(a))
    sign = a >> np.uint64(16)
    marks = at[(sign & _MARK).astype(bool)]
    at, sign = at[~(sign & _MARK).astype(bool)], sign[~(sign & _MARK).astype(bool)]
    if not len(sign):
        return at, at, sign, marks
    first = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1])))
    size = np.diff(np.append(first, len(sign)))
    hot = sign[first[size > most]]
    xs, ys = [], []
    for s in range(2, most + 1):
        these = first[size == s]
        if len(these):
            i, j = np.triu_indices(s, 1)
            xs.append((these[:, None] + i).ravel())
            ys.append((these[:, None] + j).ravel())
    none = np.empty(0, np.int64)
    return at[np.concatenate([none, *xs])], at[np.concatenate([none, *ys])], hot, marks


def small_buckets(packed: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs of nodes in buckets of at most ``most``, a row with xh = -1 and the signature as xl for every larger one, and one with xh = -2 and the node as y for every mark."""
    schema, apart = PAIR, classes_apart(percent)
    rows = packed.repartition("block").sortWithinPartitions("block")

    def pairs(a, b):
        x, y, hot, marks = _bucket_pairs(a, b, most)
        node = lambda i: ((a[i] & np.uint64(0xFFFF)).astype(np.int32), b[i])
        (xh, xl), (yh, yl) = node(x), node(y)
        near = np.abs((xh >> 8) - (yh >> 8)) <= apart  # sizes that can be similar
        xh, xl, yh, yl = xh[near], xl[near], yh[near], yl[near]
        swap = (xh > yh) | ((xh == yh) & (xl > yl))
        xh, yh = np.where(swap, yh, xh), np.where(swap, xh, yh)
        xl, yl = np.where(swap, yl, xl), np.where(swap, xl, yl)
        order = np.lexsort((yl, yh, xl, xh))
        xh, xl, yh, yl = xh[order], xl[order], yh[order], yl[order]
        keep = np.ones(len(xh), dtype=bool)
        keep[1:] = (xh[1:] != xh[:-1]) | (xl[1:] != xl[:-1]) | (yh[1:] != yh[:-1]) | (yl[1:] != yl[:-1])
        zeros, (mh, ml) = np.zeros(len(hot), np.int64), node(marks)
        columns = [np.concatenate(c) for c in ((xh[keep], np.full(len(hot), -1), np.full(len(marks), -2)), (xl[keep], hot.view(np.int64), 0 * ml), (yh[keep], zeros, mh), (yl[keep], zeros, ml))]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int64, np.int32, np.int64), strict=True)], ["xh", "xl", "yh", "yl"])

    def merged(held_a, held_b):
        return pairs(*_in_order(_unpacked(held_a), _unpacked(held_b).view(np.int64)))

    def run(batches):
        held_a, held_b, current = [], [], None
        for batch in batches:
            for block, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if block != current and held_a:
                    yield merged(held_a, held_b)
                    held_a, held_b = [], []
                current = block
                held_a.append(a)
                held_b.append(b)
        if held_a:
            yield merged(held_a, held_b)

    return rows.mapInArrow(run, schema)


Few = Callable[[DataFrame], DataFrame]


def unchanged(df: DataFrame) -> DataFrame:
    return df


def bucket_members(rows: DataFrame, few: Few = unchanged) -> DataFrame:
    """sign, hi, lo of the nodes in each bucket of the last round that has several, and the bucket's least one (rh, rl)."""
    nodes = few(rows.distinct()).select(F.shiftrightunsigned("a", 16).alias("sign"), F.col("a").bitwiseAND(0xFFFF).cast("int").alias("hi"), F.col("b").alias("lo"))
    least = nodes.groupBy("sign").agg(F.min(F.struct("hi", "lo")).alias("least"), F.count("*").alias("size")).where("size > 1")
    return nodes.join(least, "sign").select("sign", "hi", "lo", F.col("least.hi").alias("rh"), F.col("least.lo").alias("rl"))


def with_least(members: DataFrame, percent: int) -> DataFrame:
    """Each node of a bucket with the least one, if their sizes can be similar."""
    near = F.abs(F.shiftright("hi", 8) - F.shiftright("rh", 8)) <= classes_apart(percent)
    return members.where(near & F.expr("hi <> rh or lo <> rl")).select(F.col("rh").alias("xh"), F.col("rl").alias("xl"), F.col("hi").alias("yh"), F.col("lo").alias("yl")).distinct()


def labelled(rows: DataFrame, star: DataFrame, node: str = "", to: str = "c") -> DataFrame:
    """``rows`` with the component (columns ``to`` + h and l) of the node in columns hi and lo, or ``node`` + h and l."""
    hi, lo, h, l = (f"{node}h", f"{node}l", f"{to}h", f"{to}l") if node else ("hi", "lo", f"{to}h", f"{to}l")  # noqa: E741
    root = star.select(F.col("u.hi").alias(hi), F.col("u.lo").alias(lo), F.col("v.hi").alias(h), F.col("v.lo").alias(l))
    return rows.join(root, [hi, lo], "left").withColumns({h: F.coalesce(h, hi), l: F.coalesce(l, lo)})


def tile_groups(members: DataFrame, star: DataFrame, few: Few = unchanged) -> DataFrame:
    """Nodes of buckets in which some are of other components than the least one's, once for each pair of tiles: two of others, or one of others and one of the rest."""
    both = few(labelled(few(labelled(members, star)), star, "r", "k")).withColumn("other", (F.col("ch") != F.col("kh")) | (F.col("cl") != F.col("kl")))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = both.groupBy("sign").agg(tiles(F.count_if("other")).alias("others"), tiles(F.count_if(~F.col("other"))).alias("rest")).where("others > 0")
    placed = both.join(sizes, "sign").withColumn("tile", F.when(F.col("other"), F.pmod(F.xxhash64("hi", "lo"), "others")).otherwise(F.pmod(F.xxhash64("hi", "lo"), "rest") + F.col("others")).cast("int"))
    meets = F.sequence(F.lit(0), F.when(F.col("other"), F.col("others") + F.col("rest")).otherwise(F.col("others")) - 1)
    return placed.select("sign", "tile", "hi", "lo", F.explode(meets).alias("meets")).select("sign", F.least("tile", "meets").alias("i"), F.greatest("tile", "meets").alias("j"), "tile", "hi", "lo")


def tile_pairs(groups: DataFrame, nodes: DataFrame, percent: int, forest: bool, few: Few = unchanged) -> DataFrame:
    """Pairs of different components (columns ch, cl) in a tile group whose sketches allow a link; with ``forest`` only a spanning forest of them."""
    names = ["sign", "i", "j", "tile", "hi", "lo", "n", "sketch", "ch", "cl"]
    rows = few(groups.join(nodes.select("hi", "lo", "n", "sketch"), ["hi", "lo"])).select(*names).repartition("sign", "i", "j").sortWithinPartitions("sign", "i", "j", "hi", "lo")

    def pairs(t: pa.Table) -> list[tuple]:
        get = lambda c: t.column(c).to_numpy()
        t = t.take(pa.compute.sort_indices(t.column("n")))
        n, hi, lo, tile = get("n"), get("hi"), get("lo"), get("tile")
        last = np.searchsorted(n, n * 100 // percent, "right")  # sets after that are too large to be similar
        raw = t.column("sketch").to_pylist()
        size = min(map(len, raw))
        bits = np.concatenate([_fold(np.frombuffer(r, np.uint8)[None], size) for r in raw])
        pad = -size % 8
        words = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, pad)))).view(np.uint64)
        key = tuple(t.column(c)[0].as_py() for c in ("sign", "i", "j"))
        same_tile = key[1] == key[2]
        _, root = np.unique(get("cl").view(np.uint64) ^ mix64(get("ch").astype(np.uint64)), return_inverse=True)
        found = []
        for x in range(len(n) - 1):
            some = slice(x + 1, last[x])
            ok = root[some] != root[x]
            if not same_tile:
                ok &= tile[some] != tile[x]
            y = x + 1 + np.flatnonzero(ok)
            if not len(y):
                continue
            different = np.bitwise_count(words[y] ^ words[x]).sum(1)
            y = y[different * (100 + percent) <= (n[y] + n[x]) * (100 - percent)]
            for one in y.tolist():
                if forest:
                    if root[one] == root[x]:
                        continue
                    root[root == root[one]] = root[x]
                found.append((*key, *min(((int(hi[x]), int(lo[x])), (int(hi[one]), int(lo[one])))), *max(((int(hi[x]), int(lo[x])), (int(hi[one]), int(lo[one]))))))
        return found

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups_of(table: pa.Table, last: bool):
            key = np.stack([table.column(c).to_numpy() for c in ("sign", "i", "j")])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            edges = [0, *edge.tolist(), *([table.num_rows] if last else [])]
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a > 1:
                    yield table.slice(a, b - a)
            held[:] = [] if last else table.slice(edges[-1]).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 4 * TILE:
                for group in groups_of(pa.Table.from_batches(held), False):
                    yield _rows(TILE_PAIR, pairs(group))
        if held:
            for group in groups_of(pa.Table.from_batches(held), True):
                yield _rows(TILE_PAIR, pairs(group))

    return rows.mapInArrow(run, TILE_PAIR)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Three bits of the filter for each id."""
    return (np.stack([mix64(ids.view(np.uint64) + np.uint64(s)) for s in (1, 2, 3)]) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _known(filled: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the filter holds each of the ids."""
    p = _bits(ids)
    return ((filled[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(0)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids: ``FILTER_BITS`` (8 MB) whatever their number."""

    def run(batches):
        for batch in batches:
            p = _bits(batch.column(0).drop_null().to_numpy(zero_copy_only=False)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array((np.uint64(1) << (p & 63).astype(np.uint64)).view(np.int64))], ["w", "m"])

    words = ids.select("id").mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out.view(np.uint64)


def _sets_of(source: Texts, wanted: DataFrame, k: int) -> DataFrame:
    """hi, lo and the sorted set of the wanted nodes (id, hi, lo): a filter of their ids keeps other texts from being worked on or moved."""
    schema = "hi int, lo long, found binary"

    def run(batches):
        for batch in batches:
            yield _rows(schema, [(*node_of(found), found.tobytes()) for _, found in _sets(batch, k)])

    some = source.only(wanted).map(run, schema)
    return some.join(wanted.select("hi", "lo"), ["hi", "lo"], "left_semi").dropDuplicates(["hi", "lo"])


def _ends(table: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    return tuple(table.select(F.col("hi").alias(f"{e}h"), F.col("lo").alias(f"{e}l"), *([F.col("n").alias(f"{e}n")] if "n" in table.columns else []), F.col(value).alias(f"{e}v")) for e in "xy")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int, few: Few = unchanged) -> DataFrame:
    """The pairs that sizes and sketches allow to be similar."""
    x, y = _ends(nodes.select("hi", "lo", "n", "sketch"), "sketch")

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("xn", "yn"))
            keep = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
            a, b = batch.column("xv").to_pylist(), batch.column("yv").to_pylist()
            for i in np.flatnonzero(keep).tolist():
                size = min(len(a[i]), len(b[i]))
                one, two = (_fold(np.frombuffer(v[i], np.uint8)[None], size) for v in (a, b))
                keep[i] = int(np.bitwise_count(one ^ two).sum()) <= most_different(int(n[i]), int(m[i]), percent)
            yield batch.select(["xh", "xl", "yh", "yl"]).filter(pa.array(keep))

    sized = few(few(pairs.join(x, ["xh", "xl"])).join(y, ["yh", "yl"])).where(F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent)
    return sized.select("xh", "xl", "xn", "xv", "yh", "yl", "yn", "yv").mapInArrow(run, PAIR)


def links(pairs: DataFrame, source: Texts, nodes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs of nodes whose sets are similar, checked exactly."""
    pairs = scratch.keep(pairs.distinct())
    ends = pairs.select(F.col("xh").alias("hi"), F.col("xl").alias("lo")).unionByName(pairs.select(F.col("yh").alias("hi"), F.col("yl").alias("lo"))).distinct()
    ends = scratch.few(ends)
    wanted = scratch.keep(nodes.select("id", "hi", "lo").join(ends, ["hi", "lo"]))
    x, y = _ends(_sets_of(source, wanted, k), "found")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("xv"), batch.column("yv"), strict=True):
                one, two = (np.frombuffer(v.as_py(), np.uint64) for v in (a, b))
                same = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * same >= percent * (len(one) + len(two) - same))
            yield batch.select(["xh", "xl", "yh", "yl"]).filter(pa.array(keep, pa.bool_()))

    both = scratch.few(scratch.few(pairs.join(x, ["xh", "xl"])).join(y, ["yh", "yl"]))
    return both.select("xh", "xl", "xv", "yh", "yl", "yv").mapInArrow(run, PAIR)


def _edges(pairs: DataFrame) -> DataFrame:
    node = lambda e: F.struct(F.col(f"{e}h").alias("hi"), F.col(f"{e}l").alias("lo"))
    return pairs.select(node("x").alias("u"), node("y").alias("v"))


def candidates(source: Texts, nodes: DataFrame, k: int, percent: int, most: int, rounds: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs from small buckets, and the signatures of the sets that are left after the rounds."""
    found, hot = None, []
    n_blocks = 1 + (nodes.agg(F.sum("n")).first()[0] or 0) // BLOCK
    for number in range(rounds):
        made = scratch.keep(scratch.few(small_buckets(signature_blocks(source, k, percent, hot, most, n_blocks), most, percent)).distinct())
        pairs, signs = made.where("xh >= 0"), made.where("xh = -1")
        found = pairs if found is None else found.unionByName(pairs)
        hot = [*hot, _filter_of(signs.select(F.col("xl").alias("id")))]
        if number:  # the nodes that chose anew in this round; no others can in the next
            source = source.only(nodes.join(made.where("xh = -2").select(F.col("yh").alias("hi"), F.col("yl").alias("lo")), ["hi", "lo"], "left_semi"))
        if not hot[-1].any():
            break
    return found, signature_rows(source, k, percent, hot)


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, most: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links) of every row."""
    source = Texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    scratch = Scratch(docs.sparkSession)
    try:
        with small_batches(docs.sparkSession):
            return checkpoint(_linked(source, scratch, k, percent, most, rounds))
    finally:
        scratch.remove()


def _linked(source: Texts, scratch: Scratch, k: int, percent: int, most: int, rounds: int) -> DataFrame:
    rows = scratch.keep(documents_to_nodes(source, k))
    scratch.partitions = enough_partitions(rows.sparkSession, 1 + (rows.agg(F.sum("n")).first()[0] or 0) // SHARE)
    few = scratch.few
    nodes = scratch.keep(rows.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    similar = lambda pairs: links(pairs, source, nodes, k, percent, scratch)

    pairs, left = candidates(source, nodes, k, percent, most, rounds, scratch)
    members = scratch.keep(bucket_members(left, few))
    linked = lambda edges: stars(edges, scratch.partitions)
    star = linked(_edges(similar(_near(pairs.unionByName(with_least(members, percent)), nodes, percent, few))))
    groups = scratch.keep(tile_groups(members, star, few))
    if groups.limit(1).count():
        forest = scratch.keep(tile_pairs(few(labelled(groups, star)), nodes, percent, True, few))
        held = scratch.keep(similar(forest.select(ENDS)))
        star = linked(star.unionByName(_edges(held)))
        failed = forest.join(held, ENDS, "left_anti").select("sign", "i", "j").distinct()
        again = few(groups.join(failed, ["sign", "i", "j"], "left_semi"))
        more = scratch.keep(few(tile_pairs(few(labelled(again, star)), nodes, percent, False, few)).select(ENDS).distinct())
        if more.limit(1).count():
            star = linked(star.unionByName(_edges(similar(more))))

    member = star.unionByName(star.select(F.col("v").alias("u"), "v").distinct()).select("u.hi", "u.lo", F.col("v").alias("root"))
    rooted = few(nodes.select("hi", "lo", "id").join(member, ["hi", "lo"], "left")).withColumn("root", F.coalesce("root", F.struct("hi", "lo")))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    component = few(rooted.join(least, "root")).select("hi", "lo", "component_id")
    some = few(rows.where("n > 0").select("id", "n", "hi", "lo").join(component, ["hi", "lo"], "left")).select("id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
