"""Sharding by a minimax contiguous partition of atomic groups.

Equal texts are one atomic group. Groups are ordered (the few heavy ones first,
then by the leading 60 bits of the text's SHA-256), and the ordered list is cut
into ``n_shards`` contiguous shards whose largest byte count is as small as any
contiguous partition allows. The smallest feasible capacity comes from a binary
search, each candidate checked greedily.

The search runs on the driver over a bounded summary: heavy groups (at least
1/1024 of all bytes, so at most 1024) and the byte sums of 2^14 key blocks. Only
blocks in which a cut can fall for some capacity still in range are looked into,
by finer blocks or, once they hold few groups, by the groups themselves; so the
capacity is exact to the byte while what reaches the driver does not grow with the
data. Among the cuts that keep the capacity, those nearest to an even split of
what remains are taken.

Everything on the executors is DataFrame operations. Slots are numbered in two
levels (counts by sub-block, then ranks inside a sub-block). Sub-blocks are as many as
keep ``BLOCK_ROWS`` rows each on average, and heavy groups are salted row by row, so no
task holds a whole shard or a whole hot group, whatever its ids.

Defined results: null text has no bytes and counts as empty text; an empty table
gives no rows; rows that repeat, have no id or share one get slots of their own; very
long texts are groups like others. ``shard_rows`` passes other columns on whatever their
names, but for ``size``, ``shard`` and ``slot``, which it sets.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, checkpoint, enough_partitions, few, sha60, text_of

N_SHARDS = 24
HEAVY_PARTS = 1024
KEY_BITS, BLOCK_BITS, SLOT_BITS = 60, 14, 12
#: Rows of a sub-block on average, where there are more than 2^SLOT_BITS of them.
BLOCK_ROWS = 1 << 15
#: Groups that may be read to the driver at once, and the bits by which blocks are split while there are more.
MOST_GROUPS, FINER_BITS = 100_000, 6


@dataclass
class Item:
    """A run of groups in order: first key, last key + 1, bytes, groups, heavy."""

    lo: int
    hi: int
    bytes: int
    groups: int
    heavy: bool = False

    @property
    def atomic(self) -> bool:
        return self.groups <= 1


def greedy(sizes: list[int], capacity: int, most: int) -> list[int] | None:
    """Ends of the shards that greedy filling makes, as item counts; None beyond ``most`` shards."""
    ends, filled = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if filled + size > capacity:
            ends.append(i)
            filled = 0
            if len(ends) >= most:
                return None
        filled += size
    return [*ends, len(sizes)]


def smallest_capacity(sizes: list[int], n: int, lo: int, hi: int) -> int:
    """The least capacity from lo to hi for which greedy filling needs at most n shards; hi must be feasible."""
    while lo < hi:
        middle = (lo + hi) // 2
        if greedy(sizes, middle, n) is None:
            lo = middle + 1
        else:
            hi = middle
    return lo


def relaxed_feasible(items: list[Item], capacity: int, n: int) -> bool:
    """Whether n shards suffice if blocks of several groups could be cut anywhere: no less is feasible."""
    used, filled = 1, 0
    for item in items:
        if item.atomic:
            if item.bytes > capacity:
                return False
            if filled + item.bytes > capacity:
                used, filled = used + 1, 0
            filled += item.bytes
        else:
            filled += item.bytes
            more = max(0, -(-filled // capacity) - 1)
            used, filled = used + more, filled - more * capacity
    return used <= n


def bounds(items: list[Item], n: int) -> tuple[int, int]:
    sizes = [x.bytes for x in items]
    total = sum(sizes)
    hi = smallest_capacity(sizes, n, max([1, -(-total // n), *(x.bytes for x in items)]), max(1, total))
    lo, top = max([1, -(-total // n), *(x.bytes for x in items if x.atomic)]), hi
    while lo < top:
        middle = (lo + top) // 2
        if relaxed_feasible(items, middle, n):
            top = middle
        else:
            lo = middle + 1
    return lo, hi


def open_items(items: list[Item], lo: int, hi: int, n: int) -> list[int]:
    """Items of several groups in which greedy filling may cut for a capacity from lo to hi."""
    starts = [0]
    for item in items:
        starts.append(starts[-1] + item.bytes)
    found: set[int] = set()
    early = late = 0
    for _ in range(n - 1):
        late = min(late + hi, starts[-1])
        early = starts[bisect_right(starts, early + lo) - 1]
        first, last = bisect_right(starts, early) - 1, bisect_right(starts, late) - 1
        found.update(i for i in range(max(0, first), min(last, len(items) - 1) + 1) if not items[i].atomic)
    return sorted(found)


def even_cuts(sizes: list[int], capacity: int, n: int) -> list[int]:
    """Ends of n shards within the capacity, each as near as it can be to an even split of what remains."""
    starts = [0]
    for size in sizes:
        starts.append(starts[-1] + size)
    total, least = starts[-1], [0] * (n + 1)
    least[n] = total
    for shard in range(n - 1, 0, -1):  # the earliest end of a shard that leaves the rest feasible
        at = least[shard + 1] - capacity
        least[shard] = starts[min(bisect_right(starts, at - 1), len(starts) - 1)] if at > 0 else 0
    ends, at = [], 0
    for shard in range(1, n):
        most = bisect_right(starts, starts[at] + capacity) - 1
        goal = starts[at] + (total - starts[at]) / (n - shard + 1)
        after = bisect_right(starts, goal)
        near = [i for i in (after - 1, after) if at <= i <= most and starts[i] >= least[shard]]
        at = min(near, key=lambda i: abs(starts[i] - goal)) if near else most
        ends.append(at)
    return [*ends, len(sizes)]


def plan(groups: DataFrame, n_shards: int) -> tuple[dict[int, int], list[tuple[int, int]], int]:
    """Shards of the heavy keys, (first key, shard) of the others in order, and the capacity. ``groups``: k, bytes."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    is_heavy = F.col("bytes") * HEAVY_PARTS >= total
    heavy = [Item(k, k + 1, size, 1, True) for k, size in sorted(groups.where(is_heavy).select("k", "bytes").collect())]
    light = groups.where(~is_heavy)

    def blocks(some: DataFrame, bits: int) -> list[Item]:
        shift = KEY_BITS - bits
        rows = some.groupBy(F.shiftright("k", shift).alias("b")).agg(F.sum("bytes"), F.count("*")).collect()
        return [Item(b << shift, (b + 1) << shift, size, count) for b, size, count in rows]

    bits = BLOCK_BITS
    items = heavy + sorted(blocks(light, bits), key=lambda x: x.lo)
    while True:
        lo, hi = bounds(items, n_shards)
        chosen = open_items(items, lo, hi, n_shards) if lo < hi else []
        if not chosen:
            break
        spark = groups.sparkSession
        ids = spark.createDataFrame([(items[i].lo >> (KEY_BITS - bits),) for i in chosen], "b long")
        inside = light.join(F.broadcast(ids), F.shiftright("k", KEY_BITS - bits) == F.col("b"), "left_semi")
        if sum(items[i].groups for i in chosen) <= MOST_GROUPS or bits + FINER_BITS > KEY_BITS:
            finer = [Item(k, k + 1, size, 1) for k, size in inside.select("k", "bytes").collect()]
            bits = KEY_BITS
        else:
            bits += FINER_BITS
            finer = blocks(inside, bits)
        drop = set(chosen)
        items = [x for i, x in enumerate(items) if i not in drop] + finer
        items.sort(key=lambda x: (not x.heavy, x.lo))
        if bits == KEY_BITS:
            break
    sizes = [x.bytes for x in items]
    lo, hi = bounds(items, n_shards)
    capacity = smallest_capacity(sizes, n_shards, lo, hi)
    ends = even_cuts(sizes, capacity, n_shards)
    heavy_shard, firsts, shard = {}, [], 0
    for i, item in enumerate(items):
        while shard < n_shards - 1 and i >= ends[shard]:
            shard += 1
        if item.heavy:
            heavy_shard[item.lo] = shard
        elif not firsts or firsts[-1][1] != shard:
            firsts.append((item.lo if firsts else 0, shard))
    return heavy_shard, firsts, capacity


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = N_SHARDS, row_bytes: int = 8) -> DataFrame:
    """One row per input row: id, size, crc, shard, slot; a row's size is its UTF-8 bytes and ``row_bytes``."""
    rows = checkpoint(docs.select(*_keys(id_col, text_col, row_bytes), F.crc32(text_of(text_col)).alias("crc")))
    return _slots(_placed(rows, n_shards)).select("id", "size", "crc", "shard", "slot")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = N_SHARDS, row_bytes: int = 8) -> DataFrame:
    """The rows of ``docs`` with size, shard and slot."""
    rows = Scratch(docs.sparkSession).keep(docs.select(*_keys(id_col, text_col, row_bytes), F.struct(*docs.columns).alias("row")))
    placed = _slots(_placed(rows, n_shards))
    most = enough_partitions(docs.sparkSession, rows.rdd.getNumPartitions())  # those of the scan, which follow the bytes
    return few(placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot"), most)


def _keys(id_col: str, text_col: str, row_bytes: int) -> list[Column]:
    """What places a row; r is a number of its own, kept with it."""
    text = text_of(text_col)
    return [F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + F.lit(row_bytes)).alias("size"), sha60(F.sha2(text, 256)).alias("k"), F.monotonically_increasing_id().alias("r")]


def _placed(rows: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` (with k, size and r) and their shard and sub-block."""
    spark = rows.sparkSession
    groups = rows.groupBy("k").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    heavy_shard, firsts, _ = plan(groups, n_shards)
    total = rows.count()
    bits = max(SLOT_BITS, (total // BLOCK_ROWS).bit_length())

    # at most HEAVY_PARTS rows
    heavy = F.broadcast(spark.createDataFrame(list(heavy_shard.items()), "k long, heavy_shard int"))
    light_shard = F.lit(0)
    for key, shard in firsts:
        light_shard = F.when(F.col("k") >= F.lit(key), F.lit(shard)).otherwise(light_shard)
    is_heavy = F.col("heavy_shard").isNotNull()
    return (
        rows.join(heavy, "k", "left")
        .withColumn("shard", F.coalesce("heavy_shard", light_shard).cast("int"))
        .withColumn("head", F.when(is_heavy, F.col("k")).otherwise(F.lit(1 << KEY_BITS)))
        .withColumn("sub", F.when(is_heavy, F.pmod(F.xxhash64("r"), F.lit(max(64, total // BLOCK_ROWS)))).otherwise(F.shiftright("k", KEY_BITS - bits)))
    )


def _slots(placed: DataFrame) -> DataFrame:
    before = Window.partitionBy("shard").orderBy("head", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "head", "sub").count().select("shard", "head", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "head", "sub").orderBy("k", "id", "r")
    # the join's keys are the window's, so the rows do not move again; how many sub-blocks there are grows with the rows, so none is told to broadcast them
    return placed.withColumn("rank", F.row_number().over(inside)).join(offsets, ["shard", "head", "sub"]).withColumn("slot", F.col("first") + F.col("rank") - 1)
