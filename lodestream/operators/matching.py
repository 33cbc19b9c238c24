"""Range, as-of, interval and spatial joins as bucketed equi-joins.

A theta join would be a nested loop. Each operator here puts a bucket on both sides
(one side in the neighbouring buckets, too), joins by equality and checks the exact
condition, so Spark shuffles by bucket and memory stays bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREQ_TOLERANCE_HZ = 2500.0


def same_channel(f1: Column, b1: Column, f2: Column, b2: Column, tolerance: float = FREQ_TOLERANCE_HZ) -> Column:
    return F.abs(f1 - f2) <= F.greatest(F.lit(tolerance), (b1 + b2) / 4)


def near_buckets(value: Column, width: float) -> Column:
    """The bucket of a value and its two neighbours."""
    b = F.floor(value / width)
    return F.explode(F.array(b - 1, b, b + 1))


def channel_join(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Pairs on the same channel. ``width``: at least the widest tolerance of any pair."""
    a = left.withColumn("__b", F.floor(F.col("a_freq") / width))
    b = right.withColumn("__b", near_buckets(F.col("b_freq"), width))
    return a.join(b, "__b").where(same_channel(F.col("a_freq"), F.col("a_bw"), F.col("b_freq"), F.col("b_bw"))).drop("__b")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], t1: str, t2: str, width: int) -> DataFrame:
    """Pairs of equal keys whose times differ by at most ``width``."""
    a = left.withColumn("__b", F.floor(F.col(t1) / width))
    b = right.withColumn("__b", near_buckets(F.col(t2), width))
    return a.join(b, [*keys, "__b"]).where(F.abs(F.col(t1) - F.col(t2)) <= width).drop("__b")


#: Pairs that ``before_map`` makes at once, but for single rows that have more.
PAIRS = 1 << 17


def before_map(left: DataFrame, right: DataFrame, keys: list[str], t1: str, t2: str, width: int, step: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """What ``step`` makes of rows of ``left`` with all rows of ``right`` of equal keys that come before by at most ``width``.

    ``step`` has the columns of both as arrays, and the pairs as places in them; all pairs of a row of ``left``
    come at once and one after the other, so what a row needs of all its pairs takes no shuffle or sort of them. A task holds the rows of
    ``right`` of one bucket and ``PAIRS`` pairs. Numbers only, no nulls; rows without a key or time have no pairs.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    a = left.dropna(subset=[*keys, t1]).withColumns({"__b": bucket(t1), "__side": F.lit(1), "__t": F.col(t1)})
    b = right.dropna(subset=[*keys, t2]).withColumns({"__b": F.explode(F.array(bucket(t2), bucket(t2) + 1)), "__side": F.lit(0), "__t": F.col(t2)})
    times = t2, t1
    names = [[c for c in df.columns if c not in (*keys, t)] for df, t in ((right, t2), (left, t1))]
    every = list(dict.fromkeys(names[0] + names[1]))  # a column that both have goes once
    packed = lambda df, side: df.select(*keys, "__b", "__side", "__t", *[F.col(c) if c in names[side] else F.lit(None).alias(c) for c in every])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, joined = None, [], None
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            numbers = [column[c].to_numpy(zero_copy_only=False) for c in (*keys, "__b", "__side")]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in numbers], axis=0)) + 1 if batch.num_rows else []
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                key = tuple(x[lo] for x in numbers[:-1])
                if key != at:
                    at, before, joined = key, [], None
                side = int(numbers[-1][lo])
                part = {n: column[c].slice(lo, hi - lo).to_numpy(zero_copy_only=False) for n, c in [*zip(names[side], names[side], strict=True), (times[side], "__t")]}
                if not side:
                    before.append(part)
                    continue
                if not before:
                    continue
                if joined is None:
                    joined = {c: np.concatenate([p[c] for p in before]) for c in before[0]}
                first, end = (np.searchsorted(joined[t2], part[t1] - w, "left") for w in (width, 0))
                upto = np.cumsum(end - first)
                start = 0
                while start < hi - lo:
                    done = upto[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
                    count = (end - first)[start:stop]
                    if count.any():
                        i = np.repeat(np.arange(start, stop), count)
                        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[start:stop], count)
                        made = step(part, joined, i, j)
                        yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)
                    start = stop

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    rows = packed(a, 1).unionByName(packed(b, 0))
    return rows.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__b").sortWithinPartitions(*keys, "__b", "__side", "__t").mapInArrow(run, schema)


def last_before(frame: DataFrame, key: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """As-of join of a stream with itself: the last non-null value before each row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumns({name: F.last(v, ignorenulls=True).over(w) for name, v in values.items()})


def cells_of_segments(segments: DataFrame, cell: float) -> DataFrame:
    """Every grid cell that a segment's bounding box touches."""
    lo = lambda a, b: F.floor(F.least(a, b) / cell)
    hi = lambda a, b: F.floor(F.greatest(a, b) / cell)
    i = F.explode(F.sequence(lo(F.col("ax"), F.col("bx")), hi(F.col("ax"), F.col("bx"))))
    j = F.explode(F.sequence(lo(F.col("ay"), F.col("by")), hi(F.col("ay"), F.col("by"))))
    return segments.withColumn("ci", i).withColumn("cj", j)


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    u = F.when(length2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(length2, F.lit(0.0)))))
    ex, ey = px - (ax + u * dx), py - (ay + u * dy)
    return F.sqrt(ex * ex + ey * ey)


def crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the ray east of a point crosses an edge: even-odd rule."""
    return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def gate_join(fixes: DataFrame, tracks: DataFrame, width: float, reach: float) -> DataFrame:
    """Pairs on the same channel that lie within ``reach`` of each other on both axes. ``fixes``: a_freq, a_bw, fe, fn; ``tracks``: b_freq, b_bw, e, n.

    Channel and place are both keys, so a busy channel is spread over its places.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    a = fixes.withColumns({"__b": F.floor(F.col("a_freq") / width), "__i": cell("fe"), "__j": cell("fn")})
    b = tracks.withColumn("__b", near_buckets(F.col("b_freq"), width)).withColumn("__i", near_buckets(F.col("e"), reach)).withColumn("__j", near_buckets(F.col("n"), reach))
    near = (F.abs(F.col("fe") - F.col("e")) <= reach) & (F.abs(F.col("fn") - F.col("n")) <= reach)
    return a.join(b, ["__b", "__i", "__j"]).where(near & same_channel(F.col("a_freq"), F.col("a_bw"), F.col("b_freq"), F.col("b_bw"))).drop("__b", "__i", "__j")


#: Shares of the gate in which the nearest is looked for, one after the other, until it is sure.
SHARES = (1 / 16, 1 / 4, 1.0)


def nearest_of(a: dict[str, np.ndarray], b: dict[str, np.ndarray], gate: float, ee: float, nn: float, allowed: Callable[..., np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b``, and the distance, of the nearest track of each fix that has one; see ``nearest_in_gate``.

    Tracks are put in order by cells of a share of the gate, and a fix meets those of its cell and the cells
    around it. What is nearer than the share is nearest of all; else the fix goes on to the next share.
    """
    reach = [math.sqrt(gate * v) * (1 + 1e-9) for v in (ee, nn)]
    left = np.arange(len(a["x"]))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for share in SHARES:
        if share < 1 and len(b["x"]) * 9 * share * share < 1:
            continue
        cell = lambda d, k, share=share: np.floor(d["xy"[k]] / (reach[k] * share)).astype(np.int64)
        base = [cell(b, k).min() for k in (0, 1)]
        bx, by = (cell(b, k) - base[k] for k in (0, 1))
        wide = int(by.max()) + 1
        order = np.argsort(bx * wide + by, kind="stable")
        key = (bx * wide + by)[order]
        ax, ay = cell(a, 0)[left] - base[0], cell(a, 1)[left] - base[1]
        columns = ax[:, None] + np.array([-1, 0, 1])
        low, high = (columns * wide + np.clip(ay + d, 0, wide)[:, None] for d in (-1, 2))
        first, end = np.searchsorted(key, low), np.searchsorted(key, high)
        count = end - first
        upto = np.cumsum(count.sum(1))
        start, sure = 0, np.zeros(len(left), bool)
        while start < len(left):
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
            n = count[start:stop].ravel()
            i = np.repeat(np.repeat(np.arange(start, stop), 3), n)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:stop].ravel(), n)]
            f = left[i]
            near = np.abs(a["freq"][f] - b["freq"][j]) <= np.fmax(FREQ_TOLERANCE_HZ, (a["bw"][f] + b["bw"][j]) / 4)
            i, j, f = i[near], j[near], f[near]
            de, dn = b["x"][j] - a["x"][f], b["y"][j] - a["y"][f]
            d2 = de * de / ee + dn * dn / nn
            ok = d2 <= gate
            if allowed is not None:
                ok &= allowed(b["id"][j], de, dn)
            if share < 1:
                ok &= d2 <= gate * share * share * (1 - 1e-9)
            i, j, f, d2 = i[ok], j[ok], f[ok], d2[ok]
            best = np.lexsort((b["id"][j], d2, i))
            best = best[np.concatenate(([True], np.diff(i[best]) != 0))] if len(best) else best
            sure[i[best]] = True
            out.append((f[best], j[best], d2[best]))
            start = stop
        left = left[~sure]
    return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, int) for k in range(3))


def nearest_in_gate(fixes: DataFrame, tracks: DataFrame, width: float, gate: float, ee: float, nn: float, allowed: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """The nearest track (then the lowest) of each fix on its channel inside of a gate with the tracks' variances: observation_id, track, d2. Inputs as ``gate_join``.

    ``allowed``: of tracks and the ways east and north to them, which may take the fix. A task holds the tracks in a gate's reach of one
    cell; pairs are made in blocks and none is shuffled or sorted over the table.
    """
    reach = [math.sqrt(gate * v) * (1 + 1e-9) for v in (ee, nn)]
    cell = lambda c, k: F.floor(F.col(c) / reach[k])
    keys, columns = ["__b", "__i", "__j"], ["id", "freq", "bw", "x", "y"]
    a = fixes.select("observation_id", "a_freq", "a_bw", "fe", "fn").toDF(*columns).dropna(subset=["freq", "x", "y"])
    a = a.select("*", F.lit(1).alias("__side"), F.floor(F.col("freq") / width).alias("__b"), cell("x", 0).alias("__i"), cell("y", 1).alias("__j"))
    b = tracks.select("track", "b_freq", "b_bw", "e", "n").toDF(*columns).dropna(subset=["id", "freq", "x", "y"])
    b = b.select("*", F.lit(0).alias("__side"), near_buckets(F.col("freq"), width).alias("__b")).withColumn("__i", near_buckets(F.col("x"), reach[0])).withColumn("__j", near_buckets(F.col("y"), reach[1]))
    schema = pa.schema([("observation_id", pa.int64()), ("track", pa.int64()), ("d2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, joined = None, [], None
        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "__side")]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in numbers], axis=0)) + 1 if batch.num_rows else []
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                key = tuple(x[lo] for x in numbers[:-1])
                if key != at:
                    at, before, joined = key, [], None
                rows = batch.slice(lo, hi - lo)
                part = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in columns}
                if not numbers[-1][lo]:
                    before.append(part)
                    continue
                if before:
                    joined = joined or {c: np.concatenate([p[c] for p in before]) for c in columns}
                    f, j, d2 = nearest_of(part, joined, gate, ee, nn, allowed)
                    if len(f):
                        yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(f)), pa.array(joined["id"][j], pa.int64()), pa.array(d2, pa.float64())], schema=schema)

    rows = a.select(*keys, "__side", *columns).unionByName(b.select(*keys, "__side", *columns))
    found = rows.repartition(int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "__side").mapInArrow(run, "observation_id long, track long, d2 double")
    return found.groupBy("observation_id").agg(F.min(F.struct("d2", "track")).alias("m")).select("observation_id", "m.track", "m.d2")  # where ids repeat
