"""Map layers against points: polygons with holes, roads, terrain.

Layers are tables. A point meets only what is in its own grid row or cell, so a layer may
be of any size; points without a match stay, with the result that this means.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import geo_sql as G
from lodestream.operators import matching as M
from lodestream.operators.lineage import cut_lineage

#: Steps of the even grid in the unit disc, samples of an uncertainty and their seed.
DISC_STEPS, SAMPLES, SEED = 25, 1000, 20260930
LLR_CLIP, WINDOW_M, MOST_PLACES, SEPARATION_M, ROAD_SIGMA_M, SHORE_SIGMA_M, PRIOR = 3.0, 2000.0, 20, 150.0, 15.0, 10.0, 0.5


def disc_grid(steps: int = DISC_STEPS) -> list[tuple[float, float]]:
    """Points of an even grid inside the unit disc."""
    ticks = [(i + 0.5) / steps * 2 - 1 for i in range(steps)]
    return [(x, y) for y in ticks for x in ticks if math.hypot(x, y) <= 1]


def near_edges(boxes: DataFrame, edges: DataFrame, row: float) -> DataFrame:
    """The boxes (x1, y1, x2, y2 and more) that an edge's own box touches; inside all others every point is on the same side of every ring."""
    rows = lambda low, high: F.explode(F.sequence(F.floor(low / row), F.floor(high / row)))
    own = edges.select(F.least("x1", "x2").alias("__a"), F.least("y1", "y2").alias("__b"), F.greatest("x1", "x2").alias("__c"), F.greatest("y1", "y2").alias("__d"))
    own = own.withColumn("__row", rows(F.col("__b"), F.col("__d")))
    met = boxes.withColumn("__row", rows(F.col("y1"), F.col("y2"))).join(own, "__row")
    touch = (F.col("__a") <= F.col("x2")) & (F.col("__c") >= F.col("x1")) & (F.col("__b") <= F.col("y2")) & (F.col("__d") >= F.col("y1"))
    return met.where(touch).select(boxes.columns).distinct()


def normal_samples(n: int = SAMPLES, seed: int = SEED) -> list[tuple[float, float]]:
    return [(round(float(a), 9), round(float(b), 9)) for a, b in np.random.default_rng(seed).standard_normal((n, 2))]


def inside_polygons(points: DataFrame, edges: DataFrame, row: float, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` and whether each is inside by the even-odd rule. ``edges``: x1, y1, x2, y2 of all rings, holes too; ``row``: height of a grid row."""
    key = "__point"
    numbered = points.withColumn(key, F.struct(*points.columns)).withColumn("__row", F.floor(F.col(y) / row))
    first, last = F.floor(F.least("y1", "y2") / row), F.floor(F.greatest("y1", "y2") / row)
    rows = edges.select("x1", "y1", "x2", "y2", F.explode(F.sequence(first, last)).alias("__row"))
    met = numbered.distinct().join(rows, "__row").where(M.crosses(F.col(x), F.col(y), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    odd = met.groupBy(key).agg(F.count("*").alias("__n")).where("__n % 2 = 1").select(key, F.lit(True).alias("inside"))
    return numbered.join(odd, key, "left").select(*points.columns, F.coalesce("inside", F.lit(False)).alias("inside"))


def nearest_segment(points: DataFrame, segments: DataFrame, key: str, cell: float) -> DataFrame:
    """The nearest segment of each point, however far. ``points``: key, x, y; ``segments``: id, ax, ay, bx, by.

    Each ring is three times as wide as the one before and takes only the points that have
    none yet; there is no last ring. Without segments no point has a row.
    """
    left, found, size = points.select(key, "x", "y"), None, cell
    if segments.isEmpty():
        return left.limit(0).select(key, F.lit(None).cast(segments.schema["id"].dataType).alias("segment"), F.lit(0.0).alias("distance"))
    while True:
        seg = M.cells_of_segments(segments, size)
        near = left.withColumn("ci", M.near_buckets(F.col("x"), size)).withColumn("cj", M.near_buckets(F.col("y"), size)).join(seg, ["ci", "cj"])
        d = M.point_segment_distance(*map(F.col, ("x", "y", "ax", "ay", "bx", "by")))
        best = near.withColumn("distance", d).where(F.col("distance") <= size).groupBy(key).agg(F.min(F.struct("distance", "id")).alias("m"))
        tried = cut_lineage(left.join(best, key, "left"))
        some = tried.where("m IS NOT NULL").select(key, F.col("m.id").alias("segment"), F.col("m.distance").alias("distance"))
        found, left = some if found is None else found.unionByName(some), tried.where("m IS NULL").drop("m")
        if left.isEmpty():
            return found
        size *= 3


def terrain(points: DataFrame, cells: DataFrame, cols: int, rows: int, x: Column, y: Column) -> DataFrame:
    """``points`` with height and slopes of a grid of unit cells, from the four nearest centres; none outside or where one of them has no data.

    Half a cell at the grid's edge takes the outermost centres.
    """
    u, v = F.greatest(F.lit(0.0), F.least(x - 0.5, F.lit(cols - 1.0))), F.greatest(F.lit(0.0), F.least(y - 0.5, F.lit(rows - 1.0)))
    i, j = F.least(F.floor(u), F.lit(cols - 2)), F.least(F.floor(v), F.lit(rows - 2))
    inside = x.between(0, cols) & y.between(0, rows)
    key = points.withColumn("__key", F.struct(*points.columns)).withColumns({"__i": i, "__j": j, "__u": u - i, "__v": v - j, "__in": inside})
    corner = lambda a, b: F.struct((F.col("__i") + a).alias("i"), (F.col("__j") + b).alias("j"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    four = key.distinct().where("__in").select("__key", "__u", "__v", F.inline(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))))
    wu, wv = F.when(F.col("a") == 1, F.col("__u")).otherwise(1 - F.col("__u")), F.when(F.col("b") == 1, F.col("__v")).otherwise(1 - F.col("__v"))
    sign = lambda c: F.when(F.col(c) == 1, 1.0).otherwise(-1.0)
    met = four.join(cells, ["i", "j"]).groupBy("__key").agg(F.sum(F.col("h") * wu * wv).alias("ground"), F.sum(F.col("h") * sign("a") * wv).alias("slope_e"), F.sum(F.col("h") * sign("b") * wu).alias("slope_n"), F.count("*").alias("__n")).where("__n = 4")
    return key.join(met, "__key", "left").select(*points.columns, "ground", "slope_e", "slope_n")


def thinned(points: Column, separation: Column, most: int = MOST_PLACES) -> Column:
    """Of points (x, y) in order those that are so far from all taken before, up to ``most``."""
    none = F.filter(points, lambda p: F.lit(False))

    def step(kept: Column, p: Column) -> Column:
        close = F.exists(kept, lambda q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)) < separation)
        return F.when((F.size(kept) < most) & ~close, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(points, none, step)


def place_llr(places: DataFrame, segments: DataFrame, key: list[str], ee: float, en: float, nn: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Log likelihood ratio of each place (key, x, y): on a road against anywhere near. ``segments``: ax, ay, ux, uy, length; ``box``: what the map covers."""
    major = math.sqrt((ee + nn) / 2 + math.sqrt(((ee - nn) / 2) ** 2 + en * en))
    radius = max(WINDOW_M, 6 * major)
    x, y = F.col("x"), F.col("y")
    grid = disc_grid()
    disc = F.array(*[F.struct(F.lit(radius * a).alias("a"), F.lit(radius * b).alias("b")) for a, b in grid])
    covered = F.size(F.filter(disc, lambda d: (x + d["a"]).between(box[0], box[2]) & (y + d["b"]).between(box[1], box[3]))) / len(grid)
    seg = M.cells_of_segments(segments.withColumns({"bx": F.col("ax") + F.col("ux") * F.col("length"), "by": F.col("ay") + F.col("uy") * F.col("length")}), radius).dropDuplicates(["ax", "ay", "ux", "uy", "length", "ci", "cj"])
    near = places.withColumn("ci", M.near_buckets(x, radius)).withColumn("cj", M.near_buckets(y, radius)).join(seg, ["ci", "cj"])
    near = near.where(M.point_segment_distance(x, y, *map(F.col, ("ax", "ay", "bx", "by"))) <= radius).dropDuplicates([*key, "x", "y", "ax", "ay", "ux", "uy", "length"])
    line = [F.col(c) for c in ("ax", "ay", "ux", "uy", "length")]
    sums = near.groupBy(*key, "x", "y").agg(F.sum(G.length_in_disc(x, y, F.lit(radius), *line)).alias("inside_m"), F.sum(G.gaussian_line_integral(x, y, F.lit(ee), F.lit(en), F.lit(nn), *line)).alias("integral"))
    all_ = places.join(sums, [*key, "x", "y"], "left").withColumn("area", math.pi * radius * radius * covered)
    ratio = F.greatest(F.lit(-LLR_CLIP), F.least(F.lit(LLR_CLIP), F.log(F.col("integral") / (F.col("inside_m") / F.col("area")))))
    return all_.withColumn("llr", F.when((F.col("inside_m") > 0) & (F.col("area") > 0) & (F.col("integral") > 0), ratio).otherwise(-LLR_CLIP))


def newest(rows: DataFrame, key: str, order: list[Column], n: int, t: str | None = None, span: float | None = None) -> DataFrame:
    """The last ``n`` rows of each key, with their place from the newest on (rn); of these, with ``span``, those of that time before the newest."""
    last = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)
    return last if span is None else last.withColumn("__top", F.max(t).over(Window.partitionBy(key))).where(F.col(t) >= F.col("__top") - span).drop("__top")
