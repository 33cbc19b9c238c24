"""Map layers: polygons, roads, terrain, and the features that they give."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lodestream.operators import maps
from lodestream.plans.matching_queries import _EDGE_SQL, _EDGES, _SEG_SQL, _SEGMENTS
from lodestream.plans.scalar_queries import phi_sql
from lodestream.plans.tables import observations, query

_BOX = (0.0, 0.0, 9_800.0, 9_500.0)


def _edges(spark):
    return spark.createDataFrame(_EDGES, "ring int, x1 double, y1 double, x2 double, y2 double")


def _segments(spark):
    return spark.createDataFrame(_SEGMENTS, "id int, ax double, ay double, bx double, by double")


@query("point_in_polygon", f""", edge(ring, x1, y1, x2, y2) AS {_EDGE_SQL}, p AS (SELECT c_custkey, (c_custkey * 733 % 10007)::DOUBLE AS x, (c_custkey * 397 % 9001)::DOUBLE AS y FROM customer)
SELECT c_custkey, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM p CROSS JOIN edge GROUP BY 1""")
def point_in_polygon(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_custkey") * 733 % 10007).cast("double").alias("x"), (F.col("c_custkey") * 397 % 9001).cast("double").alias("y"))
    return maps.inside_polygons(p, _edges(spark), 1000.0).select("c_custkey", "inside")


@query("nearest_road", f""", seg(id, ax, ay, qx, qy) AS {_SEG_SQL}, p AS (SELECT s_suppkey, (s_suppkey * 733 % 30011)::DOUBLE AS x, (s_suppkey * 397 % 27001)::DOUBLE AS y FROM supplier),
d AS (SELECT s_suppkey, id, sqrt(power(x - (ax + u * (qx - ax)), 2) + power(y - (ay + u * (qy - ay)), 2)) AS distance FROM (SELECT *, greatest(0.0, least(1.0, ((x - ax) * (qx - ax) + (y - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)))) AS u FROM p CROSS JOIN seg))
SELECT s_suppkey, round(min(distance), 5) AS distance FROM d GROUP BY 1""")
def nearest_road(spark, sf_dir):
    """The distance to the nearest road, however far: rings grow until one is met."""
    p = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") * 733 % 30011).cast("double").alias("x"), (F.col("s_suppkey") * 397 % 27001).cast("double").alias("y"))
    return maps.nearest_segment(p, _segments(spark), "s_suppkey", 500.0).select("s_suppkey", F.round("distance", 5).alias("distance"))


_CELLS = "cell AS (SELECT i, j, 1000.0::DOUBLE + i * 37 % 101 + j * 53 % 89 AS h FROM range(12) a(i) CROSS JOIN range(12) b(j) WHERE NOT (i = 5 AND j = 5))"
_TERRAIN = f""", {_CELLS}, p AS (SELECT p_partkey, (p_partkey * 733 % 13007) / 1000.0::DOUBLE - 0.5 AS x, (p_partkey * 397 % 12001) / 1000.0::DOUBLE AS y FROM part),
q AS (SELECT *, greatest(0, least(x - 0.5, 11)) AS cu, greatest(0, least(y - 0.5, 11)) AS cv FROM p WHERE x BETWEEN 0 AND 12 AND y BETWEEN 0 AND 12),
r AS (SELECT *, least(floor(cu)::BIGINT, 10) AS i, least(floor(cv)::BIGINT, 10) AS j FROM q), s AS (SELECT *, cu - i AS u, cv - j AS v FROM r),
g AS (SELECT p_partkey, sum(c.h * CASE WHEN c.i = s.i THEN 1 - u ELSE u END * CASE WHEN c.j = s.j THEN 1 - v ELSE v END) AS ground, sum(c.h * CASE WHEN c.i = s.i THEN -1 ELSE 1 END * CASE WHEN c.j = s.j THEN 1 - v ELSE v END) AS slope_e,
  sum(c.h * CASE WHEN c.j = s.j THEN -1 ELSE 1 END * CASE WHEN c.i = s.i THEN 1 - u ELSE u END) AS slope_n FROM s JOIN cell c ON c.i IN (s.i, s.i + 1) AND c.j IN (s.j, s.j + 1) GROUP BY 1 HAVING count(*) = 4)"""


def _ground(spark, sf_dir):
    cell = spark.range(144).select((F.col("id") % 12).alias("i"), F.floor(F.col("id") / 12).alias("j")).where("not (i = 5 and j = 5)").withColumn("h", 1000.0 + F.col("i") * 37 % 101 + F.col("j") * 53 % 89)
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ((F.col("p_partkey") * 733 % 13007) / 1000.0 - 0.5).alias("x"), ((F.col("p_partkey") * 397 % 12001) / 1000.0).alias("y"))
    return maps.terrain(p, cell, 12, 12, F.col("x"), F.col("y"))


@query("terrain_bilinear", _TERRAIN + " SELECT p_partkey, round(ground, 5) AS ground, round(slope_e, 5) + 0.0 AS slope_e, round(slope_n, 5) + 0.0 AS slope_n FROM part LEFT JOIN g USING (p_partkey)")
def terrain_bilinear(spark, sf_dir):
    """Ground and slopes; null outside of the grid and next to a cell without data."""
    return _ground(spark, sf_dir).select("p_partkey", F.round("ground", 5).alias("ground"), (F.round("slope_e", 5) + 0.0).alias("slope_e"), (F.round("slope_n", 5) + 0.0).alias("slope_n"))


@query("height_above_ground", _TERRAIN + """ SELECT p_partkey, round(2000.37::DOUBLE + p_partkey % 100 - ground, 5) AS height_agl_m,
  round(sqrt(power(20.0::DOUBLE + p_partkey % 7, 2) + greatest(slope_e * slope_e * 900 + 2 * slope_e * slope_n * 100 + slope_n * slope_n * 400, 0) + 25), 5) AS sigma_m FROM g""")
def height_above_ground(spark, sf_dir):
    """Heights less the ground; the slope carries the position's error into the height's."""
    g = _ground(spark, sf_dir).where("ground is not null")
    e, n = F.col("slope_e"), F.col("slope_n")
    var = F.pow(20.0 + F.col("p_partkey") % 7, 2) + F.greatest(e * e * 900 + 2 * e * n * 100 + n * n * 400, F.lit(0.0)) + 25
    return g.select("p_partkey", F.round(2000.37 + F.col("p_partkey") % 100 - F.col("ground"), 5).alias("height_agl_m"), F.round(F.sqrt(var), 5).alias("sigma_m"))


@query("map_totals", f""", seg(id, ax, ay, qx, qy) AS {_SEG_SQL}, edge(ring, x1, y1, x2, y2) AS {_EDGE_SQL}
SELECT 'road_m' AS layer, round(sum(sqrt(power(qx - ax, 2) + power(qy - ay, 2))), 3) AS total FROM seg UNION ALL
SELECT 'water_m2', round(sum(CASE WHEN ring = 0 THEN area ELSE -area END), 3) FROM (SELECT ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edge GROUP BY 1)""")
def map_totals(spark, sf_dir):
    """Length of all roads, and area of the water less its islands."""
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    road = _segments(spark).agg(F.round(F.sum(length), 3).alias("total")).select(F.lit("road_m").alias("layer"), "total")
    rings = _edges(spark).groupBy("ring").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area"))
    water = rings.agg(F.round(F.sum(F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))), 3).alias("total"))
    return road.unionByName(water.select(F.lit("water_m2").alias("layer"), "total"))


#: A trail is what is left of 900 s (hours stand for seconds, as the table is that sparse) in a ring of 200 points.
_RING, _SPAN = 200, 900 * 3600 * 1_000_000
_TRAIL = f""", p AS (SELECT entity, t_us, observation_id, ((entity * 733 + k * 137) % 10007)::DOUBLE AS x, ((entity * 397 + k * 91) % 9001)::DOUBLE AS y FROM obs),
last AS (SELECT *, max(t_us) OVER (PARTITION BY entity) AS top FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t_us DESC, observation_id DESC) AS rn FROM p) WHERE rn <= {_RING}),
recent AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM last WHERE t_us >= top - {_SPAN}),
trail AS (SELECT entity, list(struct_pack(x := x, y := y) ORDER BY t_us DESC, observation_id DESC) AS pts FROM recent WHERE n >= 5 AND x BETWEEN {_BOX[0]} AND {_BOX[2]} AND y BETWEEN {_BOX[1]} AND {_BOX[3]} GROUP BY 1)"""
_EE, _EN, _NN = 2500.0 + maps.ROAD_SIGMA_M**2, 300.0, 1600.0 + maps.ROAD_SIGMA_M**2
_MAJOR = math.sqrt((_EE + _NN) / 2 + math.sqrt(((_EE - _NN) / 2) ** 2 + _EN**2))
_SEPARATION = max(maps.SEPARATION_M, 2 * _MAJOR)
_THIN = f"""{_TRAIL}, g AS (SELECT entity, pts, 1 AS i, pts[1:0] AS kept FROM trail UNION ALL
  SELECT entity, pts, i + 1, CASE WHEN len(kept) < {maps.MOST_PLACES} AND len(list_filter(kept, lambda q: sqrt(power(q.x - pts[i].x, 2) + power(q.y - pts[i].y, 2)) < {_SEPARATION!r})) = 0 THEN list_append(kept, pts[i]) ELSE kept END FROM g WHERE i <= len(pts)),
thin AS (SELECT entity, kept FROM g WHERE i = len(pts) + 1)"""


def _thin(spark, sf_dir):
    p = observations(spark, sf_dir).select("entity", "t_us", "observation_id", ((F.col("entity") * 733 + F.col("k") * 137) % 10007).cast("double").alias("x"), ((F.col("entity") * 397 + F.col("k") * 91) % 9001).cast("double").alias("y"))
    last = maps.newest(p, "entity", [F.desc("t_us"), F.desc("observation_id")], _RING, "t_us", _SPAN)
    covered = F.col("x").between(_BOX[0], _BOX[2]) & F.col("y").between(_BOX[1], _BOX[3])
    trail = last.groupBy("entity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(covered, F.struct("rn", "x", "y")))).alias("pts")).where((F.col("n") >= 5) & (F.size("pts") > 0))
    return trail.select("entity", maps.thinned(F.col("pts"), F.lit(_SEPARATION)).alias("kept"))


def _recursive(sql: str) -> str:
    """The observations' CTE as the first of a recursive list."""
    from lodestream.plans.tables import OBS

    return OBS.replace("WITH obs", "WITH RECURSIVE obs", 1) + sql


@query("place_thinning", _recursive(_THIN + " SELECT entity, len(kept)::INTEGER AS places, round(list_sum(list_transform(kept, lambda q: q.x)), 3) AS sum_x FROM thin"), obs=False)
def place_thinning(spark, sf_dir):
    """Separate places of each trail inside of the map, newest first."""
    total = F.aggregate("kept", F.lit(0.0), lambda s, p: s + p["x"])
    return _thin(spark, sf_dir).select("entity", F.size("kept").alias("places"), F.round(total, 3).alias("sum_x"))


_RADIUS = max(maps.WINDOW_M, 6 * _MAJOR)
_DISC = "(VALUES " + ", ".join(f"({_RADIUS * a!r}::DOUBLE, {_RADIUS * b!r}::DOUBLE)" for a, b in maps.disc_grid()) + ")"
_DET = _EE * _NN - _EN**2
_ROAD = _THIN + f""", seg0(id, ax, ay, qx, qy) AS {_SEG_SQL}, seg AS (SELECT ax, ay, len, (qx - ax) / len AS ux, (qy - ay) / len AS uy, qx, qy FROM (SELECT *, sqrt(power(qx - ax, 2) + power(qy - ay, 2)) AS len FROM seg0)),
place AS (SELECT DISTINCT entity, p.x AS x, p.y AS y FROM (SELECT entity, unnest(kept) AS p FROM thin WHERE len(kept) >= 3)), disc(a, b) AS {_DISC},
cover AS (SELECT entity, x, y, pi() * {_RADIUS!r} * {_RADIUS!r} * avg(CASE WHEN x + a BETWEEN {_BOX[0]} AND {_BOX[2]} AND y + b BETWEEN {_BOX[1]} AND {_BOX[3]} THEN 1.0::DOUBLE ELSE 0 END) AS area FROM place CROSS JOIN disc GROUP BY 1, 2, 3),
n0 AS (SELECT *, greatest(0.0, least(len, (x - ax) * ux + (y - ay) * uy)) AS foot, x - ax AS rx, y - ay AS ry FROM place CROSS JOIN seg),
n1 AS (SELECT *, (ux * -rx + uy * -ry) AS along FROM n0 WHERE sqrt(power(x - ax - foot * ux, 2) + power(y - ay - foot * uy, 2)) <= {_RADIUS!r}),
n2 AS (SELECT *, along * along - (rx * rx + ry * ry - {_RADIUS!r} * {_RADIUS!r}) AS disc2, ({_NN} * ux * ux - 2 * {_EN} * ux * uy + {_EE} * uy * uy) / {_DET!r} AS alpha, ({_NN} * ux * rx - {_EN} * (ux * ry + uy * rx) + {_EE} * uy * ry) / {_DET!r} AS beta, ({_NN} * rx * rx - 2 * {_EN} * rx * ry + {_EE} * ry * ry) / {_DET!r} AS gam FROM n1),
n3 AS (SELECT *, sqrt(alpha) * (len - beta / alpha) AS z1, -sqrt(alpha) * beta / alpha AS z0, exp(-0.5 * greatest(gam - beta * beta / alpha, 0)) / (2 * pi() * sqrt({_DET!r}::DOUBLE)) * sqrt(2 * pi() / alpha) AS scale FROM n2),
sums AS (SELECT entity, x, y, sum(CASE WHEN disc2 > 0 THEN greatest(0, least(sqrt(disc2) - along, len) - greatest(-along - sqrt(disc2), 0)) ELSE 0 END) AS inside_m, sum(scale * ({phi_sql('z1')} - {phi_sql('z0')})) AS integral FROM n3 GROUP BY 1, 2, 3),
l AS (SELECT entity, CASE WHEN inside_m > 0 AND area > 0 AND integral > 0 THEN greatest(-{maps.LLR_CLIP}, least({maps.LLR_CLIP}, ln(integral / (inside_m / area)))) ELSE -{maps.LLR_CLIP} END AS llr FROM cover LEFT JOIN sums USING (entity, x, y))
SELECT entity, count(*) AS places, round(1 / (1 + exp(-sum(llr))), 6) AS on_road FROM l GROUP BY 1"""


@query("on_road", _recursive(_ROAD), obs=False)
def on_road(spark, sf_dir):
    """Posterior of being on a road over an entity's separate places, against a random position near."""
    thin = _thin(spark, sf_dir).where(F.size("kept") >= 3)
    place = thin.select("entity", F.explode("kept").alias("p")).select("entity", "p.x", "p.y").distinct()
    seg = _segments(spark).withColumn("length", F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)))
    seg = seg.select("ax", "ay", ((F.col("bx") - F.col("ax")) / F.col("length")).alias("ux"), ((F.col("by") - F.col("ay")) / F.col("length")).alias("uy"), "length")
    scored = maps.place_llr(place, seg, ["entity"], _EE, _EN, _NN, _BOX)
    return scored.groupBy("entity").agg(F.count("*").alias("places"), F.round(1 / (1 + F.exp(-(math.log(maps.PRIOR / (1 - maps.PRIOR)) + F.sum("llr")))), 6).alias("on_road"))


_Z = maps.normal_samples()
_Z_SQL = "(VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(_Z)) + ")"
_WEE, _WEN, _WNN = 14_400.0 + maps.SHORE_SIGMA_M**2, 2_000.0, 10_000.0 + maps.SHORE_SIGMA_M**2
_L11 = math.sqrt(_WEE)
_L21 = _WEN / _L11
_L22 = math.sqrt(_WNN - _L21**2)


@query("on_water", f""", edge(ring, x1, y1, x2, y2) AS {_EDGE_SQL}, z(i, a, b) AS {_Z_SQL}, c AS (SELECT entity, (entity * 733 % 10007)::DOUBLE AS e, (entity * 397 % 9001)::DOUBLE AS n FROM (SELECT DISTINCT entity FROM obs)),
p AS (SELECT entity, i, e + {_L11!r} * a AS x, n + {_L21!r} * a + {_L22!r} * b AS y FROM c CROSS JOIN z),
h AS (SELECT entity, i, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM p CROSS JOIN edge GROUP BY 1, 2)
SELECT entity, round(avg(inside::INTEGER), 6) AS on_water FROM h GROUP BY 1""")
def on_water(spark, sf_dir):
    """Share of 1000 seeded samples of a position's uncertainty that fall on the lake, less its island."""
    z = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_Z)], "i int, a double, b double"))  # a fixed number of samples
    c = observations(spark, sf_dir).select("entity").distinct().select("entity", (F.col("entity") * 733 % 10007).cast("double").alias("e"), (F.col("entity") * 397 % 9001).cast("double").alias("n"))
    edges, rx, ry = _edges(spark), max(abs(_L11 * a) for a, _ in _Z), max(abs(_L21 * a + _L22 * b) for a, b in _Z)
    near = maps.near_edges(c.select("entity", "e", "n", (F.col("e") - rx).alias("x1"), (F.col("n") - ry).alias("y1"), (F.col("e") + rx).alias("x2"), (F.col("n") + ry).alias("y2")), edges, 1000.0)
    p = near.join(z).select("entity", "i", (F.col("e") + _L11 * F.col("a")).alias("x"), (F.col("n") + _L21 * F.col("a") + _L22 * F.col("b")).alias("y"))
    far = c.join(near, "entity", "left_anti").select("entity", F.lit(0).alias("i"), F.col("e").alias("x"), F.col("n").alias("y"))  # no shore near: all samples are where the centre is
    return maps.inside_polygons(p.unionByName(far), edges, 1000.0).groupBy("entity").agg(F.round(F.avg(F.col("inside").cast("int")), 6).alias("on_water"))
