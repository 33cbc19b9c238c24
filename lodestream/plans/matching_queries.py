"""Joins: channels, gates, as-of, semi and anti, spatial."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.functions import geo_sql as G
from lodestream.operators import matching as M
from lodestream.plans.tables import observations, query

#: Over any tolerance max(2500, (b1 + b2) / 4) of these tables.
WIDTH = 30_000.0
HOUR = 3_600_000_000

_TRACKS = """, tracks AS (SELECT entity AS track, avg(freq_hz) AS b_freq, max(bandwidth_hz) AS b_bw, max(t_us) AS last_us, count(*) AS hits,
  (entity * 733 % 20011)::DOUBLE AS e, (entity * 397 % 19997)::DOUBLE AS n FROM obs GROUP BY entity)"""


def tracks(o):
    return o.groupBy(F.col("entity").alias("track")).agg(F.avg("freq_hz").alias("b_freq"), F.max("bandwidth_hz").alias("b_bw"), F.max("t_us").alias("last_us"), F.count("*").alias("hits")).withColumns(
        {"e": (F.col("track") * 733 % 20011).cast("double"), "n": (F.col("track") * 397 % 19997).cast("double")}
    )


@query("same_channel_pairs", """, ch AS (SELECT DISTINCT entity, freq_hz, bandwidth_hz FROM obs)
SELECT a.entity AS a, b.entity AS b, a.bandwidth_hz AS a_bw, b.bandwidth_hz AS b_bw FROM ch a JOIN ch b ON a.entity < b.entity AND abs(a.freq_hz - b.freq_hz) <= greatest(2500.0, (a.bandwidth_hz + b.bandwidth_hz) / 4)""")
def same_channel_pairs(spark, sf_dir):
    ch = observations(spark, sf_dir).select("entity", "freq_hz", "bandwidth_hz").distinct()
    a = ch.toDF("a", "a_freq", "a_bw")
    return M.channel_join(a, ch.toDF("b", "b_freq", "b_bw"), WIDTH).where("a < b").select("a", "b", "a_bw", "b_bw")


@query("cross_source_pairs", f"""SELECT a.observation_id AS a, b.observation_id AS b, a.t_us - b.t_us AS offset_us FROM obs a JOIN obs b
ON a.entity = b.entity AND a.source_id < b.source_id AND abs(a.t_us - b.t_us) <= {HOUR}""")
def cross_source_pairs(spark, sf_dir):
    o = observations(spark, sf_dir).select("observation_id", "entity", "source_id", "t_us")
    a, b = o.toDF("a", "entity", "sa", "ta"), o.toDF("b", "entity", "sb", "tb")
    return M.interval_join(a, b, ["entity"], "ta", "tb", HOUR).where("sa < sb").select("a", "b", (F.col("ta") - F.col("tb")).alias("offset_us"))


@query("asof_cross_source_offset", """SELECT observation_id, source_id, t_us - last_view_us AS offset_us FROM (
  SELECT *, max(CASE WHEN source_id = 'view' THEN t_us END) OVER (PARTITION BY entity ORDER BY t_us, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view_us FROM obs) WHERE source_id <> 'view' AND last_view_us IS NOT NULL""")
def asof_cross_source_offset(spark, sf_dir):
    found = M.last_before(observations(spark, sf_dir), ["entity"], ["t_us", "observation_id"], {"last_view_us": F.when(F.col("source_id") == "view", F.col("t_us"))})
    return found.where("source_id <> 'view' and last_view_us is not null").select("observation_id", "source_id", (F.col("t_us") - F.col("last_view_us")).alias("offset_us"))


@query("reference_source", "SELECT entity, source_id AS reference, n FROM (SELECT entity, source_id, count(*) AS n, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, min(t_us), source_id) AS rn FROM obs GROUP BY 1, 2) WHERE rn = 1")
def reference_source(spark, sf_dir):
    c = observations(spark, sf_dir).groupBy("entity", "source_id").agg(F.count("*").alias("n"), F.min("t_us").alias("first"))
    w = Window.partitionBy("entity").orderBy(F.desc("n"), "first", "source_id")
    return c.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("entity", F.col("source_id").alias("reference"), "n")


@query("pairing_anti", "SELECT e.entity, s.source_id FROM (SELECT DISTINCT entity FROM obs) e CROSS JOIN (SELECT DISTINCT source_id FROM obs) s WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.entity = e.entity AND o.source_id = s.source_id AND o.k % 10 = 0)")
def pairing_anti(spark, sf_dir):
    o = observations(spark, sf_dir)
    sources = [r[0] for r in o.select("source_id").distinct().orderBy("source_id").collect()]  # one row per source
    each = o.select("entity").distinct().select("entity", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source_id"))
    return each.join(o.where("k % 10 = 0").select("entity", "source_id").distinct(), ["entity", "source_id"], "left_anti")


@query("coverage_gaps_full_outer", """, a AS (SELECT entity, count(*) AS na FROM obs WHERE k % 2 = 0 GROUP BY 1), b AS (SELECT entity, count(*) AS nb FROM obs WHERE k % 3 = 0 GROUP BY 1)
SELECT coalesce(a.entity, b.entity) AS entity, CASE WHEN b.entity IS NULL THEN 'withdrawn' WHEN a.entity IS NULL THEN 'added' WHEN na <> nb THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.entity = b.entity""")
def coverage_gaps_full_outer(spark, sf_dir):
    o = observations(spark, sf_dir)
    a = o.where("k % 2 = 0").groupBy("entity").agg(F.count("*").alias("na"))
    b = o.where("k % 3 = 0").groupBy("entity").agg(F.count("*").alias("nb"))
    change = F.when(F.col("nb").isNull(), "withdrawn").when(F.col("na").isNull(), "added").when(F.col("na") != F.col("nb"), "changed").otherwise("same")
    return a.join(b, "entity", "full_outer").select("entity", change.alias("change"))


_SEGMENTS = [(i, float(400 * i), float((i * 977) % 9000), float(400 * i + 900), float((i * 977 + 1300) % 9000)) for i in range(25)]
_SEG_SQL = "(VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, a, b, c, d in _SEGMENTS) + ")"


@query("grid_nearest_segment", f""", seg(id, ax, ay, qx, qy) AS {_SEG_SQL}, p AS (SELECT s_suppkey, (s_suppkey * 733 % 10007)::DOUBLE AS x, (s_suppkey * 397 % 9001)::DOUBLE AS y FROM supplier),
d AS (SELECT s_suppkey, id, round(sqrt(power(x - (ax + u * (qx - ax)), 2) + power(y - (ay + u * (qy - ay)), 2)), 6) AS distance FROM (
  SELECT *, greatest(0.0, least(1.0, ((x - ax) * (qx - ax) + (y - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)))) AS u FROM p CROSS JOIN seg))
SELECT s_suppkey, id::INTEGER AS segment, distance FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, id) AS rn FROM d WHERE distance <= 1000) WHERE rn = 1""")
def grid_nearest_segment(spark, sf_dir):
    cell = 1000.0
    seg = M.cells_of_segments(spark.createDataFrame(_SEGMENTS, "id int, ax double, ay double, bx double, by double"), cell)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    p = s.select("s_suppkey", (F.col("s_suppkey") * 733 % 10007).cast("double").alias("x"), (F.col("s_suppkey") * 397 % 9001).cast("double").alias("y"))
    p = p.withColumn("ci", M.near_buckets(F.col("x"), cell)).withColumn("cj", M.near_buckets(F.col("y"), cell))
    d = F.round(M.point_segment_distance(*map(F.col, ("x", "y", "ax", "ay", "bx", "by"))), 6)
    near = p.join(F.broadcast(seg), ["ci", "cj"]).withColumn("distance", d).where("distance <= 1000")
    return near.groupBy("s_suppkey").agg(F.min(F.struct("distance", "id")).alias("m")).select("s_suppkey", F.col("m.id").alias("segment"), "m.distance")


_RINGS = [(0, [(1000, 1000), (9000, 1500), (8000, 8000), (2000, 7000)]), (1, [(4000, 3000), (6000, 3500), (5500, 5500), (4200, 5000)])]
_EDGES = [(r, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for r, ring in _RINGS for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
_EDGE_SQL = "(VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, a, b, c, d in _EDGES) + ")"


