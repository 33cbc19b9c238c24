"""Memory, picture and geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.functions import geo_sql as G
from lodestream.plans.tables import observations, query


@query("memory_evict", "SELECT entity, last_us FROM (SELECT entity, max(t_us) AS last_us FROM obs GROUP BY 1) WHERE last_us >= (SELECT max(t_us) FROM obs) - 604800000000 ORDER BY last_us DESC, entity LIMIT 50")
def memory_evict(spark, sf_dir):
    o = observations(spark, sf_dir)
    last = o.groupBy("entity").agg(F.max("t_us").alias("last_us"))
    newest = F.broadcast(last.agg(F.max("last_us").alias("now")))  # one row
    return last.crossJoin(newest).where("last_us >= now - 604800000000").select("entity", "last_us").orderBy(F.desc("last_us"), "entity").limit(50)


_LOG = """, log AS (SELECT observation_id AS seq, entity, CASE WHEN k % 11 = 0 THEN 'remove' ELSE 'upsert' END AS op, duration_s AS value FROM obs)"""


def _log(spark, sf_dir):
    return observations(spark, sf_dir).select(F.col("observation_id").alias("seq"), "entity", F.when(F.col("k") % 11 == 0, "remove").otherwise("upsert").alias("op"), F.col("duration_s").alias("value"))


@query("changelog_latest", _LOG + "SELECT entity, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 'upsert'")
def changelog_latest(spark, sf_dir):
    latest = _log(spark, sf_dir).groupBy("entity").agg(F.max(F.struct("seq", "op", "value")).alias("m"))
    return latest.where("m.op = 'upsert'").select("entity", "m.seq", "m.value")


@query("resume_after_seq", _LOG + "SELECT seq, entity, op FROM log WHERE seq > (SELECT max(seq) - 500 FROM log)")
def resume_after_seq(spark, sf_dir):
    log = _log(spark, sf_dir)
    top = F.broadcast(log.agg((F.max("seq") - 500).alias("from_seq")))  # one row
    return log.join(top, F.col("seq") > F.col("from_seq")).select("seq", "entity", "op")


@query("lifecycle_state", """, t AS (SELECT entity, max(t_us) AS last_us, count(*) AS hits FROM obs GROUP BY 1), n AS (SELECT max(t_us) AS now_us FROM obs)
SELECT entity, CASE WHEN hits < 3 AND now_us - last_us > 180000000 THEN 'retired' WHEN hits < 3 THEN 'tentative' WHEN now_us - last_us > 604800000000 THEN 'retired' WHEN now_us - last_us > 90000000 THEN 'coasting' ELSE 'confirmed' END AS state FROM t CROSS JOIN n""")
def lifecycle_state(spark, sf_dir):
    t = observations(spark, sf_dir).groupBy("entity").agg(F.max("t_us").alias("last_us"), F.count("*").alias("hits"))
    now = F.broadcast(t.agg(F.max("last_us").alias("now_us")))  # one row
    silent = F.col("now_us") - F.col("last_us")
    state = F.when((F.col("hits") < 3) & (silent > 180_000_000), "retired").when(F.col("hits") < 3, "tentative").when(silent > 604_800_000_000, "retired").when(silent > 90_000_000, "coasting").otherwise("confirmed")
    return t.crossJoin(now).select("entity", state.alias("state"))


@query("sensor_board", "SELECT source_id || ':' || entity % 10 AS sensor, max(t_us) AS heard_us, arg_max(bearing_deg, observation_id) AS bearing_deg FROM obs GROUP BY 1")
def sensor_board(spark, sf_dir):
    sensor = F.concat_ws(":", "source_id", (F.col("entity") % 10).cast("string"))
    return observations(spark, sf_dir).groupBy(sensor.alias("sensor")).agg(F.max("t_us").alias("heard_us"), F.max_by("bearing_deg", "observation_id").alias("bearing_deg"))


@query("keyframes_30s", "SELECT t_us // 30000000 AS frame, count(DISTINCT entity) AS n_entities, max(observation_id) AS last_seq FROM obs GROUP BY 1")
def keyframes_30s(spark, sf_dir):
    return observations(spark, sf_dir).groupBy(F.floor(F.col("t_us") / 30_000_000).alias("frame")).agg(F.countDistinct("entity").alias("n_entities"), F.max("observation_id").alias("last_seq"))


@query("geo_angles", """SELECT observation_id, round((((bearing_deg * 3 - 400) % 360) + 360) % 360, 6) AS wrapped, round(CASE WHEN (((bearing_deg - 190) % 360) + 360) % 360 > 180 THEN (((bearing_deg - 190) % 360) + 360) % 360 - 360 ELSE (((bearing_deg - 190) % 360) + 360) % 360 END, 6) AS difference,
  round(sin(radians(bearing_deg)) + 0.0, 6) + 0.0 AS e, round(cos(radians(bearing_deg)), 6) + 0.0 AS n FROM obs""")
def geo_angles(spark, sf_dir):
    b = F.col("bearing_deg")
    e, n = G.bearing_unit_en(b)
    return observations(spark, sf_dir).select("observation_id", F.round(G.wrap_bearing_deg(b * 3 - 400), 6).alias("wrapped"), F.round(G.angle_difference_deg(b, F.lit(190.0)), 6).alias("difference"), (F.round(e, 6) + 0.0).alias("e"), (F.round(n, 6) + 0.0).alias("n"))


_C = "(SELECT observation_id, 900.0::DOUBLE + k * 10 AS ee, 100.0::DOUBLE - k AS en, 400.0::DOUBLE + k * 7 AS nn, radians(k * 3.0::DOUBLE) AS th FROM obs)"


@query("rotate_covariance", f"SELECT observation_id, round(cos(th) * cos(th) * ee + 2 * cos(th) * sin(th) * en + sin(th) * sin(th) * nn, 4) AS ee, round(-cos(th) * sin(th) * ee + (cos(th) * cos(th) - sin(th) * sin(th)) * en + cos(th) * sin(th) * nn, 4) AS en, round(sin(th) * sin(th) * ee - 2 * cos(th) * sin(th) * en + cos(th) * cos(th) * nn, 4) AS nn FROM {_C}")
def rotate_covariance(spark, sf_dir):
    k = F.col("k")
    ee, en, nn = G.rotate_covariance(900.0 + k * 10, 100.0 - k, 400.0 + k * 7, k * 3.0)
    return observations(spark, sf_dir).select("observation_id", F.round(ee, 4).alias("ee"), F.round(en, 4).alias("en"), F.round(nn, 4).alias("nn"))


@query("covariance_to_ellipse", f"SELECT observation_id, round(2.4477 * sqrt((ee + nn) / 2 + sqrt(power((ee - nn) / 2, 2) + en * en)), 4) AS major, round(2.4477 * sqrt(greatest((ee + nn) / 2 - sqrt(power((ee - nn) / 2, 2) + en * en), 0)), 4) AS minor, round(((degrees(atan2(2 * en, nn - ee) / 2) % 180) + 180) % 180, 4) AS orientation FROM {_C}")
def covariance_to_ellipse(spark, sf_dir):
    k = F.col("k")
    a, b, o = G.covariance_to_ellipse(900.0 + k * 10, 100.0 - k, 400.0 + k * 7, 2.4477)
    return observations(spark, sf_dir).select("observation_id", F.round(a, 4).alias("major"), F.round(b, 4).alias("minor"), F.round(o, 4).alias("orientation"))


@query("ellipse_to_covariance", "SELECT observation_id, round(a * s * s + b * c * c, 4) AS ee, round((a - b) * s * c, 4) + 0.0 AS en, round(a * c * c + b * s * s, 4) AS nn FROM (SELECT observation_id, power((200.0 + k) / 2.4477, 2) AS a, power((50.0 + k) / 2.4477, 2) AS b, sin(radians(bearing_deg)) AS s, cos(radians(bearing_deg)) AS c FROM obs)")
def ellipse_to_covariance(spark, sf_dir):
    k = F.col("k")
    ee, en, nn = G.ellipse_to_covariance(200.0 + k, 50.0 + k, F.col("bearing_deg"), 2.4477)
    return observations(spark, sf_dir).select("observation_id", F.round(ee, 4).alias("ee"), (F.round(en, 4) + 0.0).alias("en"), F.round(nn, 4).alias("nn"))


@query("mahalanobis_gate", f"SELECT observation_id, round((nn * 400 - 2 * en * 600 + ee * 900) / (ee * nn - en * en), 6) AS d2, (nn * 400 - 2 * en * 600 + ee * 900) / (ee * nn - en * en) <= 2.0 AS gated FROM {_C}")
def mahalanobis_gate(spark, sf_dir):
    k = F.col("k")
    d2 = G.mahalanobis2(F.lit(20.0), F.lit(30.0), 900.0 + k * 10, 100.0 - k, 400.0 + k * 7)
    return observations(spark, sf_dir).select("observation_id", F.round(d2, 6).alias("d2"), (d2 <= 2.0).alias("gated"))


@query("earth_radius", """, g AS (SELECT observation_id, k, radians(bearing_deg) AS az, 1 - 0.0066943799901413165 * power(sin(radians((k * 1.7::DOUBLE) % 80)), 2) AS w2 FROM obs)
SELECT observation_id, round(1 / (power(cos(az), 2) / (6378137.0 * (1 - 0.0066943799901413165) / power(sqrt(w2), 3)) + power(sin(az), 2) / (6378137.0 / sqrt(w2))), 3) AS radius_m FROM g""")
def earth_radius(spark, sf_dir):
    return observations(spark, sf_dir).select("observation_id", F.round(G.earth_radius_m((F.col("k") * 1.7) % 80, F.col("bearing_deg")), 3).alias("radius_m"))


@query("height_from_elevation", "SELECT observation_id, round(100 + (500.0 + k) * tan(radians(k % 60)) + (500.0 + k) * (500.0 + k) / (2 * 6371000.0), 6) AS height_m FROM obs")
def height_from_elevation(spark, sf_dir):
    k = F.col("k")
    return observations(spark, sf_dir).select("observation_id", F.round(G.height_from_elevation(F.lit(100.0), 500.0 + k, (k % 60).cast("double"), F.lit(6371000.0)), 6).alias("height_m"))
