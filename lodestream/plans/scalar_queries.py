"""Scalar functions: geodesy, densities, number texts, JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lodestream.functions import geo_np
from lodestream.functions import geo_sql as G
from lodestream.plans.tables import observations, query


def phi_sql(z: str) -> str:
    """The normal distribution function of a column in SQL."""
    x = f"abs({z})"

    def polynomial(c: tuple[float, ...]) -> str:
        text = f"{c[0]}::DOUBLE"
        for one in c[1:]:
            text = f"({text} * {x} + {one}::DOUBLE)"
        return text

    far = f"({x} + 0.65::DOUBLE)"
    for i in (4, 3, 2, 1):
        far = f"({x} + {i}.0::DOUBLE / {far})"
    tail = f"(CASE WHEN {x} < {G.PHI_FAR}::DOUBLE THEN exp(-{x} * {x} / 2) * {polynomial(G.PHI_ABOVE)} / {polynomial(G.PHI_BELOW)} ELSE exp(-{x} * {x} / 2) / {far} / sqrt(2 * pi()) END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def _geodesy(o, schema: str, f):
    """Columns that ``f`` computes with numpy from a frame's columns, batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return o.mapInPandas(run, schema)


@query("geodesic_round_trip", "SELECT observation_id, round(1000.0::DOUBLE + k * 731, 3) AS distance_m, round(CASE WHEN bearing_deg = 360 THEN 0 ELSE bearing_deg END, 6) AS azimuth_deg FROM obs")
def geodesic_round_trip(spark, sf_dir):
    """Destinations by the direct problem, and distance and azimuth to them by the inverse one."""

    def both(p: pd.DataFrame) -> pd.DataFrame:
        lat, lon = geo_np.direct(p["lat"].to_numpy(), p["lon"].to_numpy(), p["bearing_deg"].to_numpy(), p["m"].to_numpy())
        distance, azimuth = geo_np.inverse(p["lat"].to_numpy(), p["lon"].to_numpy(), lat, lon)
        azimuth = azimuth.round(6) % 360
        return pd.DataFrame({"observation_id": p["observation_id"], "distance_m": distance.round(3), "azimuth_deg": azimuth})

    o = observations(spark, sf_dir).select("observation_id", "bearing_deg", (F.col("k") * 1.3 - 60).alias("lat"), (F.col("k") * 3.5 - 175).alias("lon"), (1000.0 + F.col("k") * 731).alias("m"))
    return _geodesy(o, "observation_id long, distance_m double, azimuth_deg double", both)


@query("local_frame_round_trip", "SELECT observation_id, round(k * 731.0::DOUBLE - 30000, 3) + 0.0 AS e, round(bearing_deg * 97.0::DOUBLE - 17000, 3) + 0.0 AS n FROM obs")
def local_frame_round_trip(spark, sf_dir):
    """Latitude and longitude of points in the plane at an origin, and back."""

    def both(p: pd.DataFrame) -> pd.DataFrame:
        lat0, lon0 = p["lat"].to_numpy(), p["lon"].to_numpy()
        e, n = geo_np.to_en(lat0, lon0, *geo_np.from_en(lat0, lon0, p["e"].to_numpy(), p["n"].to_numpy()))
        return pd.DataFrame({"observation_id": p["observation_id"], "e": e.round(3) + 0.0, "n": n.round(3) + 0.0})

    o = observations(spark, sf_dir).select("observation_id", (F.col("k") * 1.3 - 60).alias("lat"), (F.col("k") * 3.5 - 175).alias("lon"), (F.col("k") * 731.0 - 30000).alias("e"), (F.col("bearing_deg") * 97.0 - 17000).alias("n"))
    return _geodesy(o, "observation_id long, e double, n double", both)


@query("centroid_frame", "SELECT entity, round(avg(k * 1.3::DOUBLE - 60), 9) AS lat, round(degrees(atan2(avg(sin(radians(k * 3.5::DOUBLE - 3))), avg(cos(radians(k * 3.5::DOUBLE - 3))))), 9) AS lon FROM obs GROUP BY 1")
def centroid_frame(spark, sf_dir):
    """Mean latitude and circular mean longitude of an entity's sensors."""
    lon = F.radians(F.col("k") * 3.5 - 3)
    return observations(spark, sf_dir).groupBy("entity").agg(F.round(F.avg(F.col("k") * 1.3 - 60), 9).alias("lat"), F.round(F.degrees(F.atan2(F.avg(F.sin(lon)), F.avg(F.cos(lon)))), 9).alias("lon"))


@query("frame_bearings", "SELECT observation_id, 0.0::DOUBLE AS north_on_meridian, round(CASE WHEN bearing_deg = 360 THEN 0 ELSE bearing_deg END, 5) AS at_origin FROM obs")
def frame_bearings(spark, sf_dir):
    """Bearing in the plane of true north on the origin's meridian, and of an azimuth at the origin itself."""

    def both(p: pd.DataFrame) -> pd.DataFrame:
        lat, lon = p["lat"].to_numpy(), p["lon"].to_numpy()
        north = geo_np.frame_bearing(lat, lon, lat + 0.3, lon, 0.0 * lat)
        own = geo_np.frame_bearing(lat, lon, lat, lon, p["bearing_deg"].to_numpy())
        return pd.DataFrame({"observation_id": p["observation_id"], "north_on_meridian": north.round(5) % 360 + 0.0, "at_origin": own.round(5) % 360})

    o = observations(spark, sf_dir).select("observation_id", "bearing_deg", (F.col("k") * 1.3 - 60).alias("lat"), (F.col("k") * 3.5 - 175).alias("lon"))
    return _geodesy(o, "observation_id long, north_on_meridian double, at_origin double", both)


@query("plane_covariance", "SELECT observation_id, round(900.0::DOUBLE + k * 10 + 400 + k * 7, 3) AS trace, round((900.0::DOUBLE + k * 10) * (400 + k * 7) - (100.0::DOUBLE - k) * (100 - k), 1) AS det, true AS turned FROM obs WHERE k > 0")
def plane_covariance(spark, sf_dir):
    """A covariance in the axes of a map's plane: turned by the meridian's convergence, which keeps trace and determinant."""

    def north(p: pd.DataFrame) -> pd.DataFrame:
        p["turn"] = geo_np.frame_bearing(p["lat"].to_numpy(), p["lon"].to_numpy(), p["lat"].to_numpy() + 0.2, p["lon"].to_numpy() + 0.4, 0.0 * p["lat"].to_numpy())
        return p

    o = observations(spark, sf_dir).where("k > 0").select("observation_id", (F.col("k") * 0.5 + 10).alias("lat"), (F.col("k") * 1.0).alias("lon"), (900.0 + F.col("k") * 10).alias("ee"), (100.0 - F.col("k")).alias("en"), (400.0 + F.col("k") * 7).alias("nn"))
    t = _geodesy(o, "observation_id long, lat double, lon double, ee double, en double, nn double, turn double", north)
    ee, en, nn = G.rotate_covariance(F.col("ee"), F.col("en"), F.col("nn"), F.col("turn"))
    return t.select("observation_id", F.round(ee + nn, 3).alias("trace"), F.round(ee * nn - en * en, 1).alias("det"), (F.abs(G.angle_difference_deg(F.col("turn"), F.lit(0.0))).between(0.01, 1.0)).alias("turned"))


@query("bearing_vectors", """SELECT observation_id, round(sin(radians(b)), 6) + 0.0 AS unit_e, round(cos(radians(b)), 6) + 0.0 AS unit_n, round(cos(radians(b)), 6) + 0.0 AS normal_e, round(-sin(radians(b)), 6) + 0.0 AS normal_n, round(b, 6) AS back
FROM (SELECT observation_id, CASE WHEN bearing_deg = 360 THEN 0.0::DOUBLE ELSE bearing_deg END AS b FROM obs)""")
def bearing_vectors(spark, sf_dir):
    b = F.col("bearing_deg")
    (ue, un), (ne, nn) = G.bearing_unit_en(b), G.bearing_normal_en(b)
    flat = lambda c: F.round(c, 6) + 0.0
    back = F.round(G.bearing_from_en(ue, un), 6)
    return observations(spark, sf_dir).select("observation_id", flat(ue).alias("unit_e"), flat(un).alias("unit_n"), flat(ne).alias("normal_e"), flat(nn).alias("normal_n"), F.when(back >= 360, 0.0).otherwise(back).alias("back"))


@query("exact_elevation", """, p AS (SELECT observation_id, radians(40.0::DOUBLE + k % 20) AS la, radians(10.0::DOUBLE + k % 7) AS lo, 100.0::DOUBLE + k AS h, radians(40.0::DOUBLE + k % 20 + 0.1) AS lb, radians(10.0::DOUBLE + k % 7 + 0.1) AS lp, 3000.0::DOUBLE + k * 40 AS g FROM obs),
n AS (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(la) * sin(la)) AS na, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(lb) * sin(lb)) AS nb FROM p),
d AS (SELECT *, (nb + g) * cos(lb) * cos(lp) - (na + h) * cos(la) * cos(lo) AS dx, (nb + g) * cos(lb) * sin(lp) - (na + h) * cos(la) * sin(lo) AS dy, (nb * (1 - 0.0066943799901413165) + g) * sin(lb) - (na * (1 - 0.0066943799901413165) + h) * sin(la) AS dz FROM n)
SELECT observation_id, round(degrees(asin((dx * cos(la) * cos(lo) + dy * cos(la) * sin(lo) + dz * sin(la)) / sqrt(dx * dx + dy * dy + dz * dz))), 6) AS elevation_deg FROM d""")
def exact_elevation(spark, sf_dir):
    k = F.col("k")
    lat, lon = 40.0 + k % 20, 10.0 + k % 7
    return observations(spark, sf_dir).select("observation_id", F.round(G.exact_elevation_deg(lat, lon, 100.0 + k, lat + 0.1, lon + 0.1, 3000.0 + k * 40), 6).alias("elevation_deg"))


@query("chi2_scales", """SELECT observation_id, round(-2 * ln(1 - 0.95::DOUBLE) * (1 + k), 6) AS at_95, round(sqrt(-2 * ln(1 - 0.99::DOUBLE)) * (1 + k), 6) AS axes_99,
  round(d * power(1 - 2 / (9 * d) + 1.6449 * sqrt(2 / (9 * d)), 3), 6) AS q95, round(d * power(1 - 2 / (9 * d) + 2.3263 * sqrt(2 / (9 * d)), 3), 6) AS q99 FROM (SELECT *, 2.0::DOUBLE * (1 + k) AS d FROM obs)""")
def chi2_scales(spark, sf_dir):
    d = 2.0 * (1 + F.col("k"))
    return observations(spark, sf_dir).select(
        "observation_id", F.round(G.chi2_2dof(0.95) * (1 + F.col("k")), 6).alias("at_95"), F.round(G.chi2_2dof_scale(0.99) * (1 + F.col("k")), 6).alias("axes_99"),
        F.round(G.chi2_quantile(d, 1.6449), 6).alias("q95"), F.round(G.chi2_quantile(d, 2.3263), 6).alias("q99"),
    )


@query("normal_cdf", f"SELECT observation_id, round({phi_sql('z')}, 9) AS p FROM (SELECT observation_id, (k - 50) * 0.171::DOUBLE AS z FROM obs)")
def normal_cdf(spark, sf_dir):
    return observations(spark, sf_dir).select("observation_id", F.round(G.normal_cdf((F.col("k") - 50) * 0.171), 9).alias("p"))


@query("log_densities", """, p AS (SELECT observation_id, k, 3.0::DOUBLE + k % 7 AS d, 2.0::DOUBLE + k AS v, -0.5 * (power(3.0::DOUBLE + k % 7, 2) / (2.0::DOUBLE + k) + ln(2 * pi() * (2.0::DOUBLE + k))) AS one,
  -0.5 * (((400.0::DOUBLE + k * 7) * 400 - 2 * (100.0::DOUBLE - k) * 600 + (900.0::DOUBLE + k * 10) * 900) / ((900.0::DOUBLE + k * 10) * (400 + k * 7) - (100.0::DOUBLE - k) * (100 - k)) + ln(4 * pi() * pi() * ((900.0::DOUBLE + k * 10) * (400 + k * 7) - (100.0::DOUBLE - k) * (100 - k)))) AS two FROM obs)
SELECT observation_id, round(one, 6) AS one, round(two, 6) AS two, round(CASE WHEN k % 11 = 0 THEN two ELSE ln(exp(one) + exp(two)) END, 6) AS both_ FROM p""")
def log_densities(spark, sf_dir):
    """Log densities in one and two dimensions, and the log of their sum, in which a term may be absent."""
    k = F.col("k")
    one, two = G.log_normal(3.0 + k % 7, 2.0 + k), G.log_normal2(F.lit(20.0), F.lit(30.0), 900.0 + k * 10, 100.0 - k, 400.0 + k * 7)
    absent = F.when(k % 11 == 0, G.safe_log(F.lit(0.0))).otherwise(one)
    return observations(spark, sf_dir).select("observation_id", F.round(one, 6).alias("one"), F.round(two, 6).alias("two"), F.round(G.logsumexp(absent, two), 6).alias("both_"))


@query("log_scale", "SELECT observation_id, round(log10(greatest(duration_s, 1e-12)), 9) AS x, round(coalesce(sigma_deg, 0) / (greatest(duration_s, 1e-12) * ln(10.0::DOUBLE)), 9) AS sigma FROM obs WHERE duration_s > 0")
def log_scale(spark, sf_dir):
    x, sigma = G.log_scale(F.col("duration_s"), F.col("sigma_deg"))
    return observations(spark, sf_dir).where("duration_s > 0").select("observation_id", F.round(x, 9).alias("x"), F.round(sigma, 9).alias("sigma"))


_SOFT = 3.5


@query("range_likelihood", f""", z AS (SELECT observation_id, k, duration_s AS x, sqrt({_SOFT}::DOUBLE * {_SOFT} + 4) AS s, (90 - duration_s) / sqrt({_SOFT}::DOUBLE * {_SOFT} + 4) AS hi, (20 - duration_s) / sqrt({_SOFT}::DOUBLE * {_SOFT} + 4) AS lo FROM obs)
SELECT observation_id, round(CASE WHEN k % 13 = 0 THEN exp(-0.5 * lo * lo) / (s * sqrt(2 * pi())) ELSE greatest({phi_sql('hi')} - {phi_sql('lo')}, 1e-12) / 70 END, 12) AS likelihood FROM z""")
def range_likelihood(spark, sf_dir):
    """Soft-edged range of durations from 20 to 90 s; every thirteenth is one without a width, at 20 s."""
    high = F.when(F.col("k") % 13 == 0, 20.0).otherwise(90.0)
    return observations(spark, sf_dir).select("observation_id", F.round(G.range_likelihood(F.col("duration_s"), F.lit(2.0), F.lit(20.0), high, F.lit(_SOFT)), 12).alias("likelihood"))


@query("json_pointer", "SELECT entity, '/' || replace(replace('a~b/' || entity, '~', '~0'), '/', '~1') || '/' || entity % 10 AS pointer FROM (SELECT DISTINCT entity FROM obs)")
def json_pointer(spark, sf_dir):
    escaped = lambda c: F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    key = F.concat(F.lit("a~b/"), F.col("entity").cast("string"))
    return observations(spark, sf_dir).select("entity").distinct().select("entity", F.concat(F.lit("/"), F.concat_ws("/", escaped(key), escaped((F.col("entity") % 10).cast("string")))).alias("pointer"))


@query("number_texts", """, v AS (SELECT observation_id, freq_hz * power(10.0::DOUBLE, k % 4 - 3) * 1.00037::DOUBLE + k * 1234.5 AS f, abs(duration_s) * (1 + k % 90) * 1.00037::DOUBLE AS d, abs(duration_s) * (1 + k) * 1.00037::DOUBLE AS m FROM obs)
SELECT observation_id, CASE WHEN f >= 1e9 THEN format('{:.4g} GHz', f / 1e9) WHEN f >= 1e6 THEN format('{:.4g} MHz', f / 1e6) WHEN f >= 1e3 THEN format('{:.4g} kHz', f / 1e3) ELSE format('{:.4g} Hz', f) END AS freq,
  CASE WHEN d >= 7200 THEN printf('%.1f h', d / 3600) WHEN d >= 120 THEN printf('%.0f min', d / 60) ELSE printf('%.0f s', d) END AS duration,
  CASE WHEN m >= 1000 THEN printf('%.1f km', m / 1000) ELSE printf('%.0f m', m) END AS distance FROM v""")
def number_texts(spark, sf_dir):
    """Frequencies to four significant digits, durations and distances with their units."""
    v = observations(spark, sf_dir).select(
        "observation_id", (F.col("freq_hz") * F.pow(F.lit(10.0), F.col("k") % 4 - 3) * 1.00037 + F.col("k") * 1234.5).alias("f"),
        (F.abs("duration_s") * (1 + F.col("k") % 90) * 1.00037).alias("d"), (F.abs("duration_s") * (1 + F.col("k")) * 1.00037).alias("m"),
    )
    f, d, m = F.col("f"), F.col("d"), F.col("m")
    with_unit = lambda x, unit: F.concat(G.four_digits(x), F.lit(unit))
    return v.select(
        "observation_id",
        F.when(f >= 1e9, with_unit(f / 1e9, " GHz")).when(f >= 1e6, with_unit(f / 1e6, " MHz")).when(f >= 1e3, with_unit(f / 1e3, " kHz")).otherwise(with_unit(f, " Hz")).alias("freq"),
        F.when(d >= 7200, F.format_string("%.1f h", d / 3600)).when(d >= 120, F.format_string("%.0f min", d / 60)).otherwise(F.format_string("%.0f s", d)).alias("duration"),
        F.when(m >= 1000, F.format_string("%.1f km", m / 1000)).otherwise(F.format_string("%.0f m", m)).alias("distance"),
    )


@query("picture_json", """SELECT entity, '{"entity_id":' || entity || ',"label":"E' || entity || '"' || CASE WHEN n > 60 THEN ',"region":{"basis":"measured","n":' || n || '}' ELSE '' END || CASE WHEN h IS NOT NULL THEN ',"hints":["' || h || '"]' ELSE '' END || '}' AS object
FROM (SELECT entity, count(*) AS n, min(source_id) FILTER (k % 10 = 0) AS h FROM obs GROUP BY 1)""")
def picture_json(spark, sf_dir):
    """Nested objects of the picture; what is not known is left out."""
    e = observations(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n"), F.min(F.when(F.col("k") % 10 == 0, F.col("source_id"))).alias("h"))
    region = F.when(F.col("n") > 60, F.struct(F.lit("measured").alias("basis"), F.col("n")))
    hints = F.when(F.col("h").isNotNull(), F.array("h"))
    return e.select("entity", F.to_json(F.struct(F.col("entity").alias("entity_id"), F.concat(F.lit("E"), F.col("entity").cast("string")).alias("label"), region.alias("region"), hints.alias("hints"))).alias("object"))


