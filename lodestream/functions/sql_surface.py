"""The engine's functions for SQL: ``register`` makes them known to a session.

Scalar functions take whole Arrow batches. ``locate_fixes`` is a table function over the
bearings of a group: TABLE(...) PARTITION BY group_id, nought to k fixes a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestream.functions import geo_np as G
from lodestream.operators import locate

FIX = "group_id long, emitter int, reason string, basis string, lat double, lon double, ee double, en double, nn double, residual_deg double, crossing_deg double, n_bearings int, n_excluded int"
_NEEDS = ("group_id", "sensor", "lat", "lon", "bearing_deg", "sigma_deg", "basis")


def geodesic_distance_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(G.inverse(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2)))[0])


def geodesic_azimuth_deg(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(G.inverse(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2)))[1])


def destination(lat: pd.Series, lon: pd.Series, azimuth: pd.Series, distance: pd.Series) -> pd.DataFrame:
    la, lo = G.direct(*(x.to_numpy(float) for x in (lat, lon, azimuth, distance)))
    return pd.DataFrame({"lat": la, "lon": lo})


def local_en(lat0: pd.Series, lon0: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
    """East and north of a point in the plane that touches at lat0, lon0."""
    e, n = G.to_en(*(x.to_numpy(float) for x in (lat0, lon0, lat, lon)))
    return pd.DataFrame({"e": e, "n": n})


def earth_radius_m(lat: pd.Series, azimuth: pd.Series) -> pd.Series:
    return pd.Series(G.earth_radius(lat.to_numpy(float), azimuth.to_numpy(float)))


class LocateFixes:
    """Fixes of one group of bearings, whatever the order of its rows."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def eval(self, row) -> None:
        self.rows.append(tuple(row[c] for c in _NEEDS))

    def terminate(self):
        rows = sorted(self.rows, key=lambda r: (r[1], r[4]))
        column = lambda i: np.array([np.nan if r[i] is None else r[i] for r in rows], float)
        sensor = np.unique(np.array([r[1] for r in rows], str), return_inverse=True)[1].ravel()
        made = locate.locate_many(np.zeros(len(rows), int), *(column(i) for i in (2, 3, 4, 5)), sensor, np.array([r[6] for r in rows], object), 1)[0]
        number = lambda f, c: None if f.get(c) is None or np.isnan(f[c]) else float(f[c])
        for i, f in enumerate(made):
            yield (rows[0][0], i, f["reason"], f.get("basis"), *(number(f, c) for c in ("lat", "lon", "ee", "en", "nn", "residual_deg", "crossing_deg")), len(rows), int(f.get("n_excluded", 0)))


#: Functions that are expressions of Spark's own: SQL text of their bodies over their parameters.
EXPRESSIONS = {
    "wrap_bearing_deg": ("x DOUBLE", "DOUBLE", "pmod(x, 360D)"),
    "angle_difference_deg": ("a DOUBLE, b DOUBLE", "DOUBLE", "pmod(a - b + 180D, 360D) - 180D"),
    "mahalanobis2": ("de DOUBLE, dn DOUBLE, ee DOUBLE, en DOUBLE, nn DOUBLE", "DOUBLE", "(nn * de * de - 2 * en * de * dn + ee * dn * dn) / (ee * nn - en * en)"),
    "chi2_2dof": ("p DOUBLE", "DOUBLE", "-2 * ln(1 - p)"),
    "height_from_elevation": ("alt DOUBLE, ground DOUBLE, elevation DOUBLE, radius DOUBLE", "DOUBLE", "alt + ground * tan(radians(elevation)) + ground * ground / (2 * radius)"),
    "same_channel": ("freq1 DOUBLE, bandwidth1 DOUBLE, freq2 DOUBLE, bandwidth2 DOUBLE", "BOOLEAN", "abs(freq1 - freq2) <= greatest(2500D, (bandwidth1 + bandwidth2) / 4)"),
}


def register(spark: SparkSession) -> None:
    """Make all functions known to the session's SQL."""
    for f, kind in ((geodesic_distance_m, "double"), (geodesic_azimuth_deg, "double"), (earth_radius_m, "double"), (destination, "lat double, lon double"), (local_en, "e double, n double")):
        spark.udf.register(f.__name__, F.pandas_udf(f, kind))
    spark.udtf.register("locate_fixes", F.udtf(LocateFixes, returnType=FIX))
    for name, (parameters, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
