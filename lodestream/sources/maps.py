"""Map layers: GeoJSON lines and polygons, ESRI ASCII grids. Small files, read whole on the driver."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _geometries(node: dict) -> list[dict]:
    kind = node.get("type")
    if kind == "FeatureCollection":
        return [g for f in node["features"] for g in _geometries(f)]
    if kind == "Feature":
        return _geometries(node["geometry"]) if node.get("geometry") else []
    if kind == "GeometryCollection":
        return [g for x in node["geometries"] for g in _geometries(x)]
    return [node]


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all lines: id, ax, ay, bx, by (longitude, latitude)."""
    rows = []
    for g in _geometries(json.loads(_text(spark, path))):
        if g["type"] not in ("LineString", "MultiLineString"):
            raise ValueError(f"{path}: roads are lines, not {g['type']}")
        for line in [g["coordinates"]] if g["type"] == "LineString" else g["coordinates"]:
            rows += [(len(rows) + i, *map(float, a[:2]), *map(float, b[:2])) for i, (a, b) in enumerate(zip(line, line[1:], strict=False))]
    return spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double")


def read_water(spark: SparkSession, path: str) -> DataFrame:
    """Edges of all rings: poly, ring, is_hole, x1, y1, x2, y2."""
    rows = []
    polygons = [p for g in _geometries(json.loads(_text(spark, path))) for p in ([g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"])]
    for poly, rings in enumerate(polygons):
        for ring, points in enumerate(rings):
            if points[0] != points[-1]:
                raise ValueError(f"{path}: ring {ring} of polygon {poly} is not closed")
            rows += [(poly, ring, ring > 0, *map(float, a[:2]), *map(float, b[:2])) for a, b in zip(points, points[1:], strict=False)]
    return spark.createDataFrame(rows, "poly int, ring int, is_hole boolean, x1 double, y1 double, x2 double, y2 double")


def read_terrain(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Cells (col, row, h; none where there is no data) and the header."""
    lines = _text(spark, path).split("\n")
    header, at = {}, 0
    while lines[at].split() and lines[at].split()[0].lower()[0].isalpha():
        key, value = lines[at].split()[:2]
        header[key.lower()] = float(value)
        at += 1
    missing = {"ncols", "nrows", "cellsize"} - set(header)
    if missing:
        raise ValueError(f"{path}: header lacks {sorted(missing)}")
    values = [float(v) for line in lines[at:] for v in line.split()]
    cols, nodata = int(header["ncols"]), header.get("nodata_value", math.nan)
    if len(values) != cols * int(header["nrows"]):
        raise ValueError(f"{path}: {len(values)} heights for {cols} columns and {int(header['nrows'])} rows")
    rows = [(i % cols, i // cols, v) for i, v in enumerate(values) if v != nodata]
    if any(not -1000 <= h <= 9000 for _, _, h in rows):
        raise ValueError(f"{path}: a height is not plausible")
    return spark.createDataFrame(rows, "col int, row int, h double"), header
