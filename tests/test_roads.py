"""Kernels of the road feature against numeric integration, and rings to the nearest road."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestream.functions import geo_sql as G
from lodestream.operators import maps


def test_kernels_are_numeric_integrals(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(40):
        a = rng.uniform(0, 2 * math.pi)
        rows.append((rng.uniform(-900, 900), rng.uniform(-900, 900), rng.uniform(-900, 900), rng.uniform(-900, 900), math.cos(a), math.sin(a), rng.uniform(10, 2500)))
    names = ["px", "py", "ax", "ay", "ux", "uy", "length"]
    c = [F.col(x) for x in names]
    ee, en, nn, radius = 40_000.0, 9_000.0, 25_000.0, 800.0
    got = spark.createDataFrame(rows, ", ".join(f"{x} double" for x in names)).coalesce(1).select(
        G.length_in_disc(c[0], c[1], F.lit(radius), *c[2:]).alias("inside"), G.gaussian_line_integral(c[0], c[1], F.lit(ee), F.lit(en), F.lit(nn), *c[2:]).alias("integral")
    ).collect()
    inverse, det = np.linalg.inv([[ee, en], [en, nn]]), ee * nn - en * en
    for (px, py, ax, ay, ux, uy, length), r in zip(rows, got, strict=True):
        t = (np.arange(200_000) + 0.5) / 200_000 * length
        d = np.stack([px - ax - t * ux, py - ay - t * uy])
        step = length / 200_000
        assert abs(r["inside"] - (np.hypot(*d) <= radius).sum() * step) < 0.1
        density = np.exp(-0.5 * np.einsum("it,ij,jt->t", d, inverse, d)) / (2 * math.pi * math.sqrt(det))
        assert abs(r["integral"] - density.sum() * step) <= 1e-6 * max(r["integral"], 1e-9)


def test_rings_grow_to_the_nearest_road(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 4000.0, 0.0), (3, 60_000.0, 0.0), (4, -9e6, 4e6)], "p int, x double, y double")
    segments = spark.createDataFrame([(7, -10.0, 5.0, 10.0, 5.0), (8, 0.0, -300.0, 900.0, -300.0)], "id int, ax double, ay double, bx double, by double")
    got = {r["p"]: (r["segment"], round(r["distance"], 3)) for r in maps.nearest_segment(points, segments, "p", 100.0).collect()}
    assert got[1] == (7, 5.0) and got[2] == (8, round(math.hypot(3100, 300), 3))
    assert got[3] == (8, round(math.hypot(59_100, 300), 3)) and got[4] == (7, round(math.hypot(9e6 - 10, 4e6 - 5), 3))  # however far
    assert maps.nearest_segment(points, segments.limit(0), "p", 100.0).count() == 0 and maps.nearest_segment(points.limit(0), segments, "p", 100.0).count() == 0


def test_a_point_in_a_hole_is_outside(spark):
    ring = lambda *p: [(*a, *b) for a, b in zip(p, p[1:] + p[:1], strict=True)]
    edges = spark.createDataFrame(ring((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)) + ring((3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)), "x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1.0, 1.0), (4.0, 4.0), (7.0, 4.0), (20.0, 4.0), (1.0, 1.0)], "x double, y double")
    assert sorted((r["x"], r["inside"]) for r in maps.inside_polygons(points, edges, 2.0).collect()) == [(1.0, True), (1.0, True), (4.0, False), (7.0, True), (20.0, False)]
