"""Re-identification's memory against choosing one by one over everything, and the SQL functions against the DataFrame forms."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions import geo_np, sql_surface
from lodestream.operators import memory
from lodestream.plans import catalog

SF = "/root/testdata/sf0.001"
DEFAULT = {"a": 0.3, "background": 0.7}


def brute(entities, pairs, most=500):
    """Every entity in order looks over all that are remembered by then."""
    used, first, out = set(), {}, []
    for channel, i, start, _, _ in sorted(entities, key=lambda x: (x[2], x[1])):
        held = sorted((e for e in entities if e[0] == channel and e[3] < start and e[1] != i), key=lambda e: -e[3])
        held = [e for e in held if e[3] >= start - memory.MEMORY_S and e[1] not in used]
        ids = {e[1]: e for e in held[:most]}
        odds = {o: (x, n) for c, j, o, x, n in pairs if c == channel and j == i and o in ids}
        total = 1 + sum(x for x, _ in odds.values())
        best = sorted(odds, key=lambda o: (-round(odds[o][0] / total, 9), o))
        found, p = None, None
        if best:
            p = odds[best[0]][0] / total
            rest = odds[best[1]][0] / total if len(best) > 1 else 0
            if odds[best[0]][1] >= 4 and p >= 0.5 and p - rest >= 0.15:
                found = best[0]
                used.add(found)
        first[i] = first[found] if found is not None else i
        old = ids[found][4] if found is not None else None
        prior = {k: p * old.get(k, 0) + (1 - p) * v for k, v in DEFAULT.items()} if old else DEFAULT
        out.append((channel, i, found, None if p is None else round(p, 9), len(odds), first[i], {k: round(v, 9) for k, v in prior.items()}))
    return sorted(map(repr, out))


def test_memory_against_brute_force(spark):
    rng = random.Random(3)
    entities, pairs = [], []
    for channel in (1, 2, 3):
        t = 0.0
        for k in range(60):
            t += rng.choice([50.0, 900.0, 4000.0, 30_000.0])
            entities.append((channel, channel * 1000 + k, t, t + rng.uniform(0, 3000), {"a": rng.random(), "background": 0.2} if rng.random() < 0.7 else None))
        for _, i, start, _, _ in [e for e in entities if e[0] == channel]:
            for _, o, _, end, _ in [e for e in entities if e[0] == channel]:
                if end < start and start - end <= memory.MEMORY_S and rng.random() < 0.6:
                    pairs.append((channel, i, o, rng.choice([0.1, 1.0, 8.0, 33.0, 40.0]), rng.choice([3, 4, 4, 5])))
    df = spark.createDataFrame(entities, "channel long, id long, start_s double, end_s double, posterior map<string,double>")
    two = spark.createDataFrame(pairs, "channel long, id long, old long, odds double, shared int")
    made = memory.reidentify(df, two, DEFAULT).collect()
    got = sorted(repr((r["channel"], r["id"], r["consistent_with"], None if r["p"] is None else round(r["p"], 9), r["candidates"], r["first"], {k: round(r["prior"][k], 9) for k in DEFAULT})) for r in made)
    assert got == brute(entities, pairs)
    assert {r["note"] for r in made} == {"no candidate", "too few features", "unlikely", "ambiguous", "published"}
    taken = [r["consistent_with"] for r in made if r["consistent_with"] is not None]
    assert len(taken) == len(set(taken)) > 10 and any(r["first"] not in (r["id"], r["consistent_with"]) for r in made)
    assert memory.reidentify(df.limit(0), two, DEFAULT).count() == 0


def test_the_oldest_are_forgotten(monkeypatch):
    monkeypatch.setattr(memory, "MOST", 2)
    new = [(float(10 * k), 10.0 * k + 1, k, None) for k in range(6)]
    made = memory.choose(new, {5: [(k, 50.0 if k == 1 else 0.1, 4) for k in range(5)], 3: [(1, 50.0, 4)]}, DEFAULT)
    assert made[3][1] == 1 and made[5][1] is None and made[5][4] == 2  # one is used up, then the two latest are left


def test_memory_query_uses_each_memory_once(spark):
    rows = catalog.queries()["reid_memory"](spark, SF)
    assert rows.count() == rows.select("id").distinct().count() > 0
    assert rows.where("consistent_with IS NOT NULL").groupBy("consistent_with").count().where("count > 1").count() == 0


def test_sql_functions(spark):
    sql_surface.register(spark)
    row = spark.sql("SELECT geodesic_distance_m(50.0D, 10.0D, 50.1D, 10.25D) AS d, geodesic_azimuth_deg(50.0D, 10.0D, 50.1D, 10.25D) AS a, destination(50.0D, 10.0D, 45.0D, 1000.0D) AS p, local_en(50.0D, 10.0D, 50.1D, 10.25D) AS en, earth_radius_m(50.0D, 30.0D) AS r, wrap_bearing_deg(-10) AS w, angle_difference_deg(10, 350) AS x, mahalanobis2(20, 30, 900, 100, 400) AS m, chi2_2dof(0.95) AS c, height_from_elevation(100, 500, 10, 6371000) AS h, same_channel(4e8, 5e3, 4e8 + 2400, 5e3) AS s").first()
    d, a = geo_np.inverse(50.0, 10.0, 50.1, 10.25)
    assert row["d"] == pytest.approx(float(d)) and row["a"] == pytest.approx(float(a)) and row["w"] == 350 and row["x"] == 20 and row["s"]
    assert (row["p"]["lat"], row["p"]["lon"]) == pytest.approx(tuple(map(float, geo_np.direct(50.0, 10.0, 45.0, 1000.0))))
    assert (row["en"]["e"], row["en"]["n"]) == pytest.approx(tuple(map(float, geo_np.to_en(50.0, 10.0, 50.1, 10.25))))
    assert row["r"] == pytest.approx(float(geo_np.earth_radius(50.0, 30.0))) and row["m"] == pytest.approx((400 * 400 - 2 * 100 * 600 + 900 * 900) / (900 * 400 - 100 * 100)) and row["c"] == pytest.approx(5.99146, abs=1e-5)
    assert row["h"] == pytest.approx(100 + 500 * 0.17632698 + 250000 / (2 * 6371000))


def test_fixes_in_sql_are_those_of_the_operator(spark):
    columns = ["group_id", "emitter", "reason", "basis", "lat", "lon", "ee", "en", "nn", "residual_deg", "crossing_deg", "n_bearings", "n_excluded"]
    clean = lambda df: sorted(repr(tuple(f"{v:.8g}" if isinstance(v, float) else v for v in r)) for r in df.select(columns).collect())
    solved = F.col("reason").isNull()
    a, b = catalog.queries()["cochannel_split_sql"](spark, SF), catalog.queries()["cochannel_split"](spark, SF)
    assert clean(a.where(solved)) == clean(b.where(solved)) and a.where(solved & (F.col("range_m") > 0)).count() > 0
    assert sorted(map(repr, a.groupBy("reason").count().collect())) == sorted(map(repr, b.groupBy("reason").count().collect()))
