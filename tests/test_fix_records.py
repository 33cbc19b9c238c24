"""Whole fix records against sums over one group at a time, and whether regions and heights hold the truth as often as they claim."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import geo_np as G
from lodestream.operators import locate

MEMBERS = "group_id long, sensor string, lat double, lon double, bearing_deg double, sigma_deg double, basis string, observation_id long, t double, freq_hz double, bandwidth_hz double, sensor_alt_m double, elevation_deg double, elevation_sigma_deg double, elevation_basis string"


def groups(n, seed):
    rng, rows, number = np.random.default_rng(seed), [], 0
    for g in range(n):
        lat, lon, alt = 50 + rng.uniform(-0.05, 0.05), 10 + rng.uniform(-0.05, 0.05), rng.uniform(500, 2000)
        for s in range(int(rng.integers(2, 5))):
            turn = 2 * math.pi * s / 5 + rng.uniform(0, 0.5)
            la, lo = (float(x) for x in G.direct(lat, lon, math.degrees(turn), rng.uniform(8000, 25_000)))
            away, azimuth = (float(x) for x in G.inverse(la, lo, lat, lon))
            up = math.degrees(math.atan2(alt - 300 - away**2 / 1.28e7, away))
            sigma = None if rng.random() < 0.2 else float(rng.uniform(0.5, 2))
            stated = rng.choice([None, "measured", "assumed", "unreported"], p=[0.3, 0.4, 0.2, 0.1])
            rows.append((g, "abcd"[s], la, lo, (azimuth + rng.normal(0, sigma or 1)) % 360, sigma, "unreported" if sigma is None else str(rng.choice(["measured", "assumed"])), number, 100.0 * g + s, 4e8 + 10.0 * s, 5e3 + s, 300.0 if rng.random() < 0.9 else None, up if stated else None, 0.3 if stated in ("measured", "assumed") else None, None if stated is None else str(stated)))
            number += 1
    return rows


def check(fix, own):
    """One group's record by its sums."""
    used = [r for r in own if r[5] is not None]
    weighted = len({r[1] for r in used}) >= 2
    used = used if weighted else own
    assert fix["t"] == max(r[8] for r in own) and fix["bandwidth_hz"] == max(r[10] for r in own) and fix["freq_hz"] == pytest.approx(sum(r[9] for r in own) / len(own))
    la, lo = (np.array([r[i] for r in used]) for i in (2, 3))
    ground, azimuth = G.inverse(la, lo, np.full(len(used), fix["lat"]), np.full(len(used), fix["lon"]))
    share = {b["observation_id"]: b for b in fix["bearings"]}
    assert set(share) == {r[7] for r in own} and sum(b["share"] for b in share.values()) == pytest.approx(1)
    want = np.array([1 / (d * math.radians(r[5])) ** 2 if weighted else 1.0 for d, r in zip(ground, used, strict=True)])
    for w, r in zip(want / want.sum(), used, strict=True):
        assert share[r[7]]["share"] == pytest.approx(w, rel=0.02) and share[r[7]]["excluded"] is None and share[r[7]]["sensor"] == r[1]
    assert all(share[r[7]]["share"] == 0 and share[r[7]]["excluded"] for r in own if r not in used) and fix["n_excluded"] == len(own) - len(used)
    ups = [(r, d, a) for r, d, a in zip(used, ground.tolist(), azimuth.tolist(), strict=True) if r[14] and r[11] is not None and abs(r[12]) <= 85 and d >= 50]
    if not ups:
        assert fix["height_m"] is None and fix["height_basis"] is None and fix["n_heights"] == 0
        return 0
    tall = [r[11] + d * math.tan(math.radians(r[12])) + d * d / (2 * float(G.earth_radius(r[2], a))) for r, d, a in ups]
    known = [i for i, (r, _, _) in enumerate(ups) if r[13] is not None]
    if not known:
        assert fix["height_m"] == pytest.approx(sum(tall) / len(tall)) and fix["height_sigma_m"] is None and fix["height_basis"] == "unreported" and fix["n_heights"] == len(tall)
        return 1
    w = [1 / (ups[i][1] / math.cos(math.radians(ups[i][0][12])) ** 2 * math.radians(ups[i][0][13])) ** 2 for i in known]
    assert fix["height_m"] == pytest.approx(sum(x * tall[i] for x, i in zip(w, known, strict=True)) / sum(w)) and fix["n_heights"] == len(known)
    if fix["ee"] is None:
        assert fix["height_sigma_m"] is None and fix["height_basis"] == "unreported"
        return 1
    spread = 0.0
    for x, i in zip(w, known, strict=True):
        r, d, a = ups[i]
        e, n = math.sin(math.radians(a)), math.cos(math.radians(a))
        spread += x * abs(math.tan(math.radians(r[12])) + d / float(G.earth_radius(r[2], a))) * math.sqrt(e * e * fix["ee"] + 2 * e * n * fix["en"] + n * n * fix["nn"])
    assert fix["height_sigma_m"] == pytest.approx(math.sqrt(1 / sum(w) + (spread / sum(w)) ** 2))
    assert fix["height_basis"] == locate.combine([*(ups[i][0][14] for i in known), fix["basis"]])
    return 1


def test_records_by_their_sums(spark):
    rows = groups(150, 1)
    made = {r["group_id"]: r for r in locate.fixes(spark.createDataFrame(rows, MEMBERS)).collect()}
    assert len(made) == 150
    solved = tall = 0
    for g, fix in made.items():
        own = [r for r in rows if r[0] == g]
        assert fix["n_bearings"] == len(own)
        if fix["reason"] is None:
            solved += 1
            tall += check(fix, own)
        else:
            assert fix["bearings"] == [] and fix["t"] is None and fix["height_m"] is None
    assert solved > 120 and tall > 60


def test_members_without_the_optional_columns(spark):
    rows = groups(20, 2)
    full = spark.createDataFrame(rows, MEMBERS)
    plain = full.drop(*locate.OPTIONAL)
    both = [{r["group_id"]: (r["lat"], r["ee"], r["reason"]) for r in locate.fixes(m).collect()} for m in (full, plain)]
    assert both[0] == both[1] and locate.fixes(plain).where("t IS NOT NULL OR height_m IS NOT NULL").count() == 0
    assert locate.fixes(full.where(F.lit(False))).count() == 0


def trials(n, seed, sigma=1.5):
    """Three sensors, an emitter above the ground; solved all at once."""
    rng = np.random.default_rng(seed)
    alt = rng.uniform(1250, 3000, n)
    lat, lon = 50 + rng.uniform(-0.06, 0.06, n), -105 + rng.uniform(-0.09, 0.09, n)
    of = np.repeat(np.arange(n), 3)
    turn = np.tile([220.0, 120.0, 5.0], n)
    la, lo = G.direct(np.full(3 * n, 50.0), np.full(3 * n, -105.0), turn, np.tile([19_000.0, 17_000.0, 18_000.0], n))
    away, azimuth = G.inverse(la, lo, lat[of], lon[of])
    radius = G.earth_radius(la, azimuth)
    up = np.degrees(np.arctan2(alt[of] - 1200 - away**2 / (2 * radius), away))
    b = (azimuth + rng.normal(0, sigma, 3 * n)) % 360
    found, share = locate.fix_many(of, la, lo, b, np.full(3 * n, sigma), np.tile([0, 1, 2], n), np.full(3 * n, "measured", object), n)
    tall = locate.heights(of, la, lo, np.full(3 * n, 1200.0), up + rng.normal(0, 0.5, 3 * n), np.full(3 * n, 0.5), np.full(3 * n, "measured", object), found)
    return lat, lon, alt, found, tall, share


def test_regions_hold_the_truth_as_often_as_they_claim():
    lat, lon, _, found, _, share = trials(1800, 5)
    away, azimuth = G.inverse(found["lat"], found["lon"], lat, lon)
    e, n = away * np.sin(np.radians(azimuth)), away * np.cos(np.radians(azimuth))
    d2 = (found["nn"] * e * e - 2 * found["en"] * e * n + found["ee"] * n * n) / (found["ee"] * found["nn"] - found["en"] ** 2)
    assert 0.93 <= np.mean(d2 <= -2 * math.log(0.05)) <= 0.965 and 0.36 <= np.mean(d2 <= 1.0) <= 0.43
    assert np.allclose(np.bincount(np.repeat(np.arange(1800), 3), share), 1)


def test_heights_hold_the_truth_as_often_as_they_claim():
    _, _, alt, _, tall, _ = trials(900, 6)
    z = (tall["height_m"] - alt) / tall["height_sigma_m"]
    assert 0.62 <= np.mean(np.abs(z) <= 1) <= 0.80 and abs(z.mean()) < 0.15
