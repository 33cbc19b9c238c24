"""Geodesics, fixes, grouping and filters against closed forms and invariants."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.functions import geo_np as G
from lodestream.operators import grouping, imm, locate, track
from lodestream.sources import maps, observations


@settings(deadline=None, max_examples=60)
@given(st.floats(-80, 80), st.floats(-180, 180), st.floats(0, 359.9), st.floats(1, 100_000))
def test_direct_and_inverse_agree(lat, lon, azimuth, distance):
    lat2, lon2 = G.direct(lat, lon, azimuth, distance)
    s, az = G.inverse(lat, lon, lat2, lon2)
    assert abs(s - distance) < 1e-3
    assert abs((az - azimuth + 180) % 360 - 180) * math.radians(1) * distance < 1e-2


def test_known_distance():
    s, _ = G.inverse(0.0, 0.0, 0.0, 1.0)  # a degree of the equator
    assert abs(s - 111319.4908) < 1e-3


@pytest.mark.parametrize(("lat", "lon"), [(0.1, 10.0), (50.0, 10.0), (70.0, 25.0), (-30.0, 179.99)])
def test_noise_free_bearings_cross_at_the_truth(lat, lon):
    sensors = [G.direct(lat, lon, a, 20_000.0) for a in (10.0, 130.0, 250.0)]
    s_lat, s_lon = (np.array([float(s[i]) for s in sensors]) for i in (0, 1))
    bearing = np.array([float(G.inverse(a, b, lat, lon)[1]) for a, b in zip(s_lat, s_lon, strict=True)])
    found = locate.fix(s_lat, s_lon, bearing, np.full(3, 2.0), np.array(["a", "b", "c"]), ["measured"] * 3)
    assert found["reason"] is None and float(G.inverse(lat, lon, found["lat"], found["lon"])[0]) < 1.0
    assert found["ee"] > 0 and found["nn"] > 0


def test_region_coverage():
    rng, inside, n = np.random.default_rng(1), 0, 300
    truth = (50.0, 10.0)
    sensors = [G.direct(*truth, a, 25_000.0) for a in (20.0, 100.0, 250.0)]
    lat, lon = (np.array([float(s[i]) for s in sensors]) for i in (0, 1))
    true = np.array([float(G.inverse(a, b, *truth)[1]) for a, b in zip(lat, lon, strict=True)])
    for _ in range(n):
        f = locate.fix(lat, lon, (true + rng.normal(0, 2, 3)) % 360, np.full(3, 2.0), np.array(list("abc")), ["measured"] * 3)
        e, north = G.to_en(f["lat"], f["lon"], *truth)
        d = np.array([e, north])
        inside += d @ np.linalg.solve([[f["ee"], f["en"]], [f["en"], f["nn"]]], d) <= 5.991
    assert 0.90 <= inside / n <= 0.985


def test_no_fix_has_a_reason():
    one = np.array([50.0, 50.0])
    assert locate.fix(one, one, one, one * 0 + 1, np.array(["a", "a"]), ["measured"] * 2)["reason"] == "too_few_sensors"
    east = np.array([10.0, 10.2])
    assert locate.fix(one, east, np.array([5.0, 6.0]), one * 0 + 1, np.array(["a", "b"]), ["measured"] * 2)["reason"] == "poor_geometry"
    assert locate.combine(["measured", "assumed"]) == "mixed" and locate.combine(["measured", "unreported"]) == "unreported"


def test_co_channel_split_finds_both_emitters():
    truths = [(50.0, 10.0), (50.1, 10.2)]
    sites = [(49.8, 9.8), (50.3, 9.9), (49.9, 10.5), (50.0, 10.6)]
    rows = [(s, float(G.inverse(*s, *t)[1]), f"s{i}") for i, s in enumerate(sites) for t in truths]
    lat, lon = (np.array([r[0][i] for r in rows]) for i in (0, 1))
    made = locate.locate(lat, lon, np.array([r[1] for r in rows]), np.full(len(rows), 0.2), np.array([r[2] for r in rows]), ["measured"] * len(rows))
    assert len(made) == 2
    assert max(min(float(G.inverse(f["lat"], f["lon"], *t)[0]) for f in made) for t in truths) < 50


def member(t, source, freq=4e8, ident=0):
    return (t, source, source, 0.0, freq, 5000.0, ident)


def test_grouping_closes_on_silence_and_on_the_next_cycle():
    groups, closed = grouping.step([], [member(0, "a"), member(0.3, "b"), member(1.0, "a")], 1.5)
    assert [len(g.members) for g in closed] == [2] and [len(g.members) for g in groups] == [1]
    assert grouping.step(groups, [], 3.1)[0] == []
    assert len(grouping.step([], [member(0, "a"), member(0, "b", 4.001e8)], 1.0)[0]) == 2


def test_filter_tells_a_mover_from_a_stayer():
    rng = np.random.default_rng(3)
    for speed in (0.0, 20.0):
        f = imm.Filter(np.zeros(2), np.eye(2) * 1e4)
        for i in range(1, 121):
            f = f.predicted(5.0)
            f.update(np.array([speed * 5 * i, 0.0]) + rng.normal(0, 100, 2), np.eye(2) * 1e4)
        assert (f.mu[0] > 0.6) == (speed == 0.0)
        assert abs(f.mu.sum() - 1) < 1e-9
    assert np.allclose(imm.switching(7.0).sum(1), 1) and np.allclose(imm.switching(3.0) @ imm.switching(4.0), imm.switching(7.0))


def test_tracks_keep_two_emitters_apart():
    state, out = track.State(), []
    rng = np.random.default_rng(5)
    for i in range(60):
        for which in (0, 1):
            e, n = rng.normal(0, 50, 2) + which * 5000
            state.take((i * 5.0 + which, i * 2 + which, e, n, 2500.0, 0.0, 2500.0, 4e8, 5000.0, ["a"]), {}, out)
    state.finish(304.0, out)
    into = {r["track"]: r["other"] for r in out if r["kind"] == "folded"}  # strays beside an anchor
    held = {(r["fix_id"] % 2, into.get(r["track"], r["track"])) for r in out if r["fix_id"] is not None and r["kind"] != "offset"}
    assert held == {(0, 1), (1, 2)} and state.c["number"].tolist() == [1, 2]


def record(**more):
    base = {"schema": "observation.v1", "kind": "bearing", "observation_id": "o", "source_id": "s", "t": "2026-01-01T00:00:00Z", "freq_hz": 4e8, "bandwidth_hz": 1e4, "bearing_deg": 0.0}
    base |= {"sensor_lat": 1.0, "sensor_lon": 2.0, "bearing_uncertainty": {"basis": "measured", "sigma_deg": 2.0}, "provenance": {"adapter": "a", "adapter_version": "1", "contract": "observation.v1"}}
    return json.dumps({k: v for k, v in (base | more).items() if v is not Ellipsis})


INVALID = [
    (record(bearing_deg=360.0), "bearing_deg"), (record(bearing_deg=-3.0), "bearing_deg"), (record(bearing_uncertainty=...), "bearing_uncertainty"), (record(freq_hz=0), "freq_hz"),
    (record(t="2026-02-30T00:00:00Z"), "/t"), (record(t="2026-01-01T00:00:00+02:00"), "/t"), (record(t="2026-01-01T00:00:00"), "/t"), (record(provenance=...), "provenance"), (record(kind="sound"), "/kind"),
    (record(schema="other"), "/schema"), (record(bearing_sigma=2), "bearing_sigma"), (record(lat=3.0), "lat"), (record(bearing_uncertainty={"basis": "measured"}), "sigma_deg"),
    (record(bearing_uncertainty={"basis": "unreported", "sigma_deg": 3}), "bearing_uncertainty"), ('{"freq_hz": NaN', "JSON"), ("not json", "JSON"),
]


def test_records_are_judged(spark):
    lines = spark.createDataFrame([(i, t) for i, (t, _) in enumerate([(record(), ""), *INVALID])], "i int, text string")
    issues = {r["i"]: r["issues"] for r in observations.with_issues(lines).select("i", "issues").collect()}
    assert issues[0] == []
    for i, (_, expect) in enumerate(INVALID, 1):
        assert any(expect in x for x in issues[i]), (INVALID[i - 1], issues[i])


def test_map_layers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 0], [1, 1]]}}]}))
    assert maps.read_roads(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "w.json").write_text(json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}))
    assert [r["is_hole"] for r in maps.read_water(spark, str(tmp_path / "w.json")).orderBy("ring").collect()] == [False] * 3 + [True] * 3
    (tmp_path / "t.asc").write_text("ncols 2\nnrows 2\ncellsize 1\nNODATA_value -9\n1 2\n-9 4\n")
    cells, header = maps.read_terrain(spark, str(tmp_path / "t.asc"))
    assert header["ncols"] == 2 and sorted(r["h"] for r in cells.collect()) == [1.0, 2.0, 4.0]
