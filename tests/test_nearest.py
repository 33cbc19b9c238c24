"""The nearest track in a gate against brute force, at densities where the first, the second and only the last share of the gate decides."""

import numpy as np
import pytest

from lodestream.operators import matching
from lodestream.plans import catalog

GATE, EE, NN = 13.8, 250_000.0, 1_000_000.0


def brute(a, b, allowed=None):
    out = {}
    for k in range(len(a["x"])):
        de, dn = b["x"] - a["x"][k], b["y"] - a["y"][k]
        d2 = de**2 / EE + dn**2 / NN
        ok = (np.abs(a["freq"][k] - b["freq"]) <= np.fmax(2500.0, (a["bw"][k] + b["bw"]) / 4)) & (d2 <= GATE)
        ok &= allowed(b["id"], de, dn) if allowed else True
        if ok.any():
            d, t, j = min((d2[j], b["id"][j], j) for j in np.flatnonzero(ok))
            out[k] = (int(t), d)
    return out


def scene(fixes, tracks, seed):
    rng = np.random.default_rng(seed)
    make = lambda n: {"id": rng.permutation(n), "freq": 4e8 + rng.integers(0, 6, n) * 12500.0, "bw": rng.choice([12500.0, 50_000.0, np.nan], n), "x": rng.integers(-9000, 9000, n).astype(float), "y": rng.integers(-9000, 9000, n).astype(float)}
    return make(fixes), make(tracks)


@pytest.mark.parametrize("tracks", [1, 40, 700, 6000])
@pytest.mark.parametrize("pairs", [5, 1 << 17])
def test_against_brute_force(tracks, pairs, monkeypatch):
    monkeypatch.setattr(matching, "PAIRS", pairs)
    a, b = scene(60, tracks, tracks)
    b["x"][: tracks // 2], b["y"][: tracks // 2] = np.round(b["x"][: tracks // 2], -3), np.round(b["y"][: tracks // 2], -3)  # equal distances
    for allowed in (None, lambda track, de, dn: (track % 3 != 0) | ((de + 40) ** 2 + (dn - 25) ** 2 <= 900.0**2)):
        f, j, d2 = matching.nearest_of(a, b, GATE, EE, NN, allowed)
        assert {int(k): (int(b["id"][x]), d) for k, x, d in zip(f, j, d2, strict=True)} == brute(a, b, allowed) and len(set(f.tolist())) == len(f)


def test_pairs_that_are_met_do_not_grow_with_the_tracks(monkeypatch):
    met = []
    for tracks in (5000, 40_000):
        a, b = scene(300, tracks, 1)
        b["freq"][:] = a["freq"][:] = 4e8
        seen = []
        matching.nearest_of(a, b, GATE, EE, NN, lambda track, de, dn, seen=seen: seen.append(len(track)) or np.ones(len(track), bool))
        met.append(sum(seen) / 300)
    assert met[1] < 100 and met[1] < 0.05 * 40_000  # the gate holds some 16 % of the tracks


def test_repeated_ids_and_missing_places(spark):
    o = spark.createDataFrame([(1, 4e8, 12500.0, 0.0, 0.0), (1, 4e8, 12500.0, 900.0, 0.0), (2, 4e8, 12500.0, None, 0.0), (None, 4e8, None, 10.0, 0.0)], "observation_id long, a_freq double, a_bw double, fe double, fn double")
    t = spark.createDataFrame([(7, 4e8, 12500.0, 100.0, 0.0), (8, 4e8, None, 895.0, 0.0), (9, 4e8, 12500.0, None, 1.0)], "track long, b_freq double, b_bw double, e double, n double")
    got = sorted(map(tuple, matching.nearest_in_gate(o, t, 30_000.0, GATE, EE, NN).collect()), key=str)
    assert got == [(1, 8, 25.0 / EE), (None, 7, 8100.0 / EE)]


@pytest.mark.parametrize("name", ["nearest_compatible", "region_less_match"])
def test_no_pairs_are_joined(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join Inner" not in plan
