"""A fix meets only the tracks that it may reach: the same rows as meeting all, with work that does not grow with the others."""

import math

import numpy as np
import pytest

from lodestream.operators import imm, track


def places(sites, seconds, seed):
    """Emitters far apart on one channel, some of which move, each heard every 20 s or so."""
    rng = np.random.default_rng(seed)
    out = []
    for s in range(sites):
        at, v = rng.uniform(0, 20_000, 2), rng.uniform(-20, 20, 2) * (s % 3 == 0)
        for t in np.arange(rng.uniform(0, 20), seconds, rng.uniform(10, 30)):
            e, n = at + v * max(t - 150, 0) + rng.normal(0, 50, 2)
            out.append((float(t), float(e), float(n), 2500.0, 0.0, 2500.0, 4e8 + 900.0 * (s % 5 == 0), 5000.0, ["B" if s % 5 == 0 else "A"]))
    return [(r[0], i, *r[1:]) for i, r in enumerate(sorted(out))]


def play(fixes):
    state, out = track.State(standard="A"), []
    for fix in fixes:
        state.take(fix, {}, out)
    state.finish(fixes[-1][0] + 4, out)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rows_are_those_of_meeting_all_tracks(seed, monkeypatch):
    fixes = places(25, 500, seed)
    got = play(fixes)
    monkeypatch.setattr(track, "WIDER", math.inf)
    assert got == play(fixes)
    assert {"fix", "created"} <= {r["kind"] for r in got} and any(r["anchor"] for r in got if r["kind"] == "fix")


def test_filters_that_a_fix_is_weighed_by_do_not_grow_with_the_tracks(monkeypatch):
    taken = []
    whole = imm.predicted
    monkeypatch.setattr(imm, "predicted", lambda mu, x, p, dt: taken.append(len(mu)) or whole(mu, x, p, dt))
    each = []
    for sites in (20, 80):
        taken.clear()
        fixes = places(sites, 240, 5)
        play(fixes)
        each.append(sum(taken) / len(fixes))
    assert each[1] < 2 * each[0] and each[1] < 20


def test_bounds_hold_the_filters():
    rng = np.random.default_rng(1)
    z, r = np.zeros((50, 2)), np.tile(np.eye(2) * 2500.0, (50, 1, 1))
    born = [imm.born(p, r[0]) for p in z]
    mu, x, p = (np.stack([b[i] for b in born]) for i in range(3))
    for _ in range(3):
        mu, x, p = imm.updated_many(*imm.predicted(mu, x, p, rng.uniform(1, 60, 50)), rng.normal(0, 400, (50, 2)), r)
    for dt in (4.0, 30.0, 200.0):
        middle, moment = imm.moments(mu, x, p, np.full(50, dt))
        for at in (dt, dt - 2, dt - imm.HORIZON_S):
            mean, cov = imm.combined(*imm.predicted(mu, x, p, np.full(50, at)))
            for k in (0, 1):
                assert (cov[:, k, k] + (mean[:, k] - middle[:, k]) ** 2 <= moment[:, k] * (1 + 1e-9)).all()


def test_medians_of_the_last_samples():
    rng = np.random.default_rng(2)
    samples, every = track.Samples(), []
    for value in rng.integers(0, 50, track.SAMPLES + 500).astype(float).tolist():
        samples.append(value)
        every.append(value)
        if len(every) % 301 == 0:
            assert samples.median() == np.median(every[-track.SAMPLES :])
    assert len(samples) == track.SAMPLES


def test_pairs_of_intervals():
    rng = np.random.default_rng(3)
    low = rng.integers(0, 40, 60).astype(float)
    high = low + rng.integers(0, 6, 60)
    a, b = track.overlapping(low, high)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if low[i] <= high[j] and low[j] <= high[i]}
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want
