"""Re-identification without a table of pairs: each row's pairs come at once, and none is shuffled or sorted."""

import random

import numpy as np
import pytest

from lodestream.operators import matching, memory
from lodestream.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [1, 7, 1 << 17])
def test_pairs_before_against_brute_force(spark, most, monkeypatch):
    rng = random.Random(most)
    left = [(rng.choice([1.0, 2.0, None]), k, rng.randrange(0, 500) if k % 9 else None) for k in range(120)]
    right = [(rng.choice([1.0, 2.0]), 1000 + k, rng.randrange(0, 500)) for k in range(150)]
    a, b = spark.createDataFrame(left, "f double, id long, t long"), spark.createDataFrame(right, "f double, old long, u long")
    step = lambda a, b, i, j: {"id": a["id"][i], "old": b["old"][j], "n": np.bincount(i)[i], "fits": np.full(len(i), len(i) <= most or len(np.unique(i)) == 1)}
    monkeypatch.setattr(matching, "PAIRS", most)
    got = [tuple(r) for r in matching.before_map(a, b, ["f"], "t", "u", 40, step, "id long, old long, n long, fits boolean").collect()]
    pairs = [(x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] is not None and 0 < x[2] - y[2] <= 40]
    assert sorted((i, o) for i, o, _, _ in got) == sorted(pairs) and len(pairs) > 300
    assert all(fits and n == sum(i == p for p, _ in pairs) for i, _, n, fits in got)


@pytest.mark.parametrize("name", ["reid_candidates", "reid_normalise", "reid_published", "reid_memory"])
def test_no_pairs_are_shuffled(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "end_us" in plan and "collect_list" not in plan
    if name != "reid_memory":  # which joins sessions with their runs
        assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_published_are_the_best_of_the_normalised(spark):
    every = catalog.queries()["reid_normalise"](spark, "/root/testdata/sf0.01").collect()
    ranked = {}
    for r in every:
        ranked.setdefault((r["entity"], r["session"]), []).append((-r["p"], r["old"], r["old_session"]))
    best = {k: sorted(v) for k, v in ranked.items()}
    want = {(*k, v[0][1], v[0][2]) for k, v in best.items() if -v[0][0] >= 0.5 and -v[0][0] - (-v[1][0] if len(v) > 1 else 0) >= 0.15}
    got = catalog.queries()["reid_published"](spark, "/root/testdata/sf0.01")
    assert {tuple(r)[:4] for r in got.select("entity", "session", "old", "old_session").collect()} == want and len(want) > 10
    assert got.count() == len(want)


def test_weighed_pairs_are_those_of_a_table(spark):
    """Odds made of what is remembered give the rows of a table of all pairs."""
    rng = random.Random(8)
    entities = []
    for channel in (1, 2):
        t = 0.0
        for k in range(80):
            t += rng.choice([40.0, 800.0, 5000.0, 30_000.0])
            entities.append((channel, channel * 1000 + k, t, t + rng.uniform(0, 3000), {"a": rng.random(), "background": 0.2}, rng.choice([0.5, 2.0, 7.0])))
    df = spark.createDataFrame(entities, "channel long, id long, start_s double, end_s double, posterior map<string,double>, x double")
    odds = lambda a, b: 30.0 / (1 + abs(a - b) * 9)
    pairs = [(c, i, o, odds(x, y), 4 if x < 6 else 3) for c, i, s, _, _, x in entities for d, o, _, e, _, y in entities if c == d and e < s and s - e <= memory.MEMORY_S]
    two = spark.createDataFrame(pairs, "channel long, id long, old long, odds double, shared int")

    def weigh(c, i, j):
        gap = c["start_s"][i] - c["end_s"][j]
        return 30.0 / (1 + np.abs(c["x"][i] - c["x"][j]) * 9), np.full(len(j), 4 if c["x"][i] < 6 else 3), (gap > 0) & (gap <= memory.MEMORY_S)

    default = {"a": 0.3, "background": 0.7}
    rows = lambda d: sorted(repr((r["id"], r["consistent_with"], r["note"], r["candidates"], r["first"], None if r["p"] is None else round(r["p"], 9), {k: round(v, 9) for k, v in r["prior"].items()})) for r in d.collect())
    made = memory.reidentify_by(df, weigh, ["start_s", "end_s", "x"], default)
    assert rows(made) == rows(memory.reidentify(df, two, default))
    assert {"published", "no candidate"} <= {r["note"] for r in made.collect()}
