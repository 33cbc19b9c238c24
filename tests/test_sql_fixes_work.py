"""The table function's work: grouping is done once, and groups that no assignment can solve cost no solution."""

import numpy as np

from lodestream.operators import locate
from lodestream.plans import catalog

SF = "/root/testdata/sf0.001"


def test_groups_are_made_once(spark):
    plan = lambda name: catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("cochannel_split_sql").count("FlatMapGroupsInPandas") == 0  # they are kept, for both uses of the view
    assert plan("cochannel_split").count("FlatMapGroupsInPandas") == 1


def test_nothing_is_solved_where_no_assignment_is_left(monkeypatch):
    solved = []
    whole = locate.fix_and_misses
    monkeypatch.setattr(locate, "fix_and_misses", lambda of, *rest: solved.append(len(of)) or whole(of, *rest))
    lat, lon = np.array([50.0, 50.0, 50.1, 50.1]), np.array([10.0, 10.0, 10.2, 10.2])
    made = locate.locate(lat, lon, np.array([10.0, 60.0, 200.0, 250.0]), np.ones(4), np.array(["a", "a", "b", "b"]), ["measured"] * 4)
    assert [f["reason"] for f in made] == ["ambiguous"] and not solved  # four bearings, two emitters: no degree of freedom
    one = locate.locate(lat[::2], lon[::2], np.array([60.0, 250.0]), np.ones(2), np.array(["a", "b"]), ["measured"] * 2)
    assert len(one) == 1 and solved == [2]
