"""Libraries, corrections and the change log."""

import json

import pytest

from lodestream.sources import library
from lodestream.streaming import picture

GOOD = {
    "classes": [{"class_id": "a"}, {"class_id": "a.b", "parent": "a", "ranges": [{"feature": "freq_hz", "min": 1e8, "max": 2e8}]}],
    "background": [{"feature": "freq_hz", "min": 1e6, "max": 1e9}],
}


def test_library(spark, tmp_path):
    (tmp_path / "lib.json").write_text(json.dumps(GOOD))
    tables = library.load(spark, str(tmp_path / "lib.json"))
    assert sorted(map(tuple, tables.ancestors.collect())) == [("a", "a", 0), ("a.b", "a", 1), ("a.b", "a.b", 0)]
    assert tables.ranges.count() == tables.background.count() == 1


@pytest.mark.parametrize(("change", "expect"), [
    ({"classes": [{"class_id": "a"}, {"class_id": "a"}]}, "repeats"),
    ({"classes": [{"class_id": "a", "parent": "z"}]}, "is no class"),
    ({"classes": [{"class_id": "a", "parent": "b"}, {"class_id": "b", "parent": "a"}]}, "cycle"),
    ({"classes": [{"class_id": "a", "ranges": [{"feature": "freq_hz", "min": 3, "max": 2}]}]}, "above max"),
    ({"classes": [{"class_id": "a", "ranges": [{"feature": "freq_hz", "min": 0, "max": 2}]}]}, "above 0"),
    ({"background": []}, "no background"),
])
def test_library_issues(change, expect):
    assert library.issues(GOOD) == []
    assert any(expect in x for x in library.issues(GOOD | change))


def test_corrections_keep_the_last_good_file(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[runs."r".entities."E-1"]\nreject = "a.b"\nnote = "seen  by\\n eye"\n')
    c = library.Corrections(str(path))
    assert c.refresh() and not c.refresh()
    assert c.rows == [("r", "E-1", None, ["a.b"], None, "seen by eye")]
    path.write_text('[runs."r".entities."E-1"]\nreject = "a.b"\n')
    assert c.refresh() and "note" in c.error and len(c.rows) == 1


def test_change_log(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key long, value string")
    states = [frame([]), frame([(1, "a"), (2, "b")]), frame([(1, "a"), (3, "c")]), frame([(1, "z"), (3, "c")])]
    log, seq = None, 0
    for before, after in zip(states, states[1:], strict=False):
        delta = picture.numbered(picture.changes(before, after, "key", "value"), seq)
        seq += delta.count()
        log = delta if log is None else log.unionByName(delta)
    assert sorted(r["seq"] for r in log.collect()) == list(range(1, seq + 1)) and seq == 5
    assert {(r["key"], r["value"]) for r in picture.snapshot(log).collect()} == {(1, "z"), (3, "c")}
    assert picture.resume(log, 3)[0] == "deltas" and picture.resume(log.where("seq > 3"), 1)[0] == "snapshot"
