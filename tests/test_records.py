"""Each rule of the record contract on a record that breaks only that one."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from lodestream.sources import observations as S

BASE = {"schema": "observation.v1", "observation_id": "o1", "source_id": "s1", "provenance": {"adapter": "a", "adapter_version": "1", "contract": "observation.v1"}}
SIGNAL = {"t": "2026-01-02T03:04:05Z", "freq_hz": 4e8, "bandwidth_hz": 12500.0}
GOOD = {
    "bearing": BASE | SIGNAL | {"kind": "bearing", "sensor_lat": 50.0, "sensor_lon": 10.0, "bearing_deg": 0.0, "bearing_uncertainty": {"basis": "measured", "sigma_deg": 2.0}},
    "position": BASE | SIGNAL | {"kind": "position", "lat": 50.0, "lon": 10.0, "position_uncertainty": {"basis": "measured", "cov_en_m2": {"ee": 9.0, "en": 1.0, "nn": 4.0}}},
    "coverage": BASE | {"kind": "coverage", "t_start": "2026-01-02T03:04:05Z", "t_end": "2026-01-02T03:05:05Z", "band": {"min_hz": 1.0, "max_hz": 2.0}},
    "occupancy": BASE | {"kind": "occupancy", "t": "2026-01-02T03:04:05Z", "band": {"min_hz": 1.0, "max_hz": 2.0}, "noise_floor_dbm": -100.0},
}
ELLIPSE = {"semi_major_m": 20.0, "semi_minor_m": 10.0, "orientation_deg": 0.0, "confidence": 0.95}
BAD = [
    ("position", {"alt_m": 5.0}, "alt_uncertainty"),
    ("bearing", {"bearing_uncertainty": {"basis": "assumed", "sigma_deg": 2.0}}, "assumption"),
    ("bearing", {"bearing_deg": 360.0}, "bearing_deg"),
    ("bearing", {"bearing_deg": -1.0}, "bearing_deg"),
    ("bearing", {"bearing_uncertainty": None}, "bearing_uncertainty"),
    ("position", {"position_uncertainty": {"basis": "measured", "cov_en_m2": {"ee": 1.0, "en": 5.0, "nn": 1.0}}}, "not positive semi-definite"),
    ("coverage", {"dwell_s": 3.0, "revisit_s": 2.0}, "dwell_s is longer than revisit_s"),
    ("coverage", {"dwell_s": 3.0}, "revisit_s"),
    ("coverage", {"t_end": "2026-01-02T03:00:00Z"}, "t_end is before t_start"),
    ("coverage", {"bearing_deg": 3.0}, "bearing_deg"),
    ("bearing", {"elevation_deg": 91.0, "elevation_uncertainty": {"basis": "unreported"}}, "elevation_deg"),
    ("bearing", {"elevation_deg": 9.0}, "elevation_uncertainty"),
    ("position", {"position_uncertainty": {"basis": "measured", "ellipse": ELLIPSE | {"semi_minor_m": 30.0}}}, "semi_minor_m is larger than semi_major_m"),
    ("position", {"position_uncertainty": {"basis": "measured", "ellipse": {k: v for k, v in ELLIPSE.items() if k != "confidence"}}}, "confidence"),
    ("bearing", {"bearing_sigma_deg": 2.0}, "bearing_sigma_deg"),
    ("bearing", {"t": "2026-02-30T00:00:00Z"}, "/t"),
    ("bearing", {"t": "2026-01-02T03:04:05+02:00"}, "/t"),
    ("bearing", {"t": "2026-01-02T03:04:05"}, "/t"),
    ("bearing", {"bearing_uncertainty": {"basis": "measured"}}, "sigma_deg"),
    ("bearing", {"provenance": None}, "provenance"),
    ("bearing", {"lat": 5.0, "lon": 5.0}, "lat"),
    ("occupancy", {"band": {"min_hz": 3.0, "max_hz": 2.0}}, "min_hz is greater than max_hz"),
    ("position", {"position_uncertainty": {"basis": "measured", "ellipse": ELLIPSE, "cov_en_m2": {"ee": 9.0, "en": 1.0, "nn": 4.0}}}, "position_uncertainty"),
    ("position", {"position_uncertainty": {"basis": "unreported", "ellipse": ELLIPSE}}, "position_uncertainty"),
    ("position", {"position_uncertainty": None}, "position_uncertainty"),
    ("bearing", {"provenance": BASE["provenance"] | {"contract": "other"}}, "/provenance/contract"),
    ("bearing", {"source_claim": {"scheme": "guess", "category": "c"}}, "scheme"),
    ("bearing", {"provenance": BASE["provenance"] | {"conversions": [{"kind": "magic", "detail": "d"}]}}, "kind"),
    ("bearing", {"kind": "shape"}, "/kind"),
    ("bearing", {"transmission_state": "maybe"}, "transmission_state"),
    ("bearing", {"bearing_uncertainty": {"sigma_deg": 2.0}}, "basis"),
    ("bearing", {"bearing_uncertainty": {"basis": "unreported", "sigma_deg": 2.0}}, "bearing_uncertainty"),
    ("bearing", {"schema": "other"}, "/schema"),
    ("bearing", {"freq_hz": 0.0}, "freq_hz"),
]


@pytest.fixture(scope="module")
def judged(spark):
    texts = [json.dumps(r) for r in GOOD.values()]
    for kind, change, _ in BAD:
        r = copy.deepcopy(GOOD[kind]) | change
        texts.append(json.dumps({k: v for k, v in r.items() if v is not None}))
    texts += ['{"schema":', texts[0].replace("400000000.0", "NaN"), texts[0].replace("400000000.0", "1e999"), "[1, 2]"]
    rows = S.with_issues(spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)).select("n", "issues").collect()
    return [r["issues"] for r in sorted(rows)]


def test_good_records_have_no_issue(judged):
    assert judged[: len(GOOD)] == [[]] * len(GOOD)


def test_broken_rules_are_named(judged):
    for (kind, change, expect), issues in zip(BAD, judged[len(GOOD) :], strict=False):
        assert any(expect in i for i in issues), (kind, change, issues)
    for issues in (judged[-4], judged[-3], judged[-1]):
        assert issues == ["/ is not JSON of this contract"]
    assert judged[-2] == ["/freq_hz is not finite"]


def test_lines_are_numbered_and_untimed_ones_come_first(spark, tmp_path):
    lines = [json.dumps(GOOD["bearing"] | {"t": f"2026-01-02T03:04:0{s}Z"}) for s in (5, 3)] + [json.dumps(GOOD["coverage"]), "no json"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n\n")
    rows = S.delivery_order(S.read_numbered(spark, str(tmp_path / "a.jsonl"))).select("origin", F.size("issues").alias("n")).collect()
    assert [(r["origin"], r["n"]) for r in rows] == [("a.jsonl:3", 0), ("a.jsonl:4", 1), ("a.jsonl:2", 0), ("a.jsonl:1", 0)]


def test_dropped_files_are_judged_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(GOOD["bearing"]) + "\nno json\n")
    query = S.stream_jsonl(spark, str(tmp_path / "in")).select("text", F.size("issues").alias("n")).writeStream.format("memory").queryName("dropped").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("dropped").collect()) == [0, 1]
