"""Class libraries (YAML or JSON) and operator corrections (TOML): small files, judged on the driver, joined as broadcast tables."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Features on a decimal scale, and words that a label may not use.
LOG_SCALE = {"freq_hz", "bandwidth_hz", "duration_s", "period_s"}


FORBIDDEN = re.compile(r"\b(target\w*|strike\w*|engag\w*|kill\w*|likely|possible)\b", re.IGNORECASE)


def parse(text: str, name: str) -> dict:
    if name.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ModuleNotFoundError as missing:
        raise RuntimeError("reading a YAML library needs PyYAML") from missing
    return yaml.safe_load(text)


def issues(library: dict) -> list[str]:
    """What is wrong with a library, sorted: ids, parents, cycles, ranges, backgrounds."""
    found, classes = set(), library.get("classes", [])
    ids = [c.get("class_id") for c in classes]
    parents = {c.get("class_id"): c.get("parent") for c in classes}
    background = {b.get("feature") for b in library.get("background", [])}
    found.update(f"/classes class_id {i} repeats" for i in ids if ids.count(i) > 1)
    for place, c in enumerate(classes):
        at = f"/classes/{place}"
        if c.get("parent") is not None and c["parent"] not in parents:
            found.add(f"{at}/parent {c['parent']} is no class")
        if word := FORBIDDEN.search(str(c.get("label") or "")):
            found.add(f"{at}/label uses {word[0]}")
        seen, node = set(), c.get("class_id")
        while node is not None and node not in seen:
            seen.add(node)
            node = parents.get(node)
        if node is not None:
            found.add(f"{at}/parent is a cycle")
        for feature in c.get("ranges", []):
            name = feature.get("feature")
            if feature["min"] > feature["max"]:
                found.add(f"{at}/ranges {name} min is above max")
            if name in LOG_SCALE and feature["min"] <= 0:
                found.add(f"{at}/ranges {name} min is not above 0")
            if name not in background:
                found.add(f"{at}/ranges {name} has no background")
    return sorted(found)


@dataclass
class Tables:
    classes: DataFrame
    ranges: DataFrame
    background: DataFrame
    ancestors: DataFrame


def load(spark: SparkSession, path: str) -> Tables:
    """The library's tables; every class with its ancestors and their depth. A library with issues is refused."""
    library = parse(spark.read.text(path, wholetext=True).first()[0], path)
    if wrong := issues(library):
        raise ValueError("; ".join(wrong))
    classes = library.get("classes", [])
    parents = {c["class_id"]: c.get("parent") for c in classes}
    up = []
    for start in parents:
        node, depth = start, 0
        while node is not None:
            up.append((start, node, depth))
            node, depth = parents[node], depth + 1
    ranges = [(c["class_id"], r["feature"], float(r["min"]), float(r["max"]), float(r.get("weight", 1.0))) for c in classes for r in c.get("ranges", [])]
    background = [(b["feature"], float(b["min"]), float(b["max"])) for b in library.get("background", [])]
    return Tables(
        spark.createDataFrame([(c["class_id"], c.get("parent"), c.get("label")) for c in classes], "class_id string, parent string, label string"),
        spark.createDataFrame(ranges, "class_id string, feature string, min double, max double, weight double"),
        spark.createDataFrame(background, "feature string, min double, max double"),
        spark.createDataFrame(up, "class_id string, ancestor_id string, depth int"),
    )


class Corrections:
    """Operator corrections of runs; a file that cannot be read keeps the last good ones."""

    def __init__(self, path: str) -> None:
        self.path, self.stamp, self.rows, self.error = Path(path), None, [], None

    def refresh(self) -> bool:
        """Read the file again if it changed; whether it did."""
        stat = self.path.stat() if self.path.exists() else None
        stamp = stat and (stat.st_mtime_ns, stat.st_size)
        if stamp == self.stamp:
            return False
        self.stamp = stamp
        try:
            self.rows, self.error = self._rows(tomllib.loads(self.path.read_text()) if stat else {}), None
        except (tomllib.TOMLDecodeError, ValueError) as wrong:
            self.error = str(wrong)
        return True

    @staticmethod
    def _rows(data: dict) -> list[tuple]:
        rows = []
        for run, entry in data.get("runs", {}).items():
            for entity, c in entry.get("entities", {}).items():
                if unknown := set(c) - {"confirm", "reject", "affiliation", "note", "by"}:
                    raise ValueError(f"{run}/{entity}: {sorted(unknown)} is unknown")
                if not c.get("note"):
                    raise ValueError(f"{run}/{entity}: a correction needs a note")
                reject = c.get("reject", [])
                rows.append((run, entity, c.get("confirm"), [reject] if isinstance(reject, str) else list(reject), c.get("affiliation"), " ".join(c["note"].split())))
        return rows

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "run_id string, entity_id string, confirm string, reject array<string>, affiliation string, note string")
