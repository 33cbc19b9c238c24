"""Snapshot grouping of bearings: a keyed session window with an extra close rule.

``step`` is the whole operator; the batch form runs it over a channel island in an
``applyInPandas`` and the streaming form in a stateful processor, so both give the
same groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.runs import cut, spread

WINDOW_S, TOLERANCE_HZ, SIMULTANEOUS_S = 2.0, 2500.0, 0.5
STEP_S = 1.0
SCHEMA = "island long, group_id long, last_t double, freq_hz double, bandwidth_hz double, observation_id long"


@dataclass
class Open:
    """An open group: its members (t, source, sensor, bearing, freq, bandwidth, id), and what they add up to."""

    number: int
    members: list[tuple] = field(default_factory=list)
    last_t: float = -math.inf
    total: float = 0.0
    bandwidth: float = 0.0
    heard: dict[tuple, tuple[float, float]] = field(default_factory=dict)

    @property
    def freq(self) -> float:
        return self.total / len(self.members)

    def add(self, m: tuple) -> None:
        self.members.append(m)
        self.last_t, self.total, self.bandwidth = max(self.last_t, m[0]), self.total + m[4], max(self.bandwidth, m[5])
        low, high = self.heard.get(m[1:3], (m[0], m[0]))
        self.heard[m[1:3]] = (min(low, m[0]), max(high, m[0]))

    def takes(self, m: tuple, window_s: float = WINDOW_S) -> bool:
        return m[0] - self.last_t <= window_s and abs(m[4] - self.freq) <= max(TOLERANCE_HZ, (m[5] + self.bandwidth) / 4)

    def seen(self, m: tuple) -> bool:
        """Whether this sensor already has a member at another time: the next cycle."""
        low, high = self.heard.get(m[1:3], (m[0], m[0]))
        return max(m[0] - low, high - m[0]) > SIMULTANEOUS_S


def step(open_groups: list[Open], rows: list[tuple], now: float | None, window_s: float = WINDOW_S) -> tuple[list[Open], list[Open]]:
    """Groups that stay open, and those that closed, by last time and frequency."""
    groups, closed = list(open_groups), []
    for m in sorted(rows, key=lambda m: (m[0], m[1], m[6])):
        found = next((g for g in groups if g.takes(m, window_s)), None)
        if found is not None and found.seen(m):
            groups.remove(found)
            closed.append(found)
            found = None
        if found is None:
            found = Open(max((g.number for g in groups), default=0) + 1)
            groups.append(found)
        found.add(m)
    if now is not None:
        late = [g for g in groups if now - g.last_t > window_s]
        groups = [g for g in groups if now - g.last_t <= window_s]
        closed += late
    return groups, sorted(closed, key=lambda g: (g.last_t, g.freq))


def by_steps(rows: list[tuple], clock: float, step_s: float = STEP_S) -> Iterator[tuple[float, list[tuple]]]:
    """The ends of the time steps that have rows (in order), each with its rows, and the last step that ends by ``clock``."""
    at = 0
    while at < len(rows):
        now = math.floor(rows[at][0] / step_s) * step_s + step_s
        end = at
        while end < len(rows) and rows[end][0] < now:
            end += 1
        yield now, rows[at:end]
        at = end
    if math.isfinite(clock):
        yield math.floor(clock / step_s) * step_s, []


def islands(bearings: DataFrame, gap_hz: float) -> DataFrame:
    """Channel islands: frequencies cut where neighbours are further apart than any tolerance."""
    return cut(bearings, "freq_hz", gap_hz, "island")


def group_snapshots(bearings: DataFrame, step_s: float = STEP_S, gap_hz: float = 12_000.0, window_s: float = WINDOW_S) -> DataFrame:
    """One row per member of each closed group. ``bearings``: t, source_id, sensor_id, bearing_deg, freq_hz, bandwidth_hz, observation_id.

    An island is cut where it is silent for longer than any group lasts, so a task has a
    bounded run of it; groups are numbered over the island's runs by the time of the run.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "source_id", "observation_id"])
        rows = list(pdf[["t", "source_id", "sensor_id", "bearing_deg", "freq_hz", "bandwidth_hz", "observation_id"]].itertuples(index=False, name=None))
        groups, out = [], []
        for now, some in by_steps(rows, math.inf, step_s):
            groups, closed = step(groups, some, now, window_s)
            out += closed
        out += step(groups, [], float("inf"), window_s)[1]
        island, first = int(pdf["island"].iloc[0]), int(pdf["__before"].iloc[0])
        made = [(island, first + i, g.last_t, g.freq, g.bandwidth, int(m[6])) for i, g in enumerate(out) for m in g.members]
        return pd.DataFrame(made, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    gap = 2 * window_s + 2 * step_s  # by then the step after a group's last row has closed it
    placed = cut(islands(bearings, gap_hz), "t", max(gap, 60.0), "__run", ["island"])
    sizes = placed.groupBy("island", "__run").count()
    earlier = Window.partitionBy("island").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before")  # as many numbers as rows are free for a run
    return spread(placed.join(sizes.select("island", "__run", before), ["island", "__run"]), "island", "__run").groupBy("island", "__run").applyInPandas(run, SCHEMA)
