"""Snapshot grouping and tracking as streams, with timers in event time.

Both run what their batch forms run. A key's rows wait in a list until the stream's clock has
passed them, so they are taken in the order of their times; what is open (groups, tracks) is a
map from number to state, of which only what changed is written back. The clock is Spark's watermark, which all
keys share: it trails the newest record of the whole stream by ``LATENESS_S``. Of each key
one timer is set for when something will happen if nothing is heard, so a silent key's groups
close, and its tracks coast, are shown again, retire or are folded back in time.

A watermark would drop late records. So each record passes twice: once with its time, which only
moves the clock, and once without, as what is taken; no record is dropped, and a late one is taken
at once. Where the whole stream falls silent the clock stands still. ``Settle`` then moves it on
to the newest record through a folder of clock records, and gives notice of long silences.

State is kept by RocksDB (``use_rocksdb``); a restart goes on from it.
"""

from __future__ import annotations

import math
import pickle
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from lodestream.operators import grouping, track
from lodestream.operators.lineage import cut_lineage, shared_folder

#: Seconds by which the clock trails the newest record, of silence until it catches up, and until a notice.
LATENESS_S, SETTLE_S, IDLE_S = 2.0, 5.0, 30.0
CLOCK = "t double"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def to_the_end(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over all that its source has now, with its state in the shared folder; the rows, once the folder is removed."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    use_rocksdb(spark)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return cut_lineage(spark.read.schema(stream.schema).parquet(f"{folder}/rows"))
    finally:
        spark.conf.set(name, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Clocked(StatefulProcessor):
    """Rows of a key in the order of their times, and timers. Subclasses say what an item of state is and what happens."""

    def __init__(self, columns: list[str], types: str) -> None:
        self.columns, self.types = columns, types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.types)
        self.items = handle.getMapState("items", "number long", "data binary")
        self.rest = handle.getValueState("rest", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
        new = [tuple(map(plain, r)) for pdf in rows for r in pdf.loc[pdf["taken"], self.columns].itertuples(index=False, name=None)]
        yield self._run(key[0], new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._run(key[0], [], timerValues)

    def close(self) -> None:
        pass

    def _run(self, key, new: list[tuple], timerValues) -> pd.DataFrame:
        clock = timerValues.getCurrentWatermarkInMs() / 1000
        waiting = [*(tuple(r) for r in self.waiting.get()), *new] if self.waiting.exists() else new
        before = {k[0]: bytes(v[0]) for k, v in self.items.iterator()} if self.items.exists() else {}
        state = self.load({k: pickle.loads(v) for k, v in before.items()}, pickle.loads(self.rest.get()[0]) if self.rest.exists() else None)
        ready = [r for r in waiting if self.ripe(r[0]) <= clock]
        out = self.advance(state, sorted(ready, key=lambda r: r[:2]), clock)
        items, rest = self.dump(state)
        items = {k: pickle.dumps(v) for k, v in items.items()}
        for k in before.keys() - items.keys():
            self.items.removeKey((k,))
        for k, v in items.items():
            if before.get(k) != v:
                self.items.updateValue((k,), (v,))
        self.rest.update((pickle.dumps(rest),))
        left = [r for r in waiting if self.ripe(r[0]) > clock]
        if left:
            self.waiting.put(left)
        elif self.waiting.exists():
            self.waiting.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        due = min([self.ripe(r[0]) for r in left] + [self.due(state)])
        if math.isfinite(due):
            self.handle.registerTimer(max(math.ceil(due * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return self.frame(key, out)


class Grouper(Clocked):
    def ripe(self, t: float) -> float:
        """The end of its step, whose rows are taken together."""
        return math.floor(t / grouping.STEP_S) * grouping.STEP_S + grouping.STEP_S

    def load(self, items: dict, rest) -> list:
        return [[items[k] for k in sorted(items)], *(rest or (0, -math.inf))]

    def dump(self, state: list) -> tuple[dict, tuple]:
        groups, made, at = state
        return {g.number: g for g in groups}, (made, at)

    def due(self, state: list) -> float:
        return min((math.floor(g.last_t + grouping.WINDOW_S) + grouping.STEP_S for g in state[0]), default=math.inf)

    def advance(self, state: list, ready: list[tuple], clock: float) -> list:
        groups, made, at = state
        closed = []
        for now, some in grouping.by_steps(ready, clock):
            groups, gone = grouping.step(groups, some, now)
            closed += gone
        out = [(made + i, g) for i, g in enumerate(closed)]
        state[:] = [groups, made + len(closed), max(at, clock)]
        return out

    def frame(self, key: int, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key, i, g.last_t, g.freq, g.bandwidth, int(m[6])) for i, g in out for m in g.members], columns=[c.split()[0] for c in grouping.SCHEMA.split(", ")])


class Tracker(Clocked):
    def __init__(self, columns: list[str], types: str, standard: str | None, learned: dict[str, float]) -> None:
        super().__init__(columns, types)
        self.standard, self.learned = standard, learned

    def ripe(self, t: float) -> float:
        return t + track.LATENCY_S

    def load(self, items: dict, rest) -> track.State:
        return track.State.joined(items, rest) if rest else track.State(standard=self.standard)

    def dump(self, state: track.State) -> tuple[dict, dict]:
        return state.parted()

    def due(self, state: track.State) -> float:
        return state.due()

    def advance(self, state: track.State, ready: list[tuple], clock: float) -> list[dict]:
        out: list[dict] = []
        for fix in ready:
            if fix[0] - state.last > track.CUT_S:
                state.finish(math.inf, out)
            state.take(fix, self.learned, out)
        state.advance(clock, out)
        return out

    def frame(self, key: int, out: list[dict]) -> pd.DataFrame:
        return track.frame(key, out)


def _twice(rows: DataFrame, clock: DataFrame | None, columns: list[str]) -> DataFrame:
    """Each record with its time to move the clock, and without to be taken; records of ``clock`` move it only."""
    none = F.lit(None).cast("timestamp")
    at = F.timestamp_millis(F.floor(F.col("t") * 1000).cast("long"))
    both = F.explode(F.array(F.struct(F.lit(False).alias("taken"), at.alias("event")), F.struct(F.lit(True).alias("taken"), none.alias("event"))))
    out = rows.select("island", *columns, both.alias("__x")).select("island", *columns, "__x.taken", "__x.event")
    if clock is not None:
        empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns if c != "t"]
        out = out.unionByName(clock.select(F.lit(None).cast(rows.schema["island"].dataType).alias("island"), "t", *empty, F.lit(False).alias("taken"), at.alias("event")))
    return out.withWatermark("event", f"{LATENESS_S:g} seconds")


def _stream(rows: DataFrame, clock: DataFrame | None, columns: list[str], make: Callable[[list[str], str], Clocked], schema: str) -> DataFrame:
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return _twice(rows, clock, columns).groupBy("island").transformWithStateInPandas(make(columns, types), schema, "append", "EventTime")


MEMBER = ["t", "source_id", "sensor_id", "bearing_deg", "freq_hz", "bandwidth_hz", "observation_id"]


def group_stream(bearings: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """Members of groups as they close; input as ``group_snapshots`` with an ``island`` column."""
    return _stream(bearings, clock, MEMBER, Grouper, grouping.SCHEMA)


def track_stream(fixes: DataFrame, clock: DataFrame | None = None, standard: str | None = None, learned: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``track.tracks`` as the stream's clock moves on. ``standard``: the reference source; else each island's own."""
    return _stream(fixes, clock, track.FIX, lambda columns, types: Tracker(columns, types, standard, learned or {}), track.SCHEMA)


def clock_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Clock records as ``Settle`` drops them."""
    spark.createDataFrame([], CLOCK).write.mode("ignore").json(folder)
    return spark.readStream.schema(CLOCK).json(folder)


class Settle(StreamingQueryListener):
    """Moves the clock past the newest record once a stream is silent, and notes when it falls silent for long and when it is heard again."""

    def __init__(self, spark: SparkSession, folder: str, notice: Callable[[str, str], None] = lambda kind, text: None, ahead_s: float = track.LATENCY_S + track.TICK_S, settle_s: float = SETTLE_S, idle_s: float = IDLE_S, now: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.notice, self.ahead, self.settle_s, self.idle_s, self.now = spark, folder, notice, ahead_s, settle_s, idle_s, now
        self.newest, self.heard, self.settled, self.idle = -math.inf, now(), -math.inf, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.progress(event.progress.numInputRows, (event.progress.eventTime or {}).get("max"))

    def onQueryIdle(self, event) -> None:
        self.silent()

    def progress(self, rows: int, newest: str | None) -> None:
        at = datetime.fromisoformat(newest.replace("Z", "+00:00")).astimezone(UTC).timestamp() if newest else -math.inf
        if not rows or at <= max(self.newest, self.settled):
            self.silent()
            return
        self.newest, self.heard = at, self.now()
        if self.idle:
            self.idle = False
            self.notice("resumed", "Records are arriving again.")

    def silent(self) -> None:
        quiet = self.now() - self.heard
        if quiet >= self.settle_s and self.newest > self.settled and math.isfinite(self.newest):
            self.settled = self.newest + self.ahead + LATENESS_S + 0.001
            self.spark.createDataFrame([(self.settled,)], CLOCK).coalesce(1).write.mode("append").json(self.folder)
        if quiet > self.idle_s and not self.idle:
            self.idle = True
            self.notice("idle", f"No records for {quiet:.0f} s; the picture is as of the last one.")
