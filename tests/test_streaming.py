"""The streaming forms give what the batch forms give, after silence and after a restart."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import grouping, track
from lodestream.streaming import picture, stateful

FIXES = "island long, t double, fix_id long, e double, n double, ee double, en double, nn double, freq_hz double, bandwidth_hz double, sources array<string>"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.set(name, before)


def all_of(spark, stream, folder, out):
    """Run to the end of what is there; rows so far."""
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.schema(stream.schema).parquet(str(out))


def test_groups_close_by_the_clock(rocksdb, tmp_path):
    spark = rocksdb
    rows = [(float(t) + 0.1 * i, s, s, 0.0, 4e8 + 12500.0 * c, 5000.0, t * 10 + c * 3 + i) for t in range(0, 40, 4) for c in (0, 1) for i, s in enumerate("abc")]
    bearings = spark.createDataFrame(rows, "t double, source_id string, sensor_id string, bearing_deg double, freq_hz double, bandwidth_hz double, observation_id long")
    islands = grouping.islands(bearings, 12_000.0)
    sets = lambda df: sorted(tuple(sorted(r["ids"])) for r in df.groupBy("island", "group_id").agg(F.collect_list("observation_id").alias("ids")).collect())
    batch = sets(grouping.group_snapshots(bearings))
    assert len(batch) == 20
    found = []
    for part in (0, 1, 2):  # restarted between the parts; in the last one only the clock moves
        if part < 2:
            islands.where((F.col("t") >= 18) == bool(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        else:
            spark.createDataFrame([(50.0,)], stateful.CLOCK).write.mode("append").json(str(tmp_path / "clock"))
        stream = stateful.group_stream(spark.readStream.schema(islands.schema).parquet(str(tmp_path / "in")), stateful.clock_stream(spark, str(tmp_path / "clock")))
        found = sets(all_of(spark, stream, tmp_path / "state", tmp_path / "out"))
        assert len(found) < len(batch) or part == 2
    assert found == batch


def fixes_of(spark):
    rng = np.random.default_rng(8)
    rows = []
    for island, stop in ((1, 400), (2, 60), (3, 1500)):  # the second and the first fall silent, the third moves the clock
        for t in np.arange(island, stop, 9.0):
            rows.append((island, float(t + rng.uniform(0, 2)), len(rows), float(rng.normal(0, 80)), float(rng.normal(0, 80)), 6400.0, 0.0, 6400.0, 4e8, 5e3, ["A"]))
        for t in np.arange(200, min(stop, 390), 11.0):  # leaves its site
            rows.append((island, float(t), len(rows), float(12.0 * (t - 200)), float(rng.normal(0, 80)), 6400.0, 0.0, 6400.0, 4e8, 5e3, ["B"]))
    rows.append((2, 30.5, len(rows), 9e5, 0.0, None, None, None, 4e8, 5e3, ["A"]))
    return spark.createDataFrame(rows, FIXES)


def test_silent_tracks_coast_and_retire_in_the_stream(rocksdb, tmp_path):
    """Three batches with restarts, then the clock alone: the rows of the batch form, at the same times."""
    spark = rocksdb
    fixes = fixes_of(spark)
    want = sorted(repr(tuple(r)) for r in track.tracks(fixes).where("kind <> 'folded' OR t < 1000").collect())
    kinds = {r["kind"] for r in track.tracks(fixes).select("kind").distinct().collect()}
    assert {"created", "fix", "coasting", "predicted", "retired", "orphan", "expired", "split"} <= kinds
    end = fixes.agg(F.max("t")).first()[0]
    for part, (low, high) in enumerate(((0, 150), (150, 700), (700, 1e9), (None, None))):
        if low is not None:
            fixes.where((F.col("t") >= low) & (F.col("t") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        else:
            spark.createDataFrame([(end + track.LATENCY_S + track.TICK_S + stateful.LATENESS_S,)], stateful.CLOCK).write.mode("append").json(str(tmp_path / "clock"))
        stream = stateful.track_stream(spark.readStream.schema(fixes.schema).parquet(str(tmp_path / "in")), stateful.clock_stream(spark, str(tmp_path / "clock")), standard="A")
        rows = all_of(spark, stream, tmp_path / "state", tmp_path / "out").collect()
        if part == 0:
            assert max(r["t"] for r in rows if r["kind"] == "fix") <= 150 - stateful.LATENESS_S
    got = sorted(repr(tuple(r)) for r in rows)
    assert got == want


def test_late_records_are_taken(rocksdb, tmp_path):
    spark = rocksdb
    row = lambda t, i: (1, float(t), i, 0.0, 0.0, 100.0, 0.0, 100.0, 4e8, 5e3, ["A"])
    for part, some in enumerate(([row(0, 0), row(5, 1), row(100, 2)], [row(120, 3)], [row(20, 4), row(121, 5)], [row(200, 6)])):
        spark.createDataFrame(some, FIXES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.track_stream(spark.readStream.schema(FIXES).parquet(str(tmp_path / "in")))
        out = all_of(spark, stream, tmp_path / "state", tmp_path / "out")
    taken = [r["fix_id"] for r in out.where("fix_id IS NOT NULL").collect()]
    assert sorted(taken) == [0, 1, 2, 3, 4, 5]  # the last one waits for the clock


def test_settle_moves_the_clock_once_and_gives_notice(spark, tmp_path):
    now, notices = [0.0], []
    clock = stateful.clock_stream(spark, str(tmp_path / "clock"))
    assert clock.isStreaming
    settle = stateful.Settle(spark, str(tmp_path / "clock"), lambda kind, text: notices.append(kind), now=lambda: now[0])
    read = lambda: [r["t"] for r in spark.read.schema(stateful.CLOCK).json(str(tmp_path / "clock")).collect()]
    settle.progress(5, "1970-01-01T00:01:40.000Z")
    for at in (1, 4.9, 5, 6, 20, 31, 40):
        now[0] = float(at)
        settle.silent()
        assert len(read()) == (at >= 5)
    assert read()[0] == pytest.approx(100 + track.LATENCY_S + track.TICK_S + stateful.LATENESS_S + 0.001) and notices == ["idle"]
    settle.progress(1, "1970-01-01T00:01:46.001Z")  # its own record
    assert notices == ["idle"]
    settle.progress(3, "1970-01-01T00:02:00.000Z")
    assert notices == ["idle", "resumed"] and math.isclose(settle.newest, 120)


def test_settled_stream(rocksdb, tmp_path):
    """With the listener at work, what waited for the clock comes out of a silent stream."""
    spark = rocksdb
    fixes = spark.createDataFrame([(1, float(t), t, 100.0, 50.0, 100.0, 0.0, 100.0, 4e8, 5e3, ["A"]) for t in (0, 10, 5, 20)], FIXES)
    fixes.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.track_stream(spark.readStream.schema(fixes.schema).parquet(str(tmp_path / "in")), stateful.clock_stream(spark, str(tmp_path / "clock")))
    settle = stateful.Settle(spark, str(tmp_path / "clock"), settle_s=2.0)
    spark.streams.addListener(settle)
    query = stream.writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            rows = [r["fix_id"] for r in spark.table("tracks").where("fix_id is not null").orderBy("t").collect()]
            if len(rows) == 4:
                break
            time.sleep(1)
    finally:
        query.stop()
        spark.streams.removeListener(settle)
    assert rows == [0, 5, 10, 20]
    assert picture.health(query)["active"] is False


def test_published_log_has_no_gap_and_removes(spark, tmp_path):
    schema = "key string, value string, at long"
    for n, rows in enumerate([[("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], [("a", "2", 3), ("b", None, 3), ("c", "5", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = picture.publish(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), "key", "value", "at", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted((r["seq"], r["key"], r["op"], r["value"]) for r in log.collect()) == [(1, "a", "upsert", "2"), (2, "b", "upsert", "1"), (3, "b", "remove", None), (4, "c", "upsert", "5")]
    assert {(r["key"], r["value"]) for r in picture.snapshot(log).collect()} == {("a", "2"), ("c", "5")}
    assert [r["value"] for r in picture.record(log, "r").collect()][0] == '{"run_id":"r","op":"hello"}'
    assert picture.resume(log, 2)[0] == "deltas" and picture.resume(log.where("seq > 3"), 1)[0] == "snapshot"


def test_the_table_as_a_stream(spark):
    """What the streamed queries give is what the batch queries give up to the clock."""
    from lodestream.plans import catalog

    sf, q = "/root/testdata/sf0.001", catalog.queries()
    batch, timed = q["imm_tracks"](spark, sf), q["timed_tracks"](spark, sf)
    assert timed.schema == batch.schema
    end = batch.where("kind = 'fix'").agg(F.max("t")).first()[0] - stateful.LATENESS_S - track.LATENCY_S
    early = lambda df: sorted(repr(tuple(r)) for r in df.where(F.col("t") < end).collect())
    assert early(timed) == early(batch) and len(early(timed)) > 500
    sets = lambda df: {(tuple(sorted(r["ids"])), r["t"]) for r in df.groupBy("island", "group_id").agg(F.collect_list("observation_id").alias("ids"), F.max("last_t").alias("t")).collect()}
    batch, timed = sets(q["snapshot_groups"](spark, sf)), sets(q["timed_groups"](spark, sf))
    assert timed <= batch and {t for _, t in batch - timed} and all(t > end - 2 for _, t in batch - timed)


def test_a_batch_reads_the_kept_picture_and_what_came_after(spark, tmp_path):
    """With old deltas gone, batches go on as before: they are not read."""
    import shutil

    schema, want, log = "key string, value string, at long", {}, str(tmp_path / "log")
    for n in range(7):
        rows = [(f"k{(n * 3 + i) % 8}", None if (n + i) % 4 == 3 else f"v{n % 3}", n) for i in range(3)]
        want |= {k: v for k, v, _ in rows}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = picture.publish(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), log, "key", "value", "at", str(tmp_path / "state"), keep_every=3).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        if n == 5:
            numbers = [r["seq"] for r in spark.read.parquet(log).orderBy("seq").collect()]
            assert numbers == list(range(1, len(numbers) + 1))
            for old in range(6):
                shutil.rmtree(f"{log}/batch={old}")
            assert {r["key"]: r["value"] for r in picture.standing(spark, log, 6)[0].collect()} == {k: v for k, v in want.items() if v is not None}
    now, last = picture.standing(spark, log, 7)
    assert {r["key"]: r["value"] for r in now.collect()} == {k: v for k, v in want.items() if v is not None}
    assert sorted(r["seq"] for r in spark.read.parquet(log).collect()) == list(range(len(numbers) + 1, last + 1))
