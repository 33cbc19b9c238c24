"""Operators that SQL does not express: grouping, fixes, tracks, soft likelihoods, map features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions import sql_surface
from lodestream.operators import grouping, locate, track
from lodestream.operators.lineage import cut_lineage
from lodestream.plans.tables import observations, observed, query
from lodestream.streaming import stateful

#: Sites of the five sources (latitude, longitude).
_SITES = {"click": (50.00, 10.00), "view": (50.10, 10.25), "purchase": (49.90, 10.30), "signup": (50.15, 10.05), "logout": (49.85, 10.12)}


def _sites(spark, o):
    names = sorted(r[0] for r in o.select("source_id").distinct().collect())  # one row per source
    spots = list(_SITES.values())
    return F.broadcast(spark.createDataFrame([(n, *spots[i % len(spots)]) for i, n in enumerate(names)], "source_id string, s_lat double, s_lon double"))


def _scaled(o):
    """Seconds of a run a thousand times as dense, on channels 12.5 kHz apart that are narrower than that."""
    return o.withColumns({"t": F.col("t_us") / 1e9, "bandwidth_hz": F.lit(5000.0)})


def _grouped(o):
    return _scaled(o).select("t", "source_id", (F.col("entity") % 3).cast("string").alias("sensor_id"), "bearing_deg", "freq_hz", "bandwidth_hz", "observation_id")


@query("snapshot_groups")
def snapshot_groups(spark, sf_dir):
    return grouping.group_snapshots(_grouped(observations(spark, sf_dir)))


def _cycles(o, again: bool = False):
    """All observations with the snapshot group that each is in: a channel for each entity, bearings up to a day apart, a sensor once a cycle. ``again``: read more than once."""
    rows = o.select(
        (F.col("t_us") / 1e6).alias("t"), "source_id", F.lit("").alias("sensor_id"), "bearing_deg",
        (400e6 + F.col("entity") * 12500.0).alias("freq_hz"), F.lit(5000.0).alias("bandwidth_hz"), "observation_id",
    )
    groups = grouping.group_snapshots(rows, step_s=86400.0, window_s=86400.0).select("observation_id", F.col("group_id").alias("cycle"))
    return o.join(cut_lineage(groups) if again else groups, "observation_id").withColumn("group_id", F.col("entity") * 10_000_000 + F.col("cycle"))


def _members(spark, sf_dir, shifts: tuple[float, ...] = (0.0,), again: bool = False):
    """Bearings from each source's site to the entity's place, or to places that lie so many degrees south and east of it, all in one pass over the groups."""
    shift = F.col("shift")
    lat, lon = 50.0 + (F.col("entity") % 17) * 0.01 - shift, 10.1 + (F.col("entity") % 13) * 0.01 + shift
    o = observations(spark, sf_dir)
    sited = _cycles(o, again).join(_sites(spark, o), "source_id").withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    true = F.degrees(F.atan2((lon - F.col("s_lon")) * F.cos(F.radians(lat)), lat - F.col("s_lat")))
    return sited.select(
        "entity", "group_id", F.col("source_id").alias("sensor"), F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"), F.pmod(true + (F.col("k") % 5 - 2) * 0.5, F.lit(360.0)).alias("bearing_deg"), "sigma_deg", "basis",
        "observation_id", (F.col("t_us") / 1e6).alias("t"), "freq_hz", "bandwidth_hz", (300.0 + F.col("k") % 5 * 40).alias("sensor_alt_m"),
        F.when(F.col("k") % 3 == 0, 1.0 + F.col("k") % 7).alias("elevation_deg"), (F.col("sigma_deg") / 4).alias("elevation_sigma_deg"), F.when(F.col("k") % 3 == 0, F.col("basis")).alias("elevation_basis"),
    )


@query("bearing_fix")
def bearing_fix(spark, sf_dir):
    """Fix records of all snapshot groups, with their bearings' shares and heights; every bearing is in one group."""
    return locate.fixes(_members(spark, sf_dir), by="entity")


@query("cochannel_split")
def cochannel_split(spark, sf_dir):
    """The same groups where a second emitter shares the channel, so each sensor has two bearings in a group."""
    return locate.fixes(_members(spark, sf_dir, (0.0, 0.1)), by="entity")


@query("cochannel_split_sql")
def cochannel_split_sql(spark, sf_dir):
    """The fixes of ``cochannel_split``, asked for in SQL alone: grouped bearings into a table function, and how far each fix is from the first sensor."""
    sql_surface.register(spark)
    _members(spark, sf_dir, (0.0, 0.1), again=True).createOrReplaceTempView("lodestream_members")
    return spark.sql("""
        WITH first AS (SELECT group_id, min_by(struct(lat, lon), sensor) AS s FROM lodestream_members GROUP BY group_id)
        SELECT f.*, geodesic_distance_m(first.s.lat, first.s.lon, f.lat, f.lon) AS range_m
        FROM locate_fixes(TABLE(SELECT group_id, sensor, lat, lon, bearing_deg, sigma_deg, basis FROM lodestream_members) PARTITION BY group_id) f
        JOIN first USING (group_id)""")


def _began(spark, sf_dir) -> float:
    return _scaled(observations(spark, sf_dir)).agg(F.min("t")).first()[0] or 0.0


def _fixes(o, t0: float):
    """Every observation as a fix. Two entities share a site and a channel; half way through the odd one leaves it at some 15 m/s."""
    site, since = F.floor(F.col("entity") / 80) * 40 + F.col("entity") % 40, F.col("t") - (t0 + 1296.0)
    away = F.when((F.floor(F.col("entity") / 40) % 2 == 1) & (since > 0), since * 15.0).otherwise(0.0)
    bias = F.when(F.col("source_id") == "purchase", 900.0).otherwise(0.0)
    return _scaled(o).select(
        (F.col("entity") % 40).cast("long").alias("island"), "t", F.col("observation_id").alias("fix_id"),
        ((site * 733 % 20011) + (F.col("k") % 7 - 3) * 20.0 + away).alias("e"), ((site * 397 % 19997) + (F.col("k") % 5 - 2) * 20.0).alias("n"),
        F.lit(2500.0).alias("ee"), F.lit(0.0).alias("en"), F.lit(2500.0).alias("nn"), (F.col("freq_hz") + bias).alias("freq_hz"), "bandwidth_hz", F.array("source_id").alias("sources"),
    )


def _all_fixes(spark, sf_dir):
    return _fixes(observations(spark, sf_dir), _began(spark, sf_dir))


@query("imm_tracks")
def imm_tracks(spark, sf_dir):
    """Every change of every track."""
    return track.tracks(_all_fixes(spark, sf_dir))


@query("track_anchors")
def track_anchors(spark, sf_dir):
    """The last point of each anchor with its covariance, and how often it was heard there."""
    rows = track.tracks(_all_fixes(spark, sf_dir)).where("anchor AND kind = 'fix'")
    last = F.max_by(F.struct("anchor_e", "anchor_n", "anchor_ee", "anchor_en", "anchor_nn"), F.struct("t", "fix_id"))
    return rows.groupBy("island", "run", "track").agg(F.count("*").alias("heard"), F.max("t").alias("t"), last.alias("a")).select("island", "run", "track", "heard", "t", "a.*")


@query("track_lineage")
def track_lineage(spark, sf_dir):
    """What became of tracks that appeared beside others: splits, undone merges, relocations, folds and merges."""
    rows = track.tracks(_all_fixes(spark, sf_dir))
    return rows.where(F.col("kind").isin("candidate", "split", "unmerged", "relocated", "folded", "merged")).select("island", "run", "track", "t", "kind", "other", "stayed")


@query("learned_biases")
def learned_biases(spark, sf_dir):
    """What the tracker learned of each source's frequency and clock."""
    return track.nuisance(track.tracks(_all_fixes(spark, sf_dir)))


def _events_stream(spark, sf_dir):
    """The table as a stream; a pattern, as a stream's path may be a file only by one."""
    return observed(spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet"))


@query("timed_groups")
def timed_groups(spark, sf_dir):
    """Snapshot groups of the table as a stream, closed by the stream's clock; those still open at its end are not in it."""
    channels = _grouped(observations(spark, sf_dir))
    islands = grouping.islands(channels, 12_000.0).groupBy("freq_hz").agg(F.first("island").alias("island"))  # one row a channel
    return stateful.to_the_end(spark, stateful.group_stream(_grouped(_events_stream(spark, sf_dir)).join(islands, "freq_hz")))


@query("timed_tracks")
def timed_tracks(spark, sf_dir):
    """Tracks of the table as a stream: what timers and the clock bring out by its end."""
    standard = observations(spark, sf_dir).groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()
    return stateful.to_the_end(spark, stateful.track_stream(_fixes(_events_stream(spark, sf_dir), _began(spark, sf_dir)), standard=standard["source_id"] if standard else None))
