"""What streams do over time, as queries over whole tables: clocks, notices, buffers, timers, change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.plans.feature_queries import _TX, _tx
from lodestream.plans.tables import observations, query

_S = 1_000_000
_BLOCK = 4096


def running_max(frame: DataFrame, order: str, value: str, to: str, block: int = _BLOCK) -> DataFrame:
    """The greatest value up to each row of the whole table: of blocks before it, and inside its block, so no task orders all rows."""
    placed = frame.withColumn("__block", F.floor(F.col(order) / block))
    tops = placed.groupBy("__block").agg(F.max(value).alias("__top"))
    tops = tops.select("__block", F.max("__top").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))  # one row a block
    inside = F.max(value).over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__inside", inside).join(tops, "__block").withColumn(to, F.greatest("__before", "__inside")).drop("__block", "__before", "__inside")


@query("stream_clock", f"SELECT observation_id, (n - 2000000 - (n - 2000000) % {_S}) AS picture_us, t_us < n - 2000000 AS late FROM (SELECT *, max(t_us) OVER (ORDER BY observation_id) AS n FROM obs)")
def stream_clock(spark, sf_dir):
    """Picture time as records arrive: it trails the newest by two seconds and moves in steps of one; it never goes back."""
    o = running_max(observations(spark, sf_dir).select("observation_id", "t_us"), "observation_id", "t_us", "newest")
    behind = F.col("newest") - 2 * _S
    return o.select("observation_id", (behind - behind % _S).alias("picture_us"), (F.col("t_us") < behind).alias("late"))


@query("late_fixes", """SELECT observation_id, greatest(t_us - coalesce(b, t_us), 0) AS dt_us, greatest(t_us, coalesce(b, t_us)) AS track_us FROM (SELECT *, max(t_us) OVER (PARTITION BY entity ORDER BY observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM obs)""")
def late_fixes(spark, sf_dir):
    """Late records are taken, with no time step, and the track's time stays that of its newest."""
    w = Window.partitionBy("entity").orderBy("observation_id").rowsBetween(Window.unboundedPreceding, -1)
    o = observations(spark, sf_dir).withColumn("b", F.coalesce(F.max("t_us").over(w), F.col("t_us")))
    return o.select("observation_id", F.greatest(F.col("t_us") - F.col("b"), F.lit(0)).alias("dt_us"), F.greatest("t_us", "b").alias("track_us"))


_IDLE = 3_600 * _S


@query("idle_notices", f"""SELECT source_id || ':' || entity AS feed, notice, at_us FROM (SELECT source_id, entity, t_us, lag(t_us) OVER (PARTITION BY source_id, entity ORDER BY t_us, observation_id) AS p FROM obs),
  LATERAL (VALUES ('idle', p + {_IDLE}), ('resumed', t_us)) v(notice, at_us) WHERE t_us - p > {_IDLE}""")
def idle_notices(spark, sf_dir):
    """Of each silence one notice when it has lasted long enough, and one when the feed is heard again (an hour stands for 30 s)."""
    w = Window.partitionBy("source_id", "entity").orderBy("t_us", "observation_id")
    gaps = observations(spark, sf_dir).withColumn("p", F.lag("t_us").over(w)).where(F.col("t_us") - F.col("p") > _IDLE)
    both = F.array(F.struct(F.lit("idle").alias("notice"), (F.col("p") + _IDLE).alias("at_us")), F.struct(F.lit("resumed").alias("notice"), F.col("t_us").alias("at_us")))
    return gaps.select(F.concat_ws(":", "source_id", F.col("entity").cast("string")).alias("feed"), F.inline(both))


@query("settled_groups", _TX + f" SELECT entity, session, end_us AS last_us, end_us - end_us % {_S} + {_S} AS horizon_us, end_us - end_us % {_S} + {6 * _S} AS settled_us FROM tx")
def settled_groups(spark, sf_dir):
    """When a silent feed is settled: its horizon is a step after its newest record, five seconds on all that is open closes."""
    t = _tx(spark, sf_dir)
    step = F.col("end_us") - F.col("end_us") % _S
    return t.select("entity", "session", F.col("end_us").alias("last_us"), (step + _S).alias("horizon_us"), (step + 6 * _S).alias("settled_us"))


@query("reorder_buffer", f"SELECT observation_id, release_us, row_number() OVER (PARTITION BY entity, release_us ORDER BY t_us, observation_id)::INTEGER AS place FROM (SELECT *, t_us + {3 * _S} + ({_S} - (t_us + {3 * _S}) % {_S}) % {_S} AS release_us FROM obs)")
def reorder_buffer(spark, sf_dir):
    """Fixes are held for three seconds and come out at the next step, by time and number."""
    due = F.col("t_us") + 3 * _S
    o = observations(spark, sf_dir).withColumn("release_us", due + (_S - due % _S) % _S)
    return o.select("observation_id", "release_us", F.row_number().over(Window.partitionBy("entity", "release_us").orderBy("t_us", "observation_id")).alias("place"))


@query("coasting_republish", f"""SELECT entity, observation_id, tick_us, round((entity * 733 % 20011) + 3.0::DOUBLE * (tick_us - t_us) / 1e6, 3) AS e FROM (SELECT entity, observation_id, t_us, unnest(generate_series(t_us + {90 * _S}, least(coalesce(nxt - 1, t_us + {690 * _S}), t_us + {690 * _S}), {100 * _S})) AS tick_us
  FROM (SELECT *, lead(t_us) OVER (PARTITION BY entity ORDER BY t_us, observation_id) AS nxt FROM obs) WHERE coalesce(nxt - 1, t_us + {690 * _S}) >= t_us + {90 * _S})""")
def coasting_republish(spark, sf_dir):
    """Predicted positions of tracks that coast: from 90 s of silence on until they are heard or retire (100 s stand for 10)."""
    w = Window.partitionBy("entity").orderBy("t_us", "observation_id")
    end = F.least(F.coalesce(F.lead("t_us").over(w) - 1, F.col("t_us") + 690 * _S), F.col("t_us") + 690 * _S)
    silent = observations(spark, sf_dir).withColumn("end", end).where(F.col("end") >= F.col("t_us") + 90 * _S)
    ticks = silent.select("entity", "observation_id", "t_us", F.explode(F.sequence(F.col("t_us") + 90 * _S, "end", F.lit(100 * _S))).alias("tick_us"))
    return ticks.select("entity", "observation_id", "tick_us", F.round((F.col("entity") * 733 % 20011) + 3.0 * (F.col("tick_us") - F.col("t_us")) / 1e6, 3).alias("e"))


@query("orphan_ttl", f"SELECT observation_id AS fix_id, op, at_us FROM obs, LATERAL (VALUES ('upsert', t_us), ('remove', t_us + {30 * _S})) v(op, at_us) WHERE basis = 'unreported'")
def orphan_ttl(spark, sf_dir):
    """Fixes of no track are shown for thirty seconds and then removed."""
    events = F.array(F.struct(F.lit("upsert").alias("op"), F.col("t_us").alias("at_us")), F.struct(F.lit("remove").alias("op"), (F.col("t_us") + 30 * _S).alias("at_us")))
    return observations(spark, sf_dir).where("basis = 'unreported'").select(F.col("observation_id").alias("fix_id"), F.inline(events))


_STATE = "CASE WHEN k % 10 = 9 THEN 'retired' WHEN k % 10 = 8 THEN 'probationary' ELSE 'm' || bandwidth_hz::BIGINT END"


@query("dirty_publish", f"SELECT observation_id, entity, state FROM (SELECT *, lag(state) OVER (PARTITION BY entity ORDER BY t_us, observation_id) AS before FROM (SELECT *, {_STATE} AS state FROM obs)) WHERE state NOT IN ('retired', 'probationary') AND before IS DISTINCT FROM state")
def dirty_publish(spark, sf_dir):
    """Only tracks that changed are published, and none that is retired or on probation."""
    state = F.when(F.col("k") % 10 == 9, "retired").when(F.col("k") % 10 == 8, "probationary").otherwise(F.concat(F.lit("m"), F.col("bandwidth_hz").cast("long").cast("string")))
    w = Window.partitionBy("entity").orderBy("t_us", "observation_id")
    o = observations(spark, sf_dir).withColumn("state", state).withColumn("before", F.lag("state").over(w))
    return o.where(~F.col("state").isin("retired", "probationary") & ~F.col("before").eqNullSafe(F.col("state"))).select("observation_id", "entity", "state")


_WINDOW, _EVERY = 900 * 3600 * _S, 10 * 3600 * _S


@query("reid_throttle", f"""SELECT entity, min(born + (t_us - born + {_EVERY} - 1) // {_EVERY} * {_EVERY}) FILTER (hits >= 3 AND k % 7 = 0) AS published_us, max((t_us - born + {_EVERY} - 1) // {_EVERY}) AS last_check FROM (
  SELECT *, min(t_us) OVER (PARTITION BY entity) AS born, row_number() OVER (PARTITION BY entity ORDER BY t_us, observation_id) AS hits FROM obs) WHERE t_us - born <= {_WINDOW} GROUP BY 1""")
def reid_throttle(spark, sf_dir):
    """Re-identification is tried at fixed checks while a confirmed track is young, and stops at the first success (hours stand for seconds)."""
    w = Window.partitionBy("entity")
    o = observations(spark, sf_dir).withColumns({"born": F.min("t_us").over(w), "hits": F.row_number().over(w.orderBy("t_us", "observation_id"))}).where(F.col("t_us") - F.col("born") <= _WINDOW)
    check = F.floor((F.col("t_us") - F.col("born") + _EVERY - 1) / _EVERY)
    ok = (F.col("hits") >= 3) & (F.col("k") % 7 == 0)
    return o.groupBy("entity").agg(F.min(F.when(ok, F.col("born") + check * _EVERY)).alias("published_us"), F.max(check).alias("last_check"))


@query("remembered", _TX + """, f AS (SELECT entity, session, count(*) AS n, avg(freq_hz) AS freq_hz, max(bandwidth_hz) AS bandwidth_hz FROM numbered GROUP BY 1, 2)
SELECT tx.entity, tx.session, end_us AS last_heard_us, freq_hz, bandwidth_hz, round(reported_s, 6) AS duration_s FROM tx JOIN f ON f.entity = tx.entity AND f.session = tx.session WHERE tx.n >= 3""")
def remembered(spark, sf_dir):
    """What is kept of a track when it retires: its features as they were when it was last heard of; tentative ones leave nothing."""
    from lodestream.operators import features as T
    from lodestream.plans.feature_queries import GAP

    s = T.transmissions(observations(spark, sf_dir), ["entity"], "t_us", GAP, ["observation_id"], reported_s=F.max("duration_s"), freq_hz=F.avg("freq_hz"), bandwidth_hz=F.max("bandwidth_hz"))
    return s.where("n >= 3").select("entity", "session", F.col("end_us").alias("last_heard_us"), "freq_hz", "bandwidth_hz", F.round("reported_s", 6).alias("duration_s"))


@query("changelog_events", """, l AS (SELECT observation_id, entity, t_us, CASE WHEN k % 11 = 0 THEN NULL ELSE bandwidth_hz END AS value FROM obs),
p AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY t_us, observation_id) AS old FROM l),
d AS (SELECT *, CASE WHEN value IS NULL AND old IS NOT NULL THEN 'remove' WHEN value IS NOT NULL AND value IS DISTINCT FROM old THEN 'upsert' END AS op FROM p)
SELECT entity, op, value, row_number() OVER (ORDER BY observation_id) AS seq FROM d WHERE op IS NOT NULL""")
def changelog_events(spark, sf_dir):
    """Whole-object upserts and removals, numbered without a gap in the order of arrival."""
    w = Window.partitionBy("entity").orderBy("t_us", "observation_id")
    l = observations(spark, sf_dir).select("observation_id", "entity", "t_us", F.when(F.col("k") % 11 != 0, F.col("bandwidth_hz")).alias("value"))  # noqa: E741
    p = l.withColumn("old", F.lag("value").over(w))
    op = F.when(F.col("value").isNull() & F.col("old").isNotNull(), "remove").when(F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("old")), "upsert")
    d = p.withColumn("op", op).where("op is not null").withColumn("block", F.floor(F.col("observation_id") / _BLOCK))
    counts = d.groupBy("block").count()
    before = counts.select("block", F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # one row a block
    rank = F.row_number().over(Window.partitionBy("block").orderBy("observation_id"))
    return d.withColumn("rank", rank).join(before, "block").select("entity", "op", "value", (F.coalesce("before", F.lit(0)) + F.col("rank")).alias("seq"))


@query("sensor_changes", """SELECT observation_id, sensor, heard_us, bearing_deg FROM (SELECT observation_id, source_id || ':' || entity % 10 AS sensor, bearing_deg, max(t_us) OVER w AS heard_us, lag(bearing_deg) OVER w AS before FROM obs WINDOW w AS (PARTITION BY source_id || ':' || entity % 10 ORDER BY observation_id)) WHERE bearing_deg IS DISTINCT FROM before""")
def sensor_changes(spark, sf_dir):
    """The sensor board emits a sensor only when what it shows changed; the position is the last applied, not that of the latest time."""
    o = observations(spark, sf_dir).withColumn("sensor", F.concat_ws(":", "source_id", (F.col("entity") % 10).cast("string")))
    w = Window.partitionBy("sensor").orderBy("observation_id")
    o = o.withColumns({"heard_us": F.max("t_us").over(w), "before": F.lag("bearing_deg").over(w)})
    return o.where(~F.col("bearing_deg").eqNullSafe(F.col("before"))).select("observation_id", "sensor", "heard_us", "bearing_deg")
