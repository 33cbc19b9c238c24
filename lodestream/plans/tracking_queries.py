"""Matching of fixes, tracks and memories; robust estimates; heights, places and stay-put tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.functions import geo_sql as G
from lodestream.operators import matching as M
from lodestream.operators import memory
from lodestream.plans.feature_queries import _TX, _tx
from lodestream.plans.matching_queries import WIDTH, tracks
from lodestream.plans.matching_queries import _TRACKS as TRACKS
from lodestream.plans.tables import observations, query

#: Chi-square gates of two degrees of freedom: of fixes, and of anchors and merges.
GATE, NARROW = G.chi2_2dof(0.999), G.chi2_2dof(0.99)
_PLACES = "(SELECT *, (k * 211 % 20011)::DOUBLE AS fe, (k * 173 % 19997)::DOUBLE AS fn FROM obs)"
_CHANNEL = "abs(o.freq_hz - t.b_freq) <= greatest(2500.0, (o.bandwidth_hz + t.b_bw) / 4)"
#: The tracks' covariances, as the tables have none.
_EE, _NN = 250_000.0, 1_000_000.0


def _fixes(o):
    return o.select("observation_id", F.col("freq_hz").alias("a_freq"), F.col("bandwidth_hz").alias("a_bw"), (F.col("k") * 211 % 20011).cast("double").alias("fe"), (F.col("k") * 173 % 19997).cast("double").alias("fn"))


@query("nearest_compatible", TRACKS + f""", d AS (SELECT o.observation_id, t.track, t.track % 3 = 0 AS anchor, power(t.e - o.fe, 2) / {_EE} + power(t.n - o.fn, 2) / {_NN} AS d2,
    power(t.e + 40 - o.fe, 2) / 90000 + power(t.n - 25 - o.fn, 2) / 90000 AS own2 FROM {_PLACES} o JOIN tracks t ON {_CHANNEL})
SELECT observation_id, track, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY d2, track) AS rn FROM d WHERE d2 <= {GATE!r} AND (NOT anchor OR own2 <= {NARROW!r})) WHERE rn = 1""")
def nearest_compatible(spark, sf_dir):
    """The nearest track on a fix's channel inside the gate; an anchor must hold by its own estimate, too."""
    o = observations(spark, sf_dir)
    own = lambda track, de, dn: (track % 3 != 0) | ((de + 40) ** 2 / 90000.0 + (dn - 25) ** 2 / 90000.0 <= NARROW)
    return M.nearest_in_gate(_fixes(o), tracks(o), WIDTH, GATE, _EE, _NN, own).withColumn("d2", F.round("d2", 6))


@query("region_less_match", TRACKS + f""", d AS (SELECT o.observation_id, t.track, power(t.e - o.fe, 2) / {_EE} + power(t.n - o.fn, 2) / {_NN} AS d2 FROM {_PLACES} o JOIN tracks t ON {_CHANNEL}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY d2, track) AS rn FROM d WHERE d2 <= {GATE!r}) WHERE rn = 1)
SELECT obs.observation_id, best.track, CASE WHEN best.track IS NULL THEN 'orphan' ELSE 'alive' END AS outcome FROM obs LEFT JOIN best USING (observation_id) WHERE obs.basis = 'unreported'""")
def region_less_match(spark, sf_dir):
    """Fixes without a region: the track that they show to be alive, by the track's own region, or orphans."""
    o = observations(spark, sf_dir)
    bare = o.where("basis = 'unreported'")
    best = M.nearest_in_gate(_fixes(bare), tracks(o), WIDTH, GATE, _EE, _NN)
    return bare.select("observation_id").join(best, "observation_id", "left").select("observation_id", "track", F.when(F.col("track").isNull(), "orphan").otherwise("alive").alias("outcome"))


_HEARD = 43_200_000_000  # 600 s in a table that is some 70 times as sparse


@query("birth_parent_rank", TRACKS + f"""SELECT child, parent, rn FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY anchor DESC, distance, parent)::INTEGER AS rn FROM (
    SELECT o.track AS child, t.track AS parent, t.hits >= 5 AND t.track % 3 = 0 AS anchor, sqrt(power(o.e - t.e, 2) + power(o.n - t.n, 2)) AS distance
    FROM (SELECT *, b_freq AS freq_hz, b_bw AS bandwidth_hz FROM tracks) o JOIN tracks t ON o.track <> t.track AND {_CHANNEL} AND t.last_us >= o.last_us - {_HEARD}
    WHERE sqrt(power(o.e - t.e, 2) + power(o.n - t.n, 2)) <= 5000)) WHERE rn <= 3""")
def birth_parent_rank(spark, sf_dir):
    """Tracks in 5 km of a new one on its channel that were heard of late: anchors first, then by distance."""
    t = tracks(observations(spark, sf_dir))
    a = t.select(F.col("track").alias("child"), F.col("b_freq").alias("a_freq"), F.col("b_bw").alias("a_bw"), F.col("e").alias("fe"), F.col("n").alias("fn"), F.col("last_us").alias("now_us"))
    near = M.gate_join(a, t.withColumnRenamed("track", "parent"), WIDTH, 5000.0)
    d = F.sqrt(F.pow(F.col("fe") - F.col("e"), 2) + F.pow(F.col("fn") - F.col("n"), 2))
    heard = near.where((F.col("child") != F.col("parent")) & (d <= 5000) & (F.col("last_us") >= F.col("now_us") - _HEARD))
    w = Window.partitionBy("child").orderBy(F.desc("anchor"), "distance", "parent")
    return heard.withColumns({"anchor": (F.col("hits") >= 5) & (F.col("parent") % 3 == 0), "distance": d}).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("child", "parent", "rn")


@query("track_merge_pairs", TRACKS + f""", v AS (SELECT *, (track * 31 % 23 - 11)::DOUBLE AS ve, (track * 17 % 19 - 9)::DOUBLE AS vn FROM tracks)
SELECT o.track AS survivor, t.track AS absorbed, round(power(o.e - t.e, 2) / 9e6 + power(o.n - t.n, 2) / 9e6, 6) AS d2, round(power(o.ve - t.ve, 2) / 50 + power(o.vn - t.vn, 2) / 50, 6) AS v2
FROM (SELECT *, b_freq AS freq_hz, b_bw AS bandwidth_hz FROM v) o JOIN v t ON o.track < t.track AND {_CHANNEL}
WHERE power(o.e - t.e, 2) / 9e6 + power(o.n - t.n, 2) / 9e6 <= {NARROW!r} AND power(o.ve - t.ve, 2) / 50 + power(o.vn - t.vn, 2) / 50 <= {NARROW!r}""")
def track_merge_pairs(spark, sf_dir):
    """Pairs on one channel whose positions and velocities both agree; the lower number survives."""
    t = tracks(observations(spark, sf_dir)).withColumns({"ve": (F.col("track") * 31 % 23 - 11).cast("double"), "vn": (F.col("track") * 17 % 19 - 9).cast("double")})
    a = t.select(F.col("track").alias("survivor"), F.col("b_freq").alias("a_freq"), F.col("b_bw").alias("a_bw"), F.col("e").alias("fe"), F.col("n").alias("fn"), F.col("ve").alias("ave"), F.col("vn").alias("avn"))
    pairs = M.gate_join(a, t.withColumnRenamed("track", "absorbed"), WIDTH, math.sqrt(NARROW * 9e6))
    d2 = F.pow(F.col("fe") - F.col("e"), 2) / 9e6 + F.pow(F.col("fn") - F.col("n"), 2) / 9e6
    v2 = F.pow(F.col("ave") - F.col("ve"), 2) / 50 + F.pow(F.col("avn") - F.col("vn"), 2) / 50
    return pairs.where((F.col("survivor") < F.col("absorbed")) & (d2 <= NARROW) & (v2 <= NARROW)).select("survivor", "absorbed", F.round(d2, 6).alias("d2"), F.round(v2, 6).alias("v2"))


@query("coverage_semi", """, cover AS (SELECT source_id, min(t_us) AS t0, max(t_us) AS t1, 400000000.0 + 100000 * (source_id = 'view')::INT AS lo, 400300000.0 AS hi, CASE source_id WHEN 'click' THEN NULL WHEN 'view' THEN 1.0 ELSE 0.4 END AS fraction FROM obs WHERE k % 3 = 0 GROUP BY 1)
SELECT observation_id FROM obs o WHERE EXISTS (SELECT 1 FROM cover c WHERE c.source_id = o.source_id AND o.freq_hz BETWEEN c.lo AND c.hi AND o.t_us BETWEEN c.t0 AND c.t1 AND (c.fraction IS NULL OR c.fraction = 1.0))""")
def coverage_semi(spark, sf_dir):
    """Observations that a coverage record which listened without a break holds."""
    o = observations(spark, sf_dir)
    fraction = F.when(F.col("cs") == "click", F.lit(None).cast("double")).when(F.col("cs") == "view", 1.0).otherwise(0.4)
    cover = o.where("k % 3 = 0").groupBy(F.col("source_id").alias("cs")).agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1")).withColumns({"lo": F.when(F.col("cs") == "view", 400100000.0).otherwise(400000000.0), "hi": F.lit(400300000.0), "fraction": fraction})
    on = (F.col("source_id") == F.col("cs")) & F.col("freq_hz").between(F.col("lo"), F.col("hi")) & F.col("t_us").between(F.col("t0"), F.col("t1"))
    return o.join(cover.where("fraction is null or fraction = 1.0"), on, "left_semi").select("observation_id")


_LAST = 2000


@query("robust_bias", f""", s AS (SELECT source_id, duration_s * 1.00037::DOUBLE AS v FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t_us DESC, observation_id DESC) AS rn FROM obs) WHERE rn <= {_LAST}), m AS (SELECT source_id, median(v) AS med, count(*) AS n FROM s GROUP BY 1)
SELECT source_id, n, round(any_value(med), 6) AS bias, CASE WHEN n < 2 THEN 'inf'::DOUBLE ELSE round(1.2533 * 1.4826 * median(abs(v - med)) / sqrt(n), 6) END AS sigma FROM s JOIN m USING (source_id) GROUP BY source_id, n""")
def robust_bias(spark, sf_dir):
    """Median and its robust error of each source's last 2000 samples; one sample has no bound on its error."""
    w = Window.partitionBy("source_id").orderBy(F.desc("t_us"), F.desc("observation_id"))
    s = observations(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= _LAST).select("source_id", (F.col("duration_s") * 1.00037).alias("v"))
    m = s.groupBy("source_id").agg(F.median("v").alias("med"), F.count("*").alias("n"))
    both = s.join(m, "source_id").groupBy("source_id", "n").agg(F.first("med").alias("med"), F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    return both.select("source_id", "n", F.round("med", 6).alias("bias"), F.when(F.col("n") < 2, F.lit(math.inf)).otherwise(F.round(1.2533 * 1.4826 * F.col("mad") / F.sqrt("n"), 6)).alias("sigma"))


_FREQ = "freq_hz + (k % 9 - 4) * 100.0::DOUBLE"


def _measured(o):
    """The frequency as each observation measures it."""
    return o.withColumn("f", F.col("freq_hz") + (F.col("k") % 9 - 4) * 100.0)


@query("nuisance_table", f""", c AS (SELECT entity, source_id, count(*) AS n, min(t_us) AS first FROM obs GROUP BY 1, 2),
ref AS (SELECT entity, source_id AS reference FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, first, source_id) AS rn FROM c) WHERE rn = 1),
o AS (SELECT obs.*, {_FREQ} AS f, reference FROM obs JOIN ref USING (entity)),
l AS (SELECT *, last_value(CASE WHEN source_id = reference THEN f END IGNORE NULLS) OVER w AS rf, last_value(CASE WHEN source_id = reference THEN t_us END IGNORE NULLS) OVER w AS rt FROM o WINDOW w AS (PARTITION BY entity ORDER BY t_us, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT source_id, f - rf AS df, (t_us - rt) / 1e6 AS dt FROM l WHERE source_id <> reference AND t_us - rt <= 3600000000),
m AS (SELECT source_id, median(df) AS mf, median(dt) AS mt, count(*) AS n FROM s GROUP BY 1)
SELECT source_id, n, round(any_value(mf), 6) AS freq_bias_hz, round(1.2533 * 1.4826 * median(abs(df - mf)) / sqrt(n), 6) AS freq_sigma_hz, round(any_value(mt), 6) AS clock_offset_s, round(1.2533 * 1.4826 * median(abs(dt - mt)) / sqrt(n), 6) AS clock_sigma_s FROM s JOIN m USING (source_id) GROUP BY source_id, n""")
def nuisance_table(spark, sf_dir):
    """Each source's frequency bias and clock offset against the entity's reference source, the one heard most."""
    o = _measured(observations(spark, sf_dir))
    c = o.groupBy("entity", "source_id").agg(F.count("*").alias("n"), F.min("t_us").alias("first"))
    ref = c.groupBy("entity").agg(F.min_by("source_id", F.struct(-F.col("n"), "first", "source_id")).alias("reference"))
    is_ref = F.col("source_id") == F.col("reference")
    l = M.last_before(o.join(ref, "entity"), ["entity"], ["t_us", "observation_id"], {"rf": F.when(is_ref, F.col("f")), "rt": F.when(is_ref, F.col("t_us"))})  # noqa: E741
    s = l.where(~is_ref & (F.col("t_us") - F.col("rt") <= 3_600_000_000)).select("source_id", (F.col("f") - F.col("rf")).alias("df"), ((F.col("t_us") - F.col("rt")) / 1e6).alias("dt"))
    m = s.groupBy("source_id").agg(F.median("df").alias("mf"), F.median("dt").alias("mt"), F.count("*").alias("n"))
    g = s.join(m, "source_id").groupBy("source_id", "n").agg(F.first("mf").alias("mf"), F.first("mt").alias("mt"), F.median(F.abs(F.col("df") - F.col("mf"))).alias("af"), F.median(F.abs(F.col("dt") - F.col("mt"))).alias("at"))
    error = lambda mad: F.round(1.2533 * 1.4826 * F.col(mad) / F.sqrt("n"), 6)
    return g.select("source_id", "n", F.round("mf", 6).alias("freq_bias_hz"), error("af").alias("freq_sigma_hz"), F.round("mt", 6).alias("clock_offset_s"), error("at").alias("clock_sigma_s"))


@query("feature_freq", f"SELECT entity, round(avg({_FREQ}), 6) AS freq_hz, round(stddev_pop({_FREQ}) / sqrt(count(*)), 5) AS sigma, count(*) AS n FROM obs GROUP BY 1")
def feature_freq(spark, sf_dir):
    o = _measured(observations(spark, sf_dir))
    return o.groupBy("entity").agg(F.round(F.avg("f"), 6).alias("freq_hz"), F.round(F.stddev_pop("f") / F.sqrt(F.count("*")), 5).alias("sigma"), F.count("*").alias("n"))


@query("running_mean_freq", f"SELECT observation_id, round(avg({_FREQ}) OVER (PARTITION BY entity ORDER BY t_us, observation_id ROWS UNBOUNDED PRECEDING), 5) AS mean_hz FROM obs")
def running_mean_freq(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("t_us", "observation_id").rowsBetween(Window.unboundedPreceding, 0)
    return _measured(observations(spark, sf_dir)).select("observation_id", F.round(F.avg("f").over(w), 5).alias("mean_hz"))


@query("inverse_variance_height", """, e AS (SELECT entity, 100.0::DOUBLE + k AS alt, 40.0::DOUBLE + k * 31 AS g, tan(radians(k % 90 + 0.37::DOUBLE)) AS t, k % 90 + 0.37::DOUBLE AS el, radians(sigma_deg) AS s FROM obs WHERE sigma_deg IS NOT NULL),
h AS (SELECT entity, alt + g * t + g * g / (2 * 6371000.0) AS h, 1 / power(g * (1 + t * t) * s, 2) AS w, abs(t + g / 6371000.0) * (5.0::DOUBLE + alt / 10) AS r FROM e WHERE abs(el) <= 85 AND g >= 50)
SELECT entity, round(sum(w * h) / sum(w), 4) AS height_m, round(sqrt(1 / sum(w) + power(sum(w * r) / sum(w), 2)), 4) AS sigma_m, count(*) AS n FROM h GROUP BY 1""")
def inverse_variance_height(spark, sf_dir):
    """Heights from elevations: errors of angles average out, errors of ranges do not."""
    k = F.col("k")
    e = observations(spark, sf_dir).where("sigma_deg is not null").select("entity", (100.0 + k).alias("alt"), (40.0 + k * 31).alias("g"), (k % 90 + 0.37).alias("el"), F.radians("sigma_deg").alias("s"))
    t, g = F.tan(F.radians("el")), F.col("g")
    h = e.where("abs(el) <= 85 and g >= 50").select("entity", G.height_from_elevation(F.col("alt"), g, F.col("el"), F.lit(6371000.0)).alias("h"), (1 / F.pow(g * (1 + t * t) * F.col("s"), 2)).alias("w"), (F.abs(t + g / 6371000.0) * (5.0 + F.col("alt") / 10)).alias("r"))
    w = F.sum("w")
    return h.groupBy("entity").agg(F.round(F.sum(F.col("w") * F.col("h")) / w, 4).alias("height_m"), F.round(F.sqrt(1 / w + F.pow(F.sum(F.col("w") * F.col("r")) / w, 2)), 4).alias("sigma_m"), F.count("*").alias("n"))


_DAY = 86_400_000_000


@query("stay_put_test", f""", p AS (SELECT entity, t_us, (entity * 733 % 20011)::DOUBLE + (k % 7 - 3) * 37.3::DOUBLE AS e, (entity * 397 % 19997)::DOUBLE + (k % 11 - 5) * 29.1::DOUBLE AS n, 1 / power(43.7::DOUBLE + k % 13, 2) AS we, 1 / power(51.3::DOUBLE + k % 5, 2) AS wn, max(t_us) OVER (PARTITION BY entity) AS now_us FROM obs),
r AS (SELECT * FROM p WHERE t_us >= now_us - 15 * {_DAY}), m AS (SELECT entity, count(*) AS points, sum(we * e) / sum(we) AS me, sum(wn * n) / sum(wn) AS mn, max(t_us) - min(t_us) AS span FROM r GROUP BY 1)
SELECT entity, points, round(sum(we * power(e - me, 2) + wn * power(n - mn, 2)), 5) AS chi2,
  sum(we * power(e - me, 2) + wn * power(n - mn, 2)) <= 2.0::DOUBLE * (points - 1) * power(1 - 2 / (9 * 2.0::DOUBLE * (points - 1)) + 1.6449 * sqrt(2 / (9 * 2.0::DOUBLE * (points - 1))), 3) AS stays
FROM r JOIN m USING (entity) WHERE points >= 5 AND span >= 10 * {_DAY} GROUP BY entity, points""")
def stay_put_test(spark, sf_dir):
    """Whether the last positions agree with one place, their information-weighted mean (15 and 10 days stand for 180 and 120 s)."""
    k, entity = F.col("k"), F.col("entity")
    p = observations(spark, sf_dir).select(
        "entity", "t_us", ((entity * 733 % 20011).cast("double") + (k % 7 - 3) * 37.3).alias("e"), ((entity * 397 % 19997).cast("double") + (k % 11 - 5) * 29.1).alias("n"),
        (1 / F.pow(43.7 + k % 13, 2)).alias("we"), (1 / F.pow(51.3 + k % 5, 2)).alias("wn"),
    )
    r = p.withColumn("now_us", F.max("t_us").over(Window.partitionBy("entity"))).where(F.col("t_us") >= F.col("now_us") - 15 * _DAY)
    mean = lambda w, x: F.sum(F.col(w) * F.col(x)) / F.sum(w)
    m = r.groupBy("entity").agg(F.count("*").alias("points"), mean("we", "e").alias("me"), mean("wn", "n").alias("mn"), (F.max("t_us") - F.min("t_us")).alias("span"))
    both = r.join(m.where(f"points >= 5 and span >= {10 * _DAY}"), "entity")
    d2 = F.sum(F.col("we") * F.pow(F.col("e") - F.col("me"), 2) + F.col("wn") * F.pow(F.col("n") - F.col("mn"), 2))
    s = both.groupBy("entity", "points").agg(d2.alias("c"))
    return s.select("entity", "points", F.round("c", 5).alias("chi2"), (F.col("c") <= G.chi2_quantile(2.0 * (F.col("points") - 1), 1.6449)).alias("stays"))


@query("crossing_angle", """, b AS (SELECT DISTINCT entity, bearing_deg FROM obs WHERE bearing_deg < 360)
SELECT a.entity, round(max(least(abs(a.bearing_deg - c.bearing_deg) % 180, 180 - abs(a.bearing_deg - c.bearing_deg) % 180)), 6) AS crossing_deg FROM b a JOIN b c ON a.entity = c.entity AND a.bearing_deg < c.bearing_deg GROUP BY 1""")
def crossing_angle(spark, sf_dir):
    """The best crossing of an entity's bearings: of each line, that with the lines next to its right angle on either side."""
    line = observations(spark, sf_dir).where("bearing_deg < 360").select("entity", (F.col("bearing_deg") % 180).alias("x"), "bearing_deg").distinct()
    several = line.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    x = line.join(several, "entity", "left_semi").select("entity", "x").distinct()
    # lines as they are and a half turn on, and for each line the place of its right angle among them
    lines = x.select("entity", F.col("x").alias("at"), F.col("x").alias("line")).unionByName(x.select("entity", (F.col("x") + 180).alias("at"), F.col("x").alias("line")))
    asked = x.select("entity", (F.col("x") + 90).alias("at"), F.lit(None).cast("double").alias("line")).withColumn("from", F.col("at") - 90)
    every = lines.withColumn("from", F.lit(None).cast("double")).unionByName(asked)
    w = Window.partitionBy("entity").orderBy("at", F.col("from").isNotNull())
    near = every.withColumns({"a": F.last("line", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first("line", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("from is not null")
    apart = lambda c: F.least(F.pmod(F.abs(F.col("from") - F.col(c)), F.lit(180.0)), 180 - F.pmod(F.abs(F.col("from") - F.col(c)), F.lit(180.0)))
    return near.groupBy("entity").agg(F.round(F.max(F.greatest(apart("a"), apart("b"))), 6).alias("crossing_deg"))


#: Scenario constants of re-identification.
_MEMORY_S, _TAU_S, _PRIOR, _TWIN, _TEMPER, _CLIP = 21_600.0, 10_800.0, 0.5, 0.4, 0.8, 10.0
_COSITE, _AREA_M, _Q = 0.1, 30_000.0, 0.5
_MEM = _TX + """, mem AS (SELECT tx.entity, tx.session, start_us, end_us, tx.n, 400e6 + tx.entity % 40 * 12500.0::DOUBLE AS freq_hz, log10(12500.0::DOUBLE * (1 + tx.entity % 4)) AS bw, log10(greatest(abs(reported_s) + 1, 1e-12)) AS dur, (tx.entity * 733 % 20011)::DOUBLE + tx.session % 5 * 300 AS e, (tx.entity * 397 % 19997)::DOUBLE AS nn FROM tx),
cand AS (SELECT a.entity, a.session, b.entity AS old, b.session AS old_session, (a.start_us - b.end_us) / 1e6 AS gap_s, a.freq_hz - b.freq_hz AS df, a.bw - b.bw AS db, a.dur - b.dur AS dd, a.e - b.e AS de, a.nn - b.nn AS dn
  FROM mem a JOIN mem b ON a.freq_hz = b.freq_hz AND (a.entity <> b.entity OR a.session <> b.session) AND b.end_us < a.start_us AND a.start_us - b.end_us <= 21600000000)"""
_LN = "(-0.5 * ({d} * {d} / {v} + ln(2 * pi() * {v})))"


def _llr_sql(d: str, within: float, between: float) -> str:
    one, two = _LN.format(d=d, v=f"{within**2!r}::DOUBLE"), _LN.format(d=d, v=f"{within**2 + between**2!r}::DOUBLE")
    return f"greatest(-{_CLIP}, least({_CLIP}, {_TEMPER}::DOUBLE * ({one} - {two})))"


def _remembered(spark, sf_dir):
    """Sessions with what re-identification compares."""
    return _tx(spark, sf_dir).select(
        "entity", "session", "start_us", "end_us", "n", (400e6 + F.pmod("entity", F.lit(40)) * 12500.0).alias("freq_hz"), F.log10(12500.0 * (1 + F.col("entity") % 4)).alias("bw"), F.log10(F.greatest(F.abs("reported_s") + 1, F.lit(1e-12))).alias("dur"),
        ((F.col("entity") * 733 % 20011).cast("double") + F.col("session") % 5 * 300).alias("e"), (F.col("entity") * 397 % 19997).cast("double").alias("nn"),
    )


_FEATURES = ["bw", "dur", "e", "nn"]


def _candidates(spark, sf_dir, step, schema: str, features: list[str]):
    """What ``step`` makes of new sessions and the remembered ones on their channel that ended in the six hours before."""
    mem = _remembered(spark, sf_dir)
    a, b = mem.select("freq_hz", "entity", "session", "start_us", *features), mem.select("freq_hz", "entity", "session", "end_us", *features)
    return M.before_map(a, b, ["freq_hz"], "start_us", "end_us", int(_MEMORY_S * 1e6), step, schema)


def _gap_s(a, b, i, j):
    return (a["start_us"][i] - b["end_us"][j]) / 1e6


def _names(a, b, i, j):
    return {"entity": a["entity"][i], "session": a["session"][i], "old": b["entity"][j], "old_session": b["session"][j]}


_PAIR = "entity long, session long, old long, old_session long"


@query("reid_candidates", _MEM + "SELECT entity, session, old, old_session, round(gap_s, 3) AS gap_s FROM cand")
def reid_candidates(spark, sf_dir):
    step = lambda a, b, i, j: _names(a, b, i, j) | {"gap_s": _gap_s(a, b, i, j)}
    return _candidates(spark, sf_dir, step, _PAIR + ", gap_s double", []).withColumn("gap_s", F.round("gap_s", 3))


_R_EFF = 3 * math.sqrt(2 * 150.0**2)
_REID = _MEM + f""", f AS (SELECT *, {_llr_sql('df', 500.0, 2500.0)} + {_llr_sql('db', 0.05, 0.3)} + {_llr_sql('dd', 0.12, 0.4)} AS log_r, sqrt(de * de + dn * dn) AS distance, greatest(gap_s, 1.0) AS dt FROM cand),
g AS (SELECT *, 45000.0::DOUBLE AS c, exp(-dt / 3600) AS stay, distance <= 15.0 * dt + 3 * sqrt(45000.0::DOUBLE) AS reachable, greatest(least(15.0::DOUBLE * dt, {_AREA_M}), {_R_EFF!r}, 1.0) AS r FROM f),
h AS (SELECT *, ln(stay * exp(-0.5 * ((de * de + dn * dn) / (c + {_Q} * dt) + ln(4 * pi() * pi() * power(c + {_Q} * dt, 2)))) + CASE WHEN reachable THEN (1 - stay) / (pi() * r * r) ELSE 0 END + 1e-300) AS g1,
  ln({_COSITE} * exp(-0.5 * ((de * de + dn * dn) / c + ln(4 * pi() * pi() * c * c))) + (1 - {_COSITE}) / (pi() * {_AREA_M} * {_AREA_M})) AS g0 FROM g),
o AS (SELECT *, {_PRIOR} * exp(-gap_s / {_TAU_S}) * exp(log_r) / ({_TWIN} * exp(log_r) + 1 - {_TWIN}) * exp(greatest(g1 - g0, -12.0)) AS odds FROM h)"""


def _ln_normal(d, v: float):
    return -0.5 * (d * d / v + math.log(2 * math.pi * v))


def odds_of(gap_s, df, db, dd, de, dn):
    """Odds of candidates, and whether they could be there: prior by the gap, shared features (of which a twin has as many), and the way."""

    def llr(d, within: float, between: float):
        return np.fmax(-_CLIP, np.fmin(_CLIP, _TEMPER * (_ln_normal(d, within**2) - _ln_normal(d, within**2 + between**2))))

    r = np.exp(llr(df, 500.0, 2500.0) + llr(db, 0.05, 0.3) + llr(dd, 0.12, 0.4))
    dt, var = np.maximum(gap_s, 1.0), 45000.0
    stay, q2 = np.exp(-dt / 3600), de * de + dn * dn
    wide = np.maximum(np.minimum(15.0 * dt, _AREA_M), max(_R_EFF, 1.0))
    reachable = np.sqrt(q2) <= 15.0 * dt + 3 * math.sqrt(var)
    density = lambda v: np.exp(-0.5 * (q2 / v + np.log(4 * math.pi**2 * v * v)))
    same = stay * density(var + _Q * dt) + np.where(reachable, (1 - stay) / (math.pi * wide * wide), 0.0) + 1e-300
    other = _COSITE * density(var) + (1 - _COSITE) / (math.pi * _AREA_M**2)
    return _PRIOR * np.exp(-gap_s / _TAU_S) * r / (_TWIN * r + 1 - _TWIN) * np.exp(np.fmax(np.log(same) - np.log(other), -12.0)), reachable


def _weighed(a, b, i, j):
    """Each pair's chance among all of its session, and whether it is reachable."""
    odds, reachable = odds_of(_gap_s(a, b, i, j), 0.0, *(a[c][i] - b[c][j] for c in _FEATURES))
    return odds / (1 + np.bincount(i, odds, len(a["entity"])))[i], reachable


@query("reid_normalise", _REID + """SELECT entity, session, old, old_session, reachable, round(odds / (1 + sum(odds) OVER (PARTITION BY entity, session)), 6) AS p FROM o""")
def reid_normalise(spark, sf_dir):
    def step(a, b, i, j):
        p, reachable = _weighed(a, b, i, j)
        return _names(a, b, i, j) | {"reachable": reachable, "p": p}

    return _candidates(spark, sf_dir, step, _PAIR + ", reachable boolean, p double", _FEATURES).withColumn("p", F.round("p", 6))


@query("reid_published", _REID + """, p AS (SELECT entity, session, old, old_session, odds / (1 + sum(odds) OVER (PARTITION BY entity, session)) AS p FROM o),
r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(p) OVER w, 0) AS p2 FROM p WINDOW w AS (PARTITION BY entity, session ORDER BY round(p, 9) DESC, old, old_session))
SELECT entity, session, old, old_session, round(p, 6) AS p FROM r WHERE rn = 1 AND p >= 0.5 AND p - p2 >= 0.15""")
def reid_published(spark, sf_dir):
    """The best candidate of each new session, where it is likely and leads."""

    def step(a, b, i, j):
        p, _ = _weighed(a, b, i, j)
        most = np.zeros(len(a["entity"]))
        np.maximum.at(most, i, p)
        some = np.flatnonzero(most[i] >= 0.49)  # the rest can not be published
        pairs = _names(a, b, i[some], j[some])
        p, i = p[some], i[some]
        order = np.lexsort((pairs["old_session"], pairs["old"], -np.round(p, 9), i))
        p, i = p[order], i[order]
        best = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, int)
        second = np.concatenate((p[1:], [0.0])) * (np.concatenate((i[1:], [-1])) == i)
        told = best[(p[best] >= 0.5) & (p[best] - second[best] >= 0.15)]
        return {c: v[order][told] for c, v in pairs.items()} | {"p": p[told]}

    return _candidates(spark, sf_dir, step, _PAIR + ", p double", _FEATURES).withColumn("p", F.round("p", 6))


@query("reid_memory")
def reid_memory(spark, sf_dir):
    """Sessions one after the other: whom each is consistent with once earlier ones have used up theirs, and the prior that it starts from."""
    share = F.lit(1.0) / (1 + F.col("entity") % 4)
    posterior = F.create_map(F.lit("a"), share * 0.9, F.lit("b"), (1 - share) * 0.9, F.lit("background"), F.lit(0.1))
    each = _remembered(spark, sf_dir).select(
        F.pmod("entity", F.lit(40)).cast("long").alias("channel"), (F.col("entity") * 10_000 + F.col("session")).cast("long").alias("id"), (F.col("start_us") / 1e6).alias("start_s"), (F.col("end_us") / 1e6).alias("end_s"), posterior.alias("posterior"),
        "start_us", "end_us", "n", *_FEATURES,
    )

    def weigh(c, i, j):
        gap = c["start_us"][i] - c["end_us"][j]
        odds, _ = odds_of(gap / 1e6, 0.0, *(c[f][i] - c[f][j] for f in _FEATURES))
        shared = 3 + ((c["n"][i] >= 2) & (c["n"][j] >= 2))  # frequency, bandwidth, duration; a period only of two or more
        return odds, shared, (gap > 0) & (gap <= _MEMORY_S * 1e6)

    return memory.reidentify_by(each, weigh, ["start_us", "end_us", "n", *_FEATURES], {"a": 0.3, "b": 0.2, "background": 0.5})


@query("identity_bound", """SELECT entity, CASE WHEN count(*) FILTER (NOT k % 10 BETWEEN 0 AND 10) > 0 THEN NULL WHEN count(*) FILTER (k % 50 = 49) > 0 THEN 0.0 ELSE round(exp(coalesce(sum(ln(1 - 0.001 * (k % 10))) FILTER (k % 2 = 0 AND k % 50 <> 49), 0)), 9) END AS bound FROM obs GROUP BY 1""")
def identity_bound(spark, sf_dir):
    """The product of an entity's confidences: one if there is none, nought if one is nought; none outside of [0, 1] is let through."""
    k = F.col("k")
    confidence = F.when(k % 50 == 49, 0.0).when(k % 2 == 0, 1 - 0.001 * (k % 10))
    return observations(spark, sf_dir).withColumn("c", confidence).groupBy("entity").agg(
        F.when(F.count_if(~F.col("c").between(0, 1)) > 0, F.lit(None).cast("double")).when(F.count_if(F.col("c") == 0) > 0, 0.0).otherwise(F.round(F.exp(F.coalesce(F.sum(F.log(F.when(F.col("c") > 0, F.col("c")))), F.lit(0.0))), 9)).alias("bound")
    )
