"""Features, windows and streaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.functions import geo_sql as G
from lodestream.operators import features as T
from lodestream.plans.tables import observations, query

#: The tables' median gap is hours, so sessions end after six.
GAP = 6 * 3_600_000_000
_TX = f""", flagged AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY entity ORDER BY t_us, observation_id) > {GAP} THEN 1 ELSE 0 END AS new FROM obs),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY t_us, observation_id) AS session FROM flagged),
tx AS (SELECT entity, session::BIGINT AS session, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n, max(duration_s) AS reported_s FROM numbered GROUP BY 1, 2),
gaps AS (SELECT * FROM (SELECT *, (lead(start_us) OVER (PARTITION BY entity ORDER BY start_us) - start_us) / 1e6 AS gap_s FROM tx) WHERE gap_s IS NOT NULL)"""


def _tx(spark, sf_dir):
    return T.transmissions(observations(spark, sf_dir), ["entity"], "t_us", GAP, ["observation_id"], reported_s=F.max("duration_s"))


@query("transmissions", _TX + "SELECT * FROM tx")
def transmissions(spark, sf_dir):
    return _tx(spark, sf_dir)


_MED = """, m AS (SELECT entity, median({v}) AS med, count({v}) AS n FROM {t} GROUP BY 1)
SELECT entity, round(any_value(med), 6) AS value, CASE WHEN n > 1 THEN round(1.2533 * 1.4826 * median(abs({v} - med)) / sqrt(n), 6) END AS sigma, n FROM {t} JOIN m USING (entity) GROUP BY entity, n"""


def _median(frame, value):
    return T.median_and_error(frame, ["entity"], value).select("entity", F.round("med", 6).alias("value"), F.round("sigma", 6).alias("sigma"), "n")


@query("feature_bandwidth", _MED.format(v="bandwidth_hz", t="obs").replace(" n FROM obs JOIN", " n FROM (SELECT entity, bandwidth_hz FROM obs) JOIN"))
def feature_bandwidth(spark, sf_dir):
    return _median(observations(spark, sf_dir).select("entity", "bandwidth_hz"), "bandwidth_hz")


@query("feature_duration", _TX + _MED.format(v="reported_s", t="tx").replace(" n FROM tx JOIN", " n FROM (SELECT entity, reported_s FROM tx) JOIN"))
def feature_duration(spark, sf_dir):
    return _median(_tx(spark, sf_dir).select("entity", "reported_s"), "reported_s")


@query("feature_period", _TX + """, m AS (SELECT entity, median(gap_s) AS med, count(*) AS c FROM gaps GROUP BY 1)
SELECT entity, round(any_value(med), 6) AS period_s, round(greatest(1.2533 * 1.4826 * median(abs(gap_s - med)) / sqrt(c), 0.01 * any_value(med)), 6) AS sigma, c AS n FROM gaps JOIN m USING (entity) WHERE c >= 3 GROUP BY entity, c""")
def feature_period(spark, sf_dir):
    g = T.median_and_error(T.gaps(_tx(spark, sf_dir), ["entity"]).select("entity", "gap_s"), ["entity"], "gap_s").where("n >= 3")
    return g.select("entity", F.round("med", 6).alias("period_s"), F.round(F.greatest(F.col("sigma"), 0.01 * F.col("med")), 6).alias("sigma"), "n")


@query("feature_regularity", _TX + "SELECT entity, round(stddev_pop(gap_s) / avg(gap_s), 6) AS cv, round(stddev_pop(gap_s) / avg(gap_s) / sqrt(2 * count(*)), 6) AS sigma, count(*) AS n FROM gaps GROUP BY 1 HAVING count(*) >= 5")
def feature_regularity(spark, sf_dir):
    g = T.gaps(_tx(spark, sf_dir), ["entity"]).groupBy("entity").agg(F.stddev_pop("gap_s").alias("s"), F.avg("gap_s").alias("a"), F.count("*").alias("n")).where("n >= 5")
    return g.select("entity", F.round(F.col("s") / F.col("a"), 6).alias("cv"), F.round(F.col("s") / F.col("a") / F.sqrt(2 * F.col("n")), 6).alias("sigma"), "n")


@query("feature_duty_cycle", _TX + "SELECT entity, round(least(sum(reported_s) / ((max(end_us) - min(start_us)) / 1e6), 1.0), 6) AS duty FROM tx GROUP BY 1 HAVING max(end_us) - min(start_us) >= 60000000")
def feature_duty_cycle(spark, sf_dir):
    t = _tx(spark, sf_dir).groupBy("entity").agg(F.sum("reported_s").alias("on"), (F.max("end_us") - F.min("start_us")).alias("span")).where("span >= 60000000")
    return t.select("entity", F.round(F.least(F.col("on") / (F.col("span") / 1e6), F.lit(1.0)), 6).alias("duty"))


@query("feature_categories", "SELECT entity, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS hints, count(DISTINCT basis) AS n_basis FROM obs GROUP BY 1")
def feature_categories(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("hints"), F.countDistinct("basis").alias("n_basis"))


@query("source_counts_map", "SELECT entity, string_agg(source_id || '=' || n, ',' ORDER BY source_id) AS sources FROM (SELECT entity, source_id, count(*) AS n FROM obs GROUP BY 1, 2) GROUP BY 1")
def source_counts_map(spark, sf_dir):
    c = observations(spark, sf_dir).groupBy("entity", "source_id").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("source_id", "n")))  # one entry per source
    return c.groupBy("entity").agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["source_id"], F.lit("="), p["n"].cast("string"))), ",").alias("sources"))


@query("time_frame_counts", "SELECT observation_id, count(*) OVER w AS n_window, round(sum(duration_s) OVER w, 4) AS sum_s FROM obs WINDOW w AS (PARTITION BY entity ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)")
def time_frame_counts(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("t_us").rangeBetween(-86_400_000_000, 0)
    return observations(spark, sf_dir).select("observation_id", F.count("*").over(w).alias("n_window"), F.round(F.sum("duration_s").over(w), 4).alias("sum_s"))


@query("trail_last_20", "SELECT entity, observation_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t_us DESC, observation_id DESC)::INTEGER AS rn FROM obs) WHERE rn <= 20")
def trail_last_20(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy(F.desc("t_us"), F.desc("observation_id"))
    return observations(spark, sf_dir).select("entity", "observation_id", F.row_number().over(w).alias("rn")).where("rn <= 20")


@query("streak_islands", """, f AS (SELECT *, k % 3 <> 0 AS ok, sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t_us, observation_id) AS grp FROM obs)
SELECT entity, max(n) AS longest FROM (SELECT entity, grp, count(*) FILTER (ok) AS n FROM f GROUP BY 1, 2) GROUP BY 1""")
def streak_islands(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("t_us", "observation_id").rowsBetween(Window.unboundedPreceding, 0)
    f = observations(spark, sf_dir).withColumn("grp", F.sum((F.col("k") % 3 == 0).cast("int")).over(w))
    return f.groupBy("entity", "grp").agg(F.count_if(F.col("k") % 3 != 0).alias("n")).groupBy("entity").agg(F.max("n").alias("longest"))


@query("summary_60s", "SELECT t_us - t_us % 60000000 AS window_us, count(*) AS n, round(avg(duration_s), 6) AS mean_s FROM obs GROUP BY 1")
def summary_60s(spark, sf_dir):
    return observations(spark, sf_dir).groupBy((F.col("t_us") - F.col("t_us") % 60_000_000).alias("window_us")).agg(F.count("*").alias("n"), F.round(F.avg("duration_s"), 6).alias("mean_s"))
