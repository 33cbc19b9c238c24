"""Wire records: lines to typed records, routes, rejects, normalised positions, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.functions import geo_sql as G
from lodestream.operators import ingest
from lodestream.plans.tables import observations, query
from lodestream.sources.observations import with_issues

#: The records of the driver's events: kind by formula, and in which way a line is broken (k modulo 29 to 53).
_WIRE = """, w AS (SELECT *, CASE k % 4 WHEN 0 THEN 'bearing' WHEN 1 THEN 'position' WHEN 2 THEN 'coverage' ELSE 'occupancy' END AS kind, strftime(make_timestamp(t_us - t_us % 1000000), '%Y-%m-%dT%H:%M:%SZ') AS t FROM obs),
j AS (SELECT *, CASE WHEN k % 29 = 28 THEN 'json' WHEN k % 31 = 30 THEN 'schema' WHEN k % 37 = 36 THEN 'kind' WHEN k % 41 = 40 THEN 'field' WHEN k % 43 = 42 THEN 'infinite' WHEN k % 47 = 46 THEN 'time'
  WHEN k % 53 = 52 AND kind = 'bearing' THEN 'bearing' WHEN k % 19 = 18 AND kind = 'position' THEN 'ellipse' WHEN k % 17 = 16 AND kind = 'position' THEN 'psd' WHEN k % 13 = 12 AND kind = 'coverage' THEN 'dwell' WHEN k % 11 = 10 AND kind = 'occupancy' THEN 'band' ELSE 'ok' END AS flaw FROM w)"""


def _flawed(spark, sf_dir):
    o = observations(spark, sf_dir)
    k = F.col("k")
    kind = F.when(k % 4 == 0, "bearing").when(k % 4 == 1, "position").when(k % 4 == 2, "coverage").otherwise("occupancy")
    flaw = F.when(k % 29 == 28, "json").when(k % 31 == 30, "schema").when(k % 37 == 36, "kind").when(k % 41 == 40, "field").when(k % 43 == 42, "infinite").when(k % 47 == 46, "time")
    flaw = flaw.when((k % 53 == 52) & (kind == "bearing"), "bearing").when((k % 19 == 18) & (kind == "position"), "ellipse").when((k % 17 == 16) & (kind == "position"), "psd")
    flaw = flaw.when((k % 13 == 12) & (kind == "coverage"), "dwell").when((k % 11 == 10) & (kind == "occupancy"), "band").otherwise("ok")
    second = F.timestamp_micros(F.col("t_us") - F.col("t_us") % 1_000_000)
    utc = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), second.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.withColumns({"kind": kind, "flaw": flaw, "t": utc})


def lines(spark, sf_dir):
    """Each event as a line of text, some of them broken."""
    o = _flawed(spark, sf_dir)
    is_, kind = lambda f: F.col("flaw") == f, F.col("kind")
    t = F.when(is_("time"), F.lit("2026-02-30T00:00:00Z")).otherwise(F.col("t"))
    head = F.format_string('{"schema":"%s","kind":"%s","observation_id":"%s","source_id":"%s","provenance":{"adapter":"a","adapter_version":"1","contract":"observation.v1"}', F.when(is_("schema"), "other").otherwise("observation.v1"), F.when(is_("kind"), "shape").otherwise(kind), "observation_id", "source_id")
    signal = F.format_string(',"t":"%s","freq_hz":%s,"bandwidth_hz":12500.0', t, F.when(is_("infinite"), "1e999").otherwise(F.format_string("%.1f", "freq_hz")))
    bearing = F.format_string(',"sensor_lat":50.0,"sensor_lon":10.0,"bearing_deg":%s,"bearing_uncertainty":{"basis":"measured","sigma_deg":2.0}', F.when(is_("bearing"), "360.0").otherwise(F.format_string("%.1f", (F.col("k") * 37.5) % 360)))
    region = F.when(is_("ellipse"), '"ellipse":{"semi_major_m":10.0,"semi_minor_m":20.0,"orientation_deg":0.0,"confidence":0.95}').when(is_("psd"), '"cov_en_m2":{"ee":1.0,"en":5.0,"nn":1.0}').otherwise('"cov_en_m2":{"ee":100.0,"en":5.0,"nn":90.0}')
    position = F.concat(F.lit(',"lat":50.0,"lon":10.0,"position_uncertainty":{"basis":"measured",'), region, F.lit("}"))
    coverage = F.format_string(',"t_start":"%s","t_end":"%s","band":{"min_hz":1.0,"max_hz":2.0},"dwell_s":%s,"revisit_s":2.0', t, t, F.when(is_("dwell"), "3.0").otherwise("1.0"))
    occupancy = F.format_string(',"t":"%s","band":{"min_hz":%s,"max_hz":2.0},"noise_floor_dbm":-100.0', t, F.when(is_("band"), "3.0").otherwise("1.0"))
    infinite = F.when(is_("infinite") & kind.isin("coverage", "occupancy"), ',"sensor_alt_m":1e999').otherwise("")
    body = F.when(kind == "bearing", F.concat(signal, bearing)).when(kind == "position", F.concat(signal, position)).when(kind == "coverage", coverage).otherwise(occupancy)
    text = F.concat(head, body, infinite, F.when(is_("field"), ',"bearing_sigma_deg":1.0').otherwise(""), F.lit("}"))
    return o.withColumn("text", F.when(is_("json"), F.substring(text, 1, 60)).otherwise(text))


def _judged(spark, sf_dir):
    return with_issues(lines(spark, sf_dir))


@query("route_records", _WIRE + "SELECT observation_id, CASE WHEN flaw <> 'ok' THEN 'reject' WHEN kind IN ('bearing', 'position') THEN 'signal' ELSE kind END AS route, kind, flaw FROM j")
def route_records(spark, sf_dir):
    """Where each line goes: rejects, coverage and occupancy apart from signals."""
    ok = F.size("issues") == 0
    return _judged(spark, sf_dir).select("observation_id", F.when(~ok, "reject").when(F.col("r.kind").isin("bearing", "position"), "signal").otherwise(F.col("r.kind")).alias("route"), "kind", "flaw")


_ISSUE = {
    "json": "/ is not JSON of this contract", "schema": "/schema is not this contract", "kind": "/kind is not a known kind", "field": "/bearing_sigma_deg is unknown", "bearing": "/bearing_deg is not in [0, 360)",
    "ellipse": "/position_uncertainty semi_minor_m is larger than semi_major_m", "psd": "/position_uncertainty covariance is not positive semi-definite", "dwell": "/dwell_s dwell_s is longer than revisit_s", "band": "/band min_hz is greater than max_hz",
}
_ISSUE_SQL = "CASE " + " ".join(f"WHEN flaw = '{f}' THEN '{text}'" for f, text in _ISSUE.items()) + " WHEN flaw = 'time' AND kind = 'coverage' THEN '/t_start or /t_end is not a UTC time' WHEN flaw = 'time' THEN '/t is not a UTC time' WHEN flaw = 'infinite' AND kind IN ('bearing', 'position') THEN '/freq_hz is not finite' WHEN flaw = 'infinite' THEN '/sensor_alt_m is not finite' END"


@query("reject_table", _WIRE + f"SELECT observation_id, CASE WHEN flaw = 'json' THEN NULL ELSE source_id END AS source_id, {_ISSUE_SQL} AS issue FROM j WHERE flaw <> 'ok'")
def reject_table(spark, sf_dir):
    """Rejected lines with what the record says of itself and every issue, one row each."""
    bad = _judged(spark, sf_dir).where(F.size("issues") > 0)
    return bad.select("observation_id", F.col("r.source_id").alias("source_id"), F.explode("issues").alias("issue"))


@query("record_stats", _WIRE + """SELECT source_id, count(*) FILTER (flaw = 'ok' AND kind = 'bearing') AS bearing, count(*) FILTER (flaw = 'ok' AND kind = 'position') AS position, count(*) FILTER (flaw = 'ok' AND kind = 'coverage') AS coverage, count(*) FILTER (flaw = 'ok' AND kind = 'occupancy') AS occupancy,
  count(*) FILTER (flaw <> 'ok') AS rejected, count(*) FILTER (flaw = 'ok' AND kind IN ('bearing', 'position')) AS accepted FROM j GROUP BY 1""")
def record_stats(spark, sf_dir):
    """Records of each kind by source; accepted are bearings and positions."""
    ok, kind = F.size("issues") == 0, F.col("r.kind")
    counts = [F.count_if(ok & (kind == k)).alias(k) for k in ("bearing", "position", "coverage", "occupancy")]
    return _judged(spark, sf_dir).groupBy("source_id").agg(*counts, F.count_if(~ok).alias("rejected"), F.count_if(ok & kind.isin("bearing", "position")).alias("accepted"))


@query("typed_records", _WIRE + "SELECT observation_id, kind, CASE WHEN kind IN ('bearing', 'position') THEN freq_hz END AS freq_hz, CASE WHEN kind = 'bearing' THEN (k * 37.5::DOUBLE) % 360 END AS bearing_deg, CASE WHEN kind = 'position' THEN 100.0::DOUBLE END AS ee, CASE WHEN kind = 'coverage' THEN 0.5::DOUBLE END AS listening, CASE WHEN kind IN ('coverage', 'occupancy') THEN 1.0 <= 1.5 END AS in_band FROM j WHERE flaw = 'ok'")
def typed_records(spark, sf_dir):
    """Each accepted line as the typed record of its kind."""
    r = lambda c: F.col(f"r.{c}")
    good = _judged(spark, sf_dir).where(F.size("issues") == 0)
    band = F.lit(1.5).between(r("band.min_hz"), r("band.max_hz"))
    return good.select("observation_id", r("kind").alias("kind"), r("freq_hz").alias("freq_hz"), r("bearing_deg").alias("bearing_deg"), r("position_uncertainty.cov_en_m2.ee").alias("ee"), (r("dwell_s") / r("revisit_s")).alias("listening"), band.alias("in_band"))


@query("arrival_order", _WIRE + "SELECT observation_id, row_number() OVER (ORDER BY CASE WHEN flaw = 'json' OR flaw = 'time' OR kind = 'coverage' THEN 0 ELSE t_us - t_us % 1000000 END, observation_id) AS place FROM j")
def arrival_order(spark, sf_dir):
    """The order in which a file's lines are delivered: those without a time first, none skipped, then by time and line."""
    judged = _judged(spark, sf_dir)
    second = F.when(F.col("r._corrupt").isNull(), F.try_to_timestamp("r.t").cast("long"))
    order = judged.select("observation_id", F.coalesce(second, F.lit(0)).alias("at"))
    # places by ranges: counts before each day, then ranks inside a day
    day = order.withColumn("day", F.floor(F.col("at") / 86400))
    counts = day.groupBy("day").count()
    before = counts.select("day", (F.sum("count").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # one row for each day
    rank = day.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy("at", "observation_id")))
    return rank.join(before, "day").select("observation_id", (F.coalesce("before", F.lit(0)) + F.col("rank")).alias("place"))


@query("normalise_positions", """, declared(source_id, sigma) AS (VALUES ('click', 150.0::DOUBLE), ('view', 80.0::DOUBLE))
SELECT observation_id, CASE WHEN fill THEN 'assumed' ELSE basis END AS basis, CASE WHEN fill THEN sigma * sigma WHEN basis <> 'unreported' THEN 900.0::DOUBLE + k * 10 END AS ee, CASE WHEN fill THEN 0.0 WHEN basis <> 'unreported' THEN 100.0::DOUBLE - k END AS en, CASE WHEN fill THEN sigma * sigma WHEN basis <> 'unreported' THEN 400.0::DOUBLE + k * 7 END AS nn, CASE WHEN fill THEN 'declared ' || source_id END AS note
FROM (SELECT obs.*, sigma, basis = 'unreported' AND sigma IS NOT NULL AS fill FROM obs LEFT JOIN declared USING (source_id))""")
def normalise_positions(spark, sf_dir):
    """Positions without a region take a circle of the source's declared error, with a note; reported ones stay."""
    k, reported = F.col("k"), F.col("basis") != "unreported"
    o = observations(spark, sf_dir).withColumns({"ee": F.when(reported, 900.0 + k * 10), "en": F.when(reported, 100.0 - k), "nn": F.when(reported, 400.0 + k * 7)})
    declared = spark.createDataFrame([("click", 150.0, "declared click"), ("view", 80.0, "declared view")], "source_id string, declared_sigma double, declared_note string")
    return ingest.normalise_positions(o, declared).select("observation_id", "basis", "ee", "en", "nn", "note")


@query("position_fixes", "SELECT observation_id AS fix_id, 'position' AS method, t_us, 50.0::DOUBLE + entity % 17 * 0.01 AS lat, 10.0::DOUBLE + entity % 13 * 0.01 AS lon, basis, CASE WHEN basis <> 'unreported' THEN 900.0::DOUBLE + k * 10 END AS ee, source_id || '=1' AS sources FROM obs WHERE k % 2 = 1")
def position_fixes(spark, sf_dir):
    """A reported position is a fix: its region is taken as it is."""
    return _position_fixes(observations(spark, sf_dir))


def _position_fixes(o):
    place = {"lat": 50.0 + F.col("entity") % 17 * 0.01, "lon": 10.0 + F.col("entity") % 13 * 0.01}
    region = F.when(F.col("basis") != "unreported", 900.0 + F.col("k") * 10)
    return o.where("k % 2 = 1").withColumns(place).select(F.col("observation_id").alias("fix_id"), F.lit("position").alias("method"), "t_us", "lat", "lon", "basis", region.alias("ee"), F.concat("source_id", F.lit("=1")).alias("sources"))


@query("union_of_fixes", """, b AS (SELECT min(observation_id) AS fix_id, 'bearing' AS method, max(t_us) AS t_us, avg(50.0::DOUBLE + entity % 17 * 0.01) AS lat, count(*) AS n FROM obs WHERE k % 2 = 0 GROUP BY entity, t_us // 3600000000),
p AS (SELECT observation_id AS fix_id, 'position' AS method, t_us, 50.0::DOUBLE + entity % 17 * 0.01 AS lat, 1 AS n FROM obs WHERE k % 2 = 1)
SELECT fix_id, method, t_us, round(lat, 6) AS lat, n::BIGINT AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM p)""")
def union_of_fixes(spark, sf_dir):
    """Fixes from bearings, and from positions, in one table."""
    o = observations(spark, sf_dir)
    lat = 50.0 + F.col("entity") % 17 * 0.01
    b = o.where("k % 2 = 0").groupBy("entity", F.floor(F.col("t_us") / 3_600_000_000).alias("hour")).agg(F.min("observation_id").alias("fix_id"), F.max("t_us").alias("t_us"), F.round(F.avg(lat), 6).alias("lat"), F.count("*").alias("n"))
    p = _position_fixes(o).select("fix_id", "method", "t_us", F.round("lat", 6).alias("lat"), F.lit(1).cast("long").alias("n"))
    return b.select("fix_id", F.lit("bearing").alias("method"), "t_us", "lat", "n").unionByName(p)


#: Fixed value: words that no text for people may use.
FORBIDDEN = r"\b(target\w*|strike\w*|engag\w*|kill\w*)\b"


@query("forbidden_words", f"""SELECT observation_id, len(found)::INTEGER AS n_words, array_to_string(found, ',') AS words FROM (
  SELECT observation_id, regexp_extract_all(CASE k % 6 WHEN 0 THEN 'Targets on the road, a STRIKE' WHEN 1 THEN 'engaging speech of a licensed source' WHEN 2 THEN 'overkill' WHEN 3 THEN 'skill and strikes; kills' ELSE 'a track of ' || source_id END, '(?i){FORBIDDEN}') AS found FROM obs)""")
def forbidden_words(spark, sf_dir):
    k = F.col("k") % 6
    text = F.when(k == 0, "Targets on the road, a STRIKE").when(k == 1, "engaging speech of a licensed source").when(k == 2, "overkill").when(k == 3, "skill and strikes; kills").otherwise(F.concat(F.lit("a track of "), F.col("source_id")))
    found = F.regexp_extract_all(text, F.lit(f"(?i){FORBIDDEN}"), F.lit(0))
    return observations(spark, sf_dir).select("observation_id", F.size(found).alias("n_words"), F.array_join(found, ",").alias("words"))


@query("band_listening", "SELECT observation_id, freq_hz BETWEEN 400100000 AND 400300000 AS in_band, CASE WHEN k % 10 < 8 THEN round((1.0::DOUBLE + k % 10) / (10.0::DOUBLE + k), 9) END AS listening FROM obs")
def band_listening(spark, sf_dir):
    """Whether a band holds a frequency, and the share of time that a scanning sensor listens: dwell over revisit, none where neither is stated."""
    k = F.col("k")
    dwell, revisit = F.when(k % 10 < 8, 1.0 + k % 10), F.when(k % 10 < 8, 10.0 + k)
    return observations(spark, sf_dir).select("observation_id", F.col("freq_hz").between(400100000, 400300000).alias("in_band"), F.round(dwell / revisit, 9).alias("listening"))


@query("restamp", "SELECT observation_id, CASE WHEN k % 17 = 0 THEN 'broken ' || k ELSE ((CASE WHEN k % 17 <> 0 THEN t_us END) - min(CASE WHEN k % 17 <> 0 THEN t_us END) OVER () + 1767225600000000)::VARCHAR END AS t FROM obs")
def restamp(spark, sf_dir):
    """All times moved so that the first is at the start; a broken time stays as it is."""
    o = observations(spark, sf_dir).withColumn("text", F.when(F.col("k") % 17 == 0, F.concat(F.lit("broken "), F.col("k").cast("string"))).otherwise(F.col("t_us").cast("string")))
    o = o.withColumn("at", F.expr("try_cast(text AS bigint)"))
    first = F.broadcast(o.agg(F.min("at").alias("t0")))  # one row
    moved = (F.col("at") - F.col("t0") + 1_767_225_600_000_000).cast("string")
    return o.join(first).select("observation_id", F.coalesce(moved, F.col("text")).alias("t"))


@query("adapt_detection", """SELECT observation_id, strftime(make_timestamp(t_us - t_us % 1000000), '%Y-%m-%dT%H:%M:%SZ') AS t, bearing_deg, 'measured' AS basis, sigma_deg, 'sigma relabelled' AS conversion FROM obs WHERE k % 20 <> 0 AND bearing_deg < 360 AND sigma_deg IS NOT NULL""")
def adapt_detection(spark, sf_dir):
    """Lines of another format: headers skipped, those without a bearing dropped, offsets written as Z, sigma relabelled, and only valid records kept."""
    return _adapted(spark, sf_dir).where("state = 'kept'").select("observation_id", "t", "bearing_deg", F.lit("measured").alias("basis"), "sigma_deg", F.lit("sigma relabelled").alias("conversion"))


@query("adapt_counts", "SELECT CASE WHEN k % 20 = 0 THEN 'header' WHEN bearing_deg >= 360 OR sigma_deg IS NULL THEN 'dropped' ELSE 'kept' END AS state, count(*) AS n FROM obs GROUP BY 1")
def adapt_counts(spark, sf_dir):
    return _adapted(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


def _adapted(spark, sf_dir):
    o = _flawed(spark, sf_dir)
    line = F.when(F.col("k") % 20 == 0, "# detections").otherwise(F.concat_ws(";", F.regexp_replace("t", "Z$", "+00:00"), F.when(F.col("bearing_deg") < 360, F.format_string("%.1f", "bearing_deg")).otherwise(""), F.coalesce(F.col("sigma_deg").cast("string"), F.lit(""))))
    p = o.withColumn("line", line).withColumn("p", F.split("line", ";"))
    at = lambda i: F.get("p", F.lit(i))
    p = p.withColumns({"t": F.regexp_replace(at(0), r"\+00:00$", "Z"), "bearing_deg": F.expr("try_cast(get(p, 1) AS double)"), "sigma_deg": F.expr("try_cast(get(p, 2) AS double)")})
    valid = F.col("bearing_deg").between(0, 360) & (F.col("bearing_deg") < 360) & F.col("sigma_deg").isNotNull() & F.try_to_timestamp("t").isNotNull()
    return p.withColumn("state", F.when(F.startswith("line", F.lit("#")), "header").when(F.coalesce(valid, F.lit(False)), "kept").otherwise("dropped"))


@query("emission_fuse", """SELECT entity, t_us // 86400000000 AS day, max(duration_s) AS duration_s, array_to_string(list_sort(list(DISTINCT 'h' || k % 3) FILTER (k % 5 = 0)), ',') AS hints, array_to_string(list_sort(list(DISTINCT 'ads_b:' || k % 2) FILTER (k % 7 = 0)), ',') AS claims, count(*) AS n FROM obs GROUP BY 1, 2""")
def emission_fuse(spark, sf_dir):
    """What the records of one fix say of an emission: the longest duration, and all hints and claims."""
    o = observations(spark, sf_dir)
    some = lambda c, when: F.array_sort(F.collect_set(F.when(when, c)))
    g = o.groupBy("entity", F.floor(F.col("t_us") / 86_400_000_000).alias("day")).agg(F.max("duration_s").alias("duration_s"), some(F.concat(F.lit("h"), (F.col("k") % 3).cast("string")), F.col("k") % 5 == 0).alias("h"), some(F.concat(F.lit("ads_b:"), (F.col("k") % 2).cast("string")), F.col("k") % 7 == 0).alias("c"), F.count("*").alias("n"))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return g.select("entity", "day", "duration_s", joined("h").alias("hints"), joined("c").alias("claims"), "n")


@query("feature_speed", """, m AS (SELECT entity, count(*) AS hits, (max(t_us) - min(t_us)) / 1e6 AS age_s, (entity * 31 % 23 - 11)::DOUBLE AS ve, (entity * 17 % 19 - 9)::DOUBLE AS vn, 4.0::DOUBLE + entity % 5 AS ee, 0.5::DOUBLE AS en, 3.0::DOUBLE + entity % 3 AS nn, 1 / (1.0::DOUBLE + entity % 9) AS mu0 FROM obs GROUP BY entity),
v AS (SELECT *, sqrt(ve * ve + vn * vn) AS speed FROM m)
SELECT entity, hits >= 60 AND age_s >= 30 AS ok, CASE WHEN hits >= 60 AND age_s >= 30 THEN round(speed, 6) END AS speed_mps, CASE WHEN hits >= 60 AND age_s >= 30 THEN round(sqrt(greatest(CASE WHEN speed > 0 THEN (ve * ve * ee + 2 * ve * vn * en + vn * vn * nn) / (speed * speed) ELSE (ee + nn) / 2 END, 0)), 6) END AS sigma_mps, CASE WHEN hits >= 60 AND age_s >= 30 THEN round(mu0, 9) END AS stationary FROM v""")
def feature_speed(spark, sf_dir):
    """Speed with its error along the motion, and the probability of staying put; for tracks of enough fixes and age (60 stands for 3)."""
    from lodestream.operators.features import speed

    m = observations(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("hits"), ((F.max("t_us") - F.min("t_us")) / 1e6).alias("age_s"))
    e = F.col("entity")
    m = m.withColumns({"ve": (e * 31 % 23 - 11).cast("double"), "vn": (e * 17 % 19 - 9).cast("double"), "ee": 4.0 + e % 5, "en": F.lit(0.5), "nn": 3.0 + e % 3, "mu0": 1 / (1.0 + e % 9)})
    ok = (F.col("hits") >= 60) & (F.col("age_s") >= 30)
    value, sigma = speed(*map(F.col, ("ve", "vn", "ee", "en", "nn")))
    only = lambda c: F.when(ok, c)
    return m.select("entity", ok.alias("ok"), only(F.round(value, 6)).alias("speed_mps"), only(F.round(sigma, 6)).alias("sigma_mps"), only(F.round("mu0", 9)).alias("stationary"))


@query("feature_height", "SELECT entity, height_m, sigma_m, n FROM (SELECT entity, 100.0::DOUBLE + k AS height_m, 5.0::DOUBLE + k % 3 AS sigma_m, 1 + k % 4 AS n, row_number() OVER (PARTITION BY entity ORDER BY t_us DESC, observation_id DESC) AS rn FROM obs WHERE k % 4 = 0 AND basis <> 'unreported') WHERE rn = 1")
def feature_height(spark, sf_dir):
    """The last height that has an error, and how many elevations it came from."""
    k = F.col("k")
    h = observations(spark, sf_dir).where("k % 4 = 0").select("entity", F.struct("t_us", "observation_id").alias("at"), (100.0 + k).alias("height_m"), F.when(F.col("basis") != "unreported", 5.0 + k % 3).alias("sigma_m"), (1 + k % 4).alias("n"))
    last = h.where("sigma_m is not null").groupBy("entity").agg(F.max_by(F.struct("height_m", "sigma_m", "n"), "at").alias("h"))
    return last.select("entity", "h.height_m", "h.sigma_m", "h.n")


@query("sorted_orders", "SELECT observation_id, row_number() OVER (PARTITION BY entity ORDER BY t_us, observation_id)::INTEGER AS by_time, row_number() OVER (PARTITION BY entity ORDER BY source_id, k % 3, bearing_deg, observation_id)::INTEGER AS by_sensor FROM obs")
def sorted_orders(spark, sf_dir):
    """The orders in which fixes are taken, and bearings of a group are solved."""
    w = Window.partitionBy("entity")
    return observations(spark, sf_dir).select("observation_id", F.row_number().over(w.orderBy("t_us", "observation_id")).alias("by_time"), F.row_number().over(w.orderBy("source_id", F.col("k") % 3, "bearing_deg", "observation_id")).alias("by_sensor"))


@query("corrections_diff", """, a AS (SELECT entity, 'confirm:' || min(source_id) AS c FROM obs WHERE k % 10 < 4 GROUP BY 1), b AS (SELECT entity, 'confirm:' || min(source_id) AS c FROM obs WHERE k % 10 BETWEEN 3 AND 5 GROUP BY 1)
SELECT coalesce(a.entity, b.entity) AS entity, CASE WHEN b.entity IS NULL THEN 'withdrawn' WHEN a.entity IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.entity = b.entity WHERE a.c IS DISTINCT FROM b.c""")
def corrections_diff(spark, sf_dir):
    """What a new version of the corrections adds, changes and withdraws."""
    from lodestream.operators.corrections import difference

    o = observations(spark, sf_dir)
    version = lambda cond: o.where(cond).groupBy("entity").agg(F.concat(F.lit("confirm:"), F.min("source_id")).alias("c"))
    return difference(version("k % 10 < 4"), version("k % 10 between 3 and 5"), "entity", "c")


@query("rotated_regions", "SELECT observation_id, round(ee + nn, 6) AS trace FROM (SELECT observation_id, 900.0::DOUBLE + k AS ee, 400.0::DOUBLE + k AS nn FROM obs)")
def rotated_regions(spark, sf_dir):
    """Regions turned by a fix's convergence keep their size."""
    ee, _, nn = G.rotate_covariance(900.0 + F.col("k"), F.lit(50.0), 400.0 + F.col("k"), F.col("bearing_deg"))
    return observations(spark, sf_dir).select("observation_id", F.round(ee + nn, 6).alias("trace"))


_PICTURE = """, p AS (SELECT CASE WHEN observation_id % 97 = 0 THEN observation_id - 1 ELSE observation_id END AS id, t_us AS first_us, t_us + CASE WHEN k % 17 = 0 THEN -1 ELSE 1000 END AS last_us, round(0.9 - k % 10 * 0.05, 2) AS confidence, CASE WHEN k % 4 = 0 THEN 0.6 ELSE 1.0 END AS bound,
  CASE k % 3 WHEN 0 THEN 'friend' WHEN 1 THEN 'neutral' ELSE 'hostile' END AS affiliation, '100' || CASE WHEN k % 13 = 0 THEN '1' ELSE CASE k % 3 WHEN 0 THEN '3' WHEN 1 THEN '4' ELSE '6' END END || '1000001100000000' AS code FROM obs)"""


@query("picture_issues", _PICTURE + """ SELECT id, issue FROM (SELECT id, unnest([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'id repeats' END, CASE WHEN last_us < first_us THEN 'last is before first' END, CASE WHEN confidence > bound THEN 'confidence is above its bound' END,
  CASE WHEN substr(code, 4, 1) <> CASE affiliation WHEN 'friend' THEN '3' WHEN 'neutral' THEN '4' ELSE '6' END THEN 'symbol is of another affiliation' END]) AS issue FROM p) WHERE issue IS NOT NULL""")
def picture_issues(spark, sf_dir):
    """What contradicts itself in a picture: ids, times, confidences, symbols."""
    o, k = observations(spark, sf_dir), F.col("k")
    affiliation = F.when(k % 3 == 0, "friend").when(k % 3 == 1, "neutral").otherwise("hostile")
    digit = lambda c: F.when(c == "friend", "3").when(c == "neutral", "4").otherwise("6")
    p = o.select(
        F.when(F.col("observation_id") % 97 == 0, F.col("observation_id") - 1).otherwise(F.col("observation_id")).alias("id"), F.col("t_us").alias("first_us"), (F.col("t_us") + F.when(k % 17 == 0, -1).otherwise(1000)).alias("last_us"),
        F.round(0.9 - k % 10 * 0.05, 2).alias("confidence"), F.when(k % 4 == 0, 0.6).otherwise(1.0).alias("bound"), affiliation.alias("affiliation"), F.concat(F.lit("100"), F.when(k % 13 == 0, "1").otherwise(digit(affiliation)), F.lit("1000001100000000")).alias("code"),
    )
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    checks = F.array(F.when(F.col("twice"), "id repeats"), F.when(F.col("last_us") < F.col("first_us"), "last is before first"), F.when(F.col("confidence") > F.col("bound"), "confidence is above its bound"), F.when(F.substring("code", 4, 1) != digit(F.col("affiliation")), "symbol is of another affiliation"))
    return p.withColumn("twice", twice).select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("issue"))
