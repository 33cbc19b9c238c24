"""Ingest: validation, rejects, dedupe, normalise, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import ingest
from lodestream.plans.tables import observations, query

_ISSUES = """, issues AS (
  SELECT *, list_sort(list_distinct(list_filter([
    CASE WHEN NOT (freq_hz > 0) THEN '/freq_hz is not above 0' END,
    CASE WHEN NOT (bearing_deg BETWEEN 0 AND 360) OR bearing_deg = 360 THEN '/bearing_deg is not in [0, 360)' END,
    CASE WHEN duration_s < 0 THEN '/duration_s is below 0' END,
    CASE WHEN basis = 'unreported' AND sigma_deg IS NOT NULL THEN '/bearing_uncertainty unreported with a sigma' END,
    CASE WHEN basis <> 'unreported' AND sigma_deg IS NULL THEN '/bearing_uncertainty sigma_deg is missing' END
  ], lambda x: x IS NOT NULL))) AS issues FROM obs
)"""
_DECLARED = [("click", 2.0), ("view", 4.0), ("purchase", 1.5)]


@query("validate_issues", _ISSUES + "SELECT observation_id, len(issues)::INTEGER AS n_issues, array_to_string(issues, '; ') AS issues FROM issues")
def validate_issues(spark, sf_dir):
    v = ingest.validate(observations(spark, sf_dir))
    return v.select("observation_id", F.size("issues").alias("n_issues"), F.array_join("issues", "; ").alias("issues"))


@query("reject_reasons_topk", _ISSUES + "SELECT reason, count(*) AS n, min(observation_id) AS first_seen FROM (SELECT unnest(issues) AS reason, observation_id FROM issues) GROUP BY 1 ORDER BY n DESC, first_seen, reason LIMIT 5")
def reject_reasons_topk(spark, sf_dir):
    return ingest.top_reasons(ingest.validate(observations(spark, sf_dir)), 5, "observation_id")


@query("reject_notices_first10", _ISSUES + """SELECT source_id, observation_id, notice FROM (
  SELECT source_id, observation_id, row_number() OVER (PARTITION BY source_id ORDER BY t_us, observation_id)::INTEGER AS notice FROM issues WHERE len(issues) > 0) WHERE notice <= 10""")
def reject_notices_first10(spark, sf_dir):
    rejected = ingest.validate(observations(spark, sf_dir)).where(F.size("issues") > 0)
    return ingest.first_notices(rejected, "source_id", ["t_us", "observation_id"], 10).select("source_id", "observation_id", "notice")


@query("reject_summary_60s", _ISSUES + "SELECT source_id, t_us - t_us % 60000000 AS window_us, count(*) AS n_rejected FROM issues WHERE len(issues) > 0 GROUP BY 1, 2")
def reject_summary_60s(spark, sf_dir):
    rejected = ingest.validate(observations(spark, sf_dir)).where(F.size("issues") > 0)
    return rejected.groupBy("source_id", (F.col("t_us") - F.col("t_us") % 60_000_000).alias("window_us")).agg(F.count("*").alias("n_rejected"))


@query("dedupe_first_valid", _ISSUES + """, doubled AS (
  SELECT *, 0 AS copy FROM issues UNION ALL SELECT *, 1 AS copy FROM issues WHERE k % 7 = 0)
SELECT observation_id, source_id, copy FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, observation_id ORDER BY t_us, copy) AS rn FROM doubled WHERE len(issues) = 0) WHERE rn = 1""")
def dedupe_first_valid(spark, sf_dir):
    v = ingest.validate(observations(spark, sf_dir))
    doubled = v.withColumn("copy", F.lit(0)).unionByName(v.where("k % 7 = 0").withColumn("copy", F.lit(1)))
    return ingest.first_valid(doubled, "source_id", "observation_id", order=[F.col("t_us"), F.col("copy")]).select("observation_id", "source_id", "copy")


@query("normalise_assumptions", """, declared(source_id, declared_sigma) AS (VALUES ('click', 2.0::DOUBLE), ('view', 4.0::DOUBLE), ('purchase', 1.5::DOUBLE))
SELECT observation_id, CASE WHEN fill THEN 'assumed' ELSE basis END AS basis, CASE WHEN fill THEN declared_sigma ELSE sigma_deg END AS sigma_deg, fill AS filled
FROM (SELECT obs.*, declared_sigma, basis = 'unreported' AND declared_sigma IS NOT NULL AS fill FROM obs LEFT JOIN declared USING (source_id))""")
def normalise_assumptions(spark, sf_dir):
    declared = spark.createDataFrame(_DECLARED, "source_id string, declared_sigma double")
    return ingest.normalise(observations(spark, sf_dir), declared).select("observation_id", "basis", "sigma_deg", "filled")


@query("basis_combine", """SELECT entity, CASE WHEN count(*) FILTER (basis = 'unreported') > 0 THEN 'unreported'
  WHEN count(*) FILTER (basis = 'measured') > 0 AND count(*) FILTER (basis = 'assumed') > 0 THEN 'mixed' ELSE max(basis) END AS basis, count(*) AS n FROM obs GROUP BY entity""")
def basis_combine(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("entity").agg(ingest.combined_basis("basis").alias("basis"), F.count("*").alias("n"))


@query("source_stats", _ISSUES + """SELECT source_id, count(*) AS n, count(*) FILTER (len(issues) = 0) AS accepted, count(*) FILTER (len(issues) > 0) AS rejected,
  count(*) FILTER (len(issues) = 0 AND basis = 'assumed') AS assumed, count(*) FILTER (len(issues) = 0 AND basis = 'unreported') AS unreported FROM issues GROUP BY 1""")
def source_stats(spark, sf_dir):
    v, ok = ingest.validate(observations(spark, sf_dir)), F.size("issues") == 0
    return v.groupBy("source_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(ok & (F.col("basis") == "assumed")).alias("assumed"), F.count_if(ok & (F.col("basis") == "unreported")).alias("unreported")
    )


@query("notes_once", "SELECT source_id, basis AS code, min(t_us) AS first_us FROM obs WHERE basis <> 'measured' GROUP BY 1, 2")
def notes_once(spark, sf_dir):
    return observations(spark, sf_dir).where("basis <> 'measured'").groupBy("source_id", F.col("basis").alias("code")).agg(F.min("t_us").alias("first_us"))


@query("text_format", """SELECT observation_id, CASE WHEN freq_hz >= 1e9 THEN printf('%.4f GHz', freq_hz / 1e9) WHEN freq_hz >= 1e6 THEN printf('%.4f MHz', freq_hz / 1e6) ELSE printf('%.4f kHz', freq_hz / 1e3) END AS freq,
  CASE WHEN duration_s >= 3600 THEN printf('%.6f h', duration_s / 3600) WHEN duration_s >= 60 THEN printf('%.6f min', duration_s / 60) ELSE printf('%.6f s', duration_s) END AS duration, source_id || ':' || entity AS sensor FROM obs""")
def text_format(spark, sf_dir):
    f, d = F.col("freq_hz"), F.col("duration_s")
    fmt = lambda p, x: F.format_string(p, x)
    return observations(spark, sf_dir).select(
        "observation_id",
        F.when(f >= 1e9, fmt("%.4f GHz", f / 1e9)).when(f >= 1e6, fmt("%.4f MHz", f / 1e6)).otherwise(fmt("%.4f kHz", f / 1e3)).alias("freq"),
        F.when(d >= 3600, fmt("%.6f h", d / 3600)).when(d >= 60, fmt("%.6f min", d / 60)).otherwise(fmt("%.6f s", d)).alias("duration"),
        F.concat_ws(":", "source_id", F.col("entity").cast("string")).alias("sensor"),
    )


@query("text_clip", "SELECT doc_id, CASE WHEN length(t) > 600 THEN left(t, 599) || '…' ELSE t END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM documents)", obs=False)
def text_clip(spark, sf_dir):
    t = F.btrim(F.regexp_replace("text", r"[ \t\n\r]+", " "))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.length(t) > 600, F.concat(F.left(t, F.lit(599)), F.lit("…"))).otherwise(t).alias("clipped"))


@query("sidc_identity", """SELECT entity, substr(code, 4, 1) AS identity, substr(code, 1, 3) || '4' || substr(code, 5) AS as_neutral FROM (SELECT DISTINCT entity, '100' || (entity % 7)::VARCHAR || '1000001100000000' AS code FROM obs)""")
def sidc_identity(spark, sf_dir):
    code = F.concat(F.lit("100"), (F.col("entity") % 7).cast("string"), F.lit("1000001100000000"))
    ids = observations(spark, sf_dir).select("entity").distinct().withColumn("code", code)
    return ids.select("entity", F.substring("code", 4, 1).alias("identity"), F.overlay("code", F.lit("4"), 4).alias("as_neutral"))


@query("run_summary", "SELECT source_id, basis, count(*) AS n, grouping(source_id, basis)::BIGINT AS level FROM obs GROUP BY GROUPING SETS ((source_id, basis), (source_id), ())")
def run_summary(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.groupingSets([["source_id", "basis"], ["source_id"], []], "source_id", "basis").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
