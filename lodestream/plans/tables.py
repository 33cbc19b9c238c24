"""The driver's tables seen as observations, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def epoch_us(column: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    whole = F.unix_date(F.col(column).cast("date")).cast("long") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
    return whole * 1_000_000 + F.expr(f"cast(extract(SECOND FROM {column}) * 1000000 as bigint)")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark.read.parquet(f"{sf_dir}/events.parquet"))


def observed(e: DataFrame) -> DataFrame:
    """One observation per event, of a table or a stream of them."""
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("observation_id"),
        F.col("event_type").alias("source_id"),
        epoch_us("ts").alias("t_us"),
        F.col("user_id").alias("entity"),
        k.alias("k"),
        (F.lit(400e6) + F.pmod("user_id", F.lit(40)) * 12500.0).alias("freq_hz"),
        (12500.0 * (1 + k % 4)).alias("bandwidth_hz"),
        F.when(k % 17 == 0, 360.0).otherwise((k * 37.5) % 360).alias("bearing_deg"),
        F.when(k % 23 == 0, -F.col("value")).otherwise(F.col("value")).alias("duration_s"),
        F.when(k % 5 == 0, "unreported").when(k % 5 == 1, "assumed").otherwise("measured").alias("basis"),
        F.when((k % 5 == 0) & (k % 2 == 0), None).when((k % 5 == 0), 3.0).otherwise(1.0 + k % 3).alias("sigma_deg"),
    )


OBS = """WITH obs AS (
  SELECT event_id AS observation_id, event_type AS source_id, epoch_us(ts) AS t_us, user_id AS entity, k,
    400e6 + ((user_id % 40) + 40) % 40 * 12500.0::DOUBLE AS freq_hz, 12500.0::DOUBLE * (1 + k % 4) AS bandwidth_hz,
    CASE WHEN k % 17 = 0 THEN 360.0::DOUBLE ELSE (k * 37.5::DOUBLE) % 360 END AS bearing_deg,
    CASE WHEN k % 23 = 0 THEN -value ELSE value END AS duration_s,
    CASE WHEN k % 5 = 0 THEN 'unreported' WHEN k % 5 = 1 THEN 'assumed' ELSE 'measured' END AS basis,
    CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN NULL WHEN k % 5 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE + k % 3 END AS sigma_deg
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, obs: bool = True):
    """Register a query; ``sql`` goes on after the observations' CTE unless ``obs`` is false."""

    def put(f):
        REGISTRY[name] = (f, None if sql is None else OBS + sql if obs else sql)
        return f

    return put
