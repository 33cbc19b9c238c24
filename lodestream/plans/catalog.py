"""The engine's named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestream.plans import classify_queries, feature_queries, inference_queries, ingest_queries, map_queries, matching_queries, record_queries, scalar_queries, sequential_queries, stream_queries, tracking_queries  # noqa: F401  they register their queries
from lodestream.plans.tables import REGISTRY

FLAGSHIP = "source_stats"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
