"""Cutting a line of values where neighbours are far apart: channel islands and runs in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(rows: DataFrame, value: str, gap: float, name: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` with a number ``name`` that rises (for each ``by``) wherever the next value is more than ``gap`` on.

    Values are counted in bins as wide as the gap, inside of which nothing can be cut; only the
    bins' ends are put in order. So what one task orders is bounded by the span of the values
    over the gap, not by the rows.
    """
    keys = by or []
    bin_ = F.floor(F.col(value) / gap)
    ends = rows.groupBy(*keys, bin_.alias("__bin")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    order = Window.partitionBy(*keys).orderBy("__bin")
    new = F.coalesce((F.col("__low") - F.lag("__high").over(order) > gap).cast("long"), F.lit(0))
    numbered = ends.withColumn("__new", new).select(*keys, "__bin", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(name))
    return rows.withColumn("__bin", bin_).join(numbered, [*keys, "__bin"]).drop("__bin")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by their keys over several tasks a core, which are not put together again for being small: what they do is heavy."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
