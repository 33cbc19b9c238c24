"""Operator corrections applied to classifications, and differences of their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were added, changed or withdrawn; those that stayed are not told."""
    old, new = before.select(key, F.col(value).alias("__old")), after.select(key, F.col(value).alias("__new"))
    change = F.when(F.col("__new").isNull(), "withdrawn").when(F.col("__old").isNull(), "added").when(F.col("__old") != F.col("__new"), "changed")
    return old.join(new, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def without_rejected(posterior: DataFrame, rejected: DataFrame, key: str = "entity") -> DataFrame:
    """Posteriors (key, class_id, p, p_bg) without the rejected classes (key, class_id), normalised again with the background."""
    kept = posterior.join(rejected, [key, "class_id"], "left_anti")
    total = F.sum("p").over(Window.partitionBy(key)) + F.col("p_bg")
    return kept.withColumns({"p": F.col("p") / total, "p_bg": F.col("p_bg") / total})
