"""Validation, deduplication and normalisation of observations.

Everything is a projection, a window on the record's key or a broadcast look-up of the
operator's declarations, so a batch needs one shuffle (by record key) at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule(broken: Column, path: str, message: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.concat(F.lit(path + " "), F.lit(message)))


def issues(*rules: Column) -> Column:
    """Sorted, distinct texts of the broken rules."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*rules), lambda r: r.isNotNull())))


def observation_rules() -> list[Column]:
    """Range and consistency rules of a bearing observation."""
    return [
        rule(F.col("freq_hz").isNull() | ~(F.col("freq_hz") > 0) | F.isnan("freq_hz"), "/freq_hz", "is not above 0"),
        rule(~F.col("bearing_deg").between(0, 360) | (F.col("bearing_deg") == 360), "/bearing_deg", "is not in [0, 360)"),
        rule(F.col("duration_s") < 0, "/duration_s", "is below 0"),
        rule((F.col("basis") == "unreported") & F.col("sigma_deg").isNotNull(), "/bearing_uncertainty", "unreported with a sigma"),
        rule((F.col("basis") != "unreported") & F.col("sigma_deg").isNull(), "/bearing_uncertainty", "sigma_deg is missing"),
    ]


def validate(obs: DataFrame) -> DataFrame:
    return obs.withColumn("issues", issues(*observation_rules()))


def first_valid(validated: DataFrame, *key: str, order: list[Column]) -> DataFrame:
    """The first accepted record of each key; rejected ones never take a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return validated.where(F.size("issues") == 0).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def normalise(obs: DataFrame, declared: DataFrame) -> DataFrame:
    """Fill an unreported sigma from the source's declaration, and say so; never touch a reported one."""
    fill = (F.col("basis") == "unreported") & F.col("declared_sigma").isNotNull()
    joined = obs.join(F.broadcast(declared), "source_id", "left")  # one row per configured source
    return joined.select(
        *[c for c in obs.columns if c not in ("basis", "sigma_deg")],
        F.when(fill, F.lit("assumed")).otherwise(F.col("basis")).alias("basis"),
        F.when(fill, F.col("declared_sigma")).otherwise(F.col("sigma_deg")).alias("sigma_deg"),
        fill.alias("filled"),
    )


def combined_basis(basis: str | Column) -> Column:
    """Aggregate: any unreported makes all unreported; measured and assumed are mixed."""
    b = F.col(basis) if isinstance(basis, str) else basis
    return (
        F.when(F.count_if(b == "unreported") > 0, "unreported")
        .when((F.count_if(b == "measured") > 0) & (F.count_if(b == "assumed") > 0), "mixed")
        .otherwise(F.max(b))
    )


def top_reasons(validated: DataFrame, k: int, order: str) -> DataFrame:
    """The k most frequent issues; of equal counts the first seen comes first."""
    each = validated.select(F.explode("issues").alias("reason"), order)
    return each.groupBy("reason").agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen", "reason").limit(k)


def first_notices(rejected: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rejections of each source."""
    w = Window.partitionBy(key).orderBy(*order)
    return rejected.withColumn("notice", F.row_number().over(w)).where(F.col("notice") <= most)


def normalise_positions(obs: DataFrame, declared: DataFrame) -> DataFrame:
    """Positions (basis, ee, en, nn) without a region take a circle of the declared error and the declaration's note; never a reported one."""
    fill = (F.col("basis") == "unreported") & F.col("declared_sigma").isNotNull()
    joined = obs.join(F.broadcast(declared), "source_id", "left")  # one row per configured source
    var = F.col("declared_sigma") * F.col("declared_sigma")
    return joined.select(
        *[c for c in obs.columns if c not in ("basis", "ee", "en", "nn")],
        F.when(fill, F.lit("assumed")).otherwise(F.col("basis")).alias("basis"),
        F.when(fill, var).otherwise(F.col("ee")).alias("ee"),
        F.when(fill, 0.0).otherwise(F.col("en")).alias("en"),
        F.when(fill, var).otherwise(F.col("nn")).alias("nn"),
        F.when(fill, F.col("declared_note")).alias("note"),
    )
