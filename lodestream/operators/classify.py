"""Classification of features against a library of classes: log-likelihood ratios, posteriors, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import geo_sql as G

#: What a category says, the clip of one ratio, the floor of a probability, the weight without coverage, tempering, the background's prior.
MATCH, MISS, CLIP, FLOOR, UNREPORTED, TEMPERING, BACKGROUND = 0.9, 0.1, 6.0, 1e-3, 0.5, 0.8, 0.5
#: Features on a decimal scale, features that measure one thing, and soft edges where none is stated.
SCALE, MOTION, SOFT_LOG, SOFT_SHARE = ("freq_hz", "bandwidth_hz", "duration_s", "period_s"), ("speed_mps", "stationary"), 0.02, 0.05


def _scaled(value: Column, is_scale: Column) -> Column:
    return F.when(is_scale, F.log10(F.greatest(value, F.lit(1e-12)))).otherwise(value)


def contributions(features: DataFrame, library: DataFrame, key: str = "entity") -> DataFrame:
    """key, class_id, feature and llr. ``features``: key, feature, value, sigma, basis, categories, one row for each usable one;
    ``library``: class_id, feature, low, high, soft, b_low, b_high (range and background), want (a probability), any_of (categories), weight."""
    both = features.join(F.broadcast(library), "feature")  # a library is a file of an operator
    is_scale = F.col("feature").isin(*SCALE)
    by_basis = F.when(F.col("basis") == "unreported", UNREPORTED).otherwise(1.0)
    q = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), F.col("value")))
    chance = F.log((q * F.col("want") + (1 - q) * (1 - F.col("want"))) / 0.5) * by_basis
    category = F.log(F.when(F.arrays_overlap("categories", "any_of"), MATCH).otherwise(MISS) / 0.5) * F.col("weight")
    x, scaled_sigma = G.log_scale(F.col("value"), F.col("sigma"))
    x, sigma = F.when(is_scale, x).otherwise(F.col("value")), F.when(is_scale, scaled_sigma).otherwise(F.coalesce("sigma", F.lit(0.0)))
    low, high, b_low, b_high = (_scaled(F.col(c), is_scale) for c in ("low", "high", "b_low", "b_high"))
    placed = both.withColumns({"__x": x, "__s": sigma, "__l": low, "__h": high, "__bl": b_low, "__bh": b_high})
    soft = F.coalesce("soft", F.when(is_scale, SOFT_LOG).otherwise(SOFT_SHARE * F.greatest(F.col("__h") - F.col("__l"), F.lit(1e-9))))
    placed = placed.withColumn("__soft", soft)
    like = lambda lo, hi: G.range_likelihood(F.col("__x"), F.col("__s"), F.col(lo), F.col(hi), F.col("__soft"))
    ratio = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.log(like("__l", "__h") / like("__bl", "__bh")))) * by_basis * F.col("weight")
    llr = F.when(F.col("want").isNotNull(), chance).when(F.col("any_of").isNotNull(), category).when(F.col("b_low").isNotNull(), ratio)
    found = placed.select(key, "class_id", "feature", llr.alias("llr")).where("llr is not null")
    # what measures one thing has one vote
    motion = F.col("feature").isin(*MOTION)
    votes = F.count_if(motion).over(Window.partitionBy(key, "class_id"))
    return found.select(key, "class_id", "feature", F.when(motion, F.avg(F.when(motion, F.col("llr"))).over(Window.partitionBy(key, "class_id")) / votes).otherwise(F.col("llr")).alias("llr"))


def posterior(contributions: DataFrame, leaves: DataFrame, usable: DataFrame, key: str = "entity", least: int = 2) -> DataFrame:
    """key, class_id, score, p and p_bg over all leaves (class_id, prior) of the keys with ``least`` usable features (``usable``: key, n)."""
    enough = usable.where(F.col("n") >= least).select(key)
    every = enough.join(F.broadcast(leaves))  # the library's leaves
    scores = every.join(contributions.groupBy(key, "class_id").agg(F.sum("llr").alias("sum")), [key, "class_id"], "left")
    s = scores.withColumn("score", TEMPERING * F.coalesce("sum", F.lit(0.0)))
    w = Window.partitionBy(key)
    z = s.withColumn("top", F.greatest(F.max("score").over(w), F.lit(0.0)))
    z = z.withColumns({"mass": F.col("prior") * F.exp(F.col("score") - F.col("top")), "rest": BACKGROUND * F.exp(-F.col("top"))})
    total = F.sum("mass").over(w) + F.col("rest")
    return z.select(key, "class_id", "score", (F.col("mass") / total).alias("p"), (F.col("rest") / total).alias("p_bg"))
