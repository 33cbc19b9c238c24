"""Fixes from all bearings of a table."""

from pyspark.sql import functions as F

from lodestream.plans import catalog, sequential_queries
from lodestream.plans.tables import observations

SF = "/root/testdata/sf0.001"


def test_every_bearing_is_in_a_fix(spark):
    o = observations(spark, SF)
    made = catalog.queries()["bearing_fix"](spark, SF).toPandas()
    one = made.drop_duplicates("group_id")
    assert one["n_bearings"].sum() == o.count()
    cycles = sequential_queries._cycles(o)
    assert cycles.count() == o.count()
    assert cycles.groupBy("group_id").agg(F.count_distinct("source_id").alias("a"), F.count("*").alias("b"), F.count_distinct("entity").alias("c")).where("a <> b or c <> 1").count() == 0


def test_cochannel_split_gives_both_emitters(spark):
    o = observations(spark, SF)
    made = catalog.queries()["cochannel_split"](spark, SF).toPandas()
    assert made.drop_duplicates("group_id")["n_bearings"].sum() == 2 * o.count()
    split = made[made["reason"].isna()]
    assert len(split) and (split.groupby("group_id").size() == 2).all()
