"""Exact deduplication with a heavy-hitter split.

1. A Misra-Gries summary (Spark's ``freqItems``, the Karp-Shenker-Papadimitriou
   form of it) of at most ``1 / support`` counters finds every digest that more
   than ``support`` of the rows share.
2. The candidates are counted exactly, with map-side partial aggregation, which also
   finds the row that stays. Those that are frequent are the verified winners: at
   most ``1 / support`` rows, so broadcasting them has a proven bound.
3. Rows of a winner are resolved on the map side and never shuffle. All other rows
   shuffle by digest; no such group holds more than ``support`` of the rows.

Defined results: null text counts as empty text; an empty table gives no rows; rows
with a null id count in ``group_size`` and stay only if all ids are null; where the
largest id repeats within a group of equal texts, one of these rows stays, hot groups
included. Columns besides the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, checkpoint, fresh_name, sha60, text_of

SUPPORT = 0.001


def _groups(rows: DataFrame, support: float) -> DataFrame:
    """``rows`` (id, digest, k, r: a number of the row's own) with keep_id, group_size and kept."""
    total = rows.count()
    candidates = rows.stat.freqItems(["k"], support).select(F.explode("k_freqItems").alias("k"))
    best = F.max(F.struct("id", "r"))  # a null id is below all others
    counted = (
        rows.join(F.broadcast(candidates), "k", "left_semi")
        .groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= max(2, support * total))
    )
    winners = F.broadcast(checkpoint(counted.select("digest", F.col("best.id").alias("keep_id"), F.col("best.r").alias("keep_r"), "group_size")))

    hot = rows.join(winners, "digest").select("id", "r", "keep_id", "group_size", (F.col("r") == F.col("keep_r")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    cold = rows.join(winners, "digest", "left_anti").select(
        "id",
        "r",
        F.max("id").over(group).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.desc_nulls_last("id"), F.desc("r"))) == 1).alias("kept"),
        "digest",
    )
    return hot.unionByName(cold)


def _keyed(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    sha = F.sha2(text_of(text_col), 256)
    return docs.select(F.col(id_col).alias("id"), sha.alias("sha"), row.alias("r")).select("id", F.unhex("sha").alias("digest"), sha60(F.col("sha")).alias("k"), "r")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary SHA-256)."""
    return _groups(checkpoint(_keyed(docs, id_col, text_col, F.monotonically_increasing_id())), support).drop("r")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows whose ids repeat are judged each by its own text."""
    key = fresh_name("__row", docs)
    numbered = Scratch(docs.sparkSession).keep(docs.withColumn(key, F.monotonically_increasing_id()))
    keep = _groups(checkpoint(_keyed(numbered, id_col, text_col, F.col(key))), support).where("kept").select(F.col("r").alias(key))
    return numbered.join(keep, key, "left_semi").select(*docs.columns)
