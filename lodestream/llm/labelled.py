"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and labels (0 or 1) of at most ``per_class`` documents of each label, none of the held-out fold.

    Ids are taken in the order of a hash, so a sample is the same on every run; an id
    that is labelled both ways is left out, and of documents that share an id the greatest text is used.
    """
    known = (
        labels.where(F.col(target).isin(0, 1) & (fold(F.col(id_col), folds) != held_out))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(target).alias("label"), F.max(target).alias("other"))
        .where("label = other")
    )
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).select("id", "label").orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), "id long, label int")  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    one = texts.groupBy("id").agg(F.max("text").alias("text"), F.first("label").alias("label"))  # an id that repeats comes to the driver once
    rows = {r["id"]: (r["text"], r["label"]) for r in one.collect()}
    ordered = [rows[i] for i in sorted(rows)]
    return [t for t, _ in ordered], [y for _, y in ordered]
