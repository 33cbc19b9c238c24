"""Connected components: bounded shares of the edges are contracted first, then alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import checkpoint, few

#: Edges of a share; a task that holds four times as many hands on what it has.
EDGES = 1 << 18


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbered nodes the least one that the edges reach."""
    label = np.arange(n)
    while (label[u] != label[v]).any():
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up
    return label


def _forest(edges: pa.Table) -> pa.RecordBatch:
    """(u, v) for every node u of the edges but the least of its component, v."""
    nodes = pa.concat_arrays([c for name in ("u", "v") for c in edges.column(name).chunks])
    fields = nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes]
    names = [str(i) for i in range(len(fields))]
    order = pa.compute.sort_indices(pa.table(fields, names), sort_keys=[(x, "ascending") for x in names]).to_numpy()
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (f.to_numpy(zero_copy_only=False)[order] for f in fields)], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first, half = order[new], len(order) // 2
    label = least_labels(number[:half], number[half:], len(first))
    u = np.flatnonzero(label != np.arange(len(first)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(first[u])), nodes.take(pa.array(first[label[u]]))], ["u", "v"])


def contracted(edges: DataFrame, shares: int) -> DataFrame:
    """A forest of each share of the edges, which links what the edges link; of one share it is the answer of ``stars``."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= 4 * EDGES:
                yield _forest(pa.Table.from_batches(held))
                held = []
        if held:
            yield _forest(pa.Table.from_batches(held))

    return edges.coalesce(shares).mapInArrow(run, edges.schema)


def stars(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """(u, v) for every node u with an edge but the least of its component, v; input columns u and v of an ordered type. Few edges are kept in ``partitions`` at most.

    Edges of one share need no round. In a round neighbours are reduced to their least by
    partial aggregation, so a node of very high degree does not gather its neighbours in
    one task; each round ends in a checkpoint.
    """
    held = checkpoint(few(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), partitions))
    shares = 1 + held.count() // EDGES
    held = checkpoint(contracted(held, shares))
    if shares == 1:
        return held
    state = _digest(held)
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        held = checkpoint(small.where("u <> v").distinct())
        now = _digest(held)
        if now == state:
            return held
        state = now
