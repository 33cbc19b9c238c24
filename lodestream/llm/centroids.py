"""Centroid clustering of vectors with integer components, exact to the last bit.

Every round assigns each vector to its nearest centroid and moves the centroids to the
floor of their vectors' mean. Distances are screened in float32: one matrix product gives
the dot products of a batch of vectors with all centroids, and a bound on the rounding
error of such a product (which holds for every order of summation) makes an interval of
each distance. Where one interval lies below all others, that centroid is the nearest;
where intervals overlap, the distances to the centroids in question are computed again in
integers, and of equally near ones the lowest number wins.

A round is one scan without a shuffle of vectors: a task keeps one count and one sum a
centroid and component, and Spark adds these up. They are carried in parts of ``LIMB``
bits as decimals, so no sum can overflow. On the driver and in broadcasts are only the centroids
(k times ``dimensions`` integers).

Defined results: vectors that are null, of another length, or with a null, NaN or infinite
component are not kept, and have no row. Rows that repeat are vectors of their own. A null
id is hashed like an empty one; where ids repeat, the vector with the lesser components
comes first. With fewer vectors than k there are as many centroids; an empty table gives no
rows. Components of any size are handled exactly (above ``FAST`` in Python's integers); a
distance or sum that a long cannot hold is null. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are multiplied by it before they are rounded down.
SCALE = 1024
#: Up to this magnitude squared distances of 64 components surely fit in 64 bits.
FAST = 1 << 27
LIMB = 48
_LONG = 1 << 63

SCHEMA = "vec_id long, cluster int, distance long"


def _scaled(value: float) -> int:
    """Exactly floor(SCALE * value), also where the product has no double."""
    top, bottom = value.as_integer_ratio()
    return top * SCALE // bottom


def vectors_of(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept, and their components: int64, or Python's integers where one is above FAST."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dimensions)
    flat = column.take(pa.array(rows)).flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    kept = np.isfinite(values).all(axis=1)
    rows, values = rows[kept], values[kept]
    if not len(values) or np.abs(values).max() < FAST // SCALE:
        return rows, np.floor(values * SCALE).astype(np.int64)
    whole = np.empty(values.shape, object)
    whole[:] = [[_scaled(x) for x in v] for v in values.tolist()]
    return rows, whole


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    return ((vectors - centroids) ** 2).sum(axis=1)


class Screen:
    """Centroids prepared for screening."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.exact = np.array(centroids, object).reshape(len(centroids), -1)
        self.fast = not self.exact.size or max(abs(int(x)) for x in self.exact.ravel()) <= FAST
        if self.fast:
            whole = self.exact.astype(np.int64)
            self.exact, self.single = whole, whole.astype(np.float32)
            self.squares = (whole * whole).sum(axis=1).astype(np.float64)
            self.norms = np.sqrt(self.squares)

    def intervals(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, less the square of the vector itself.

        With u = 2^-24, a float32 sum of n products errs by n u / (1 - n u) times the sum of
        the products' magnitudes at most; rounding both factors to float32 adds two more u, and
        by Cauchy-Schwarz that sum is at most the product of the norms. Four u more than
        needed and a relative 2^-40 cover the float64 arithmetic on top.
        """
        n = vectors.shape[1] + 6
        u = 2.0**-24
        dots = (vectors.astype(np.float32) @ self.single.T).astype(np.float64)
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        error = 2 * n * u / (1 - n * u) * norms[:, None] * self.norms
        middle = self.squares - 2 * dots
        error = error * (1 + 2.0**-40) + 2.0**-40 * (self.squares + 2 * np.abs(dots))
        return middle - error, middle + error

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Number of each vector's nearest centroid."""
        if vectors.dtype == object or not self.fast:
            each = np.stack([squared(vectors.astype(object), c) for c in self.exact.astype(object)], axis=1)
            return np.argmin(each, axis=1)
        low, high = self.intervals(vectors)
        possible = low <= high.min(axis=1)[:, None]
        nearest = np.argmax(possible, axis=1)
        rows, numbers = np.nonzero(possible & (possible.sum(axis=1) > 1)[:, None])
        if len(rows):
            exact = squared(vectors[rows], self.exact[numbers])
            order = np.lexsort((numbers, exact, rows))
            first = order[np.concatenate(([True], np.diff(rows[order]) > 0))]
            nearest[rows[first]] = numbers[first]
        return nearest


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, at = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield at, sign * (value & ((1 << LIMB) - 1))
        value, at = value >> LIMB, at + 1


def _sums(vectors: DataFrame, centroids: list[list[int]], dimensions: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Of each centroid: how many vectors it has, the sums of their components, and of their squared distances."""
    k = len(centroids)

    def run(batches):
        screen = Screen(centroids)
        counts, totals, inertia = [0] * k, [[0] * dimensions for _ in range(k)], [0] * k
        for batch in batches:
            _, found = vectors_of(batch.column(0), dimensions)
            nearest = screen.assign(found)
            for j in np.unique(nearest).tolist():
                own = found[nearest == j]
                counts[j] += len(own)
                totals[j] = [a + int(b) for a, b in zip(totals[j], own.sum(axis=0), strict=True)]
                inertia[j] += sum(map(int, squared(own, screen.exact[j])))
        rows = [(j, at, limb, part) for j in range(k) for at, value in enumerate([*totals[j], counts[j], inertia[j]]) for limb, part in _limbs(value)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["cluster", "at", "limb", "part"])

    parts = vectors.mapInArrow(run, "cluster long, at long, limb long, part long")
    out = [[0] * (dimensions + 2) for _ in range(k)]
    for row in parts.groupBy("cluster", "at", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():  # some k * (dimensions + 2) rows
        out[row["cluster"]][row["at"]] += int(row["part"]) << (LIMB * row["limb"])
    return [x[dimensions] for x in out], [x[:dimensions] for x in out], [x[dimensions + 1] for x in out]


def _kept(vectors: DataFrame, vector_col: str, dimensions: int) -> DataFrame:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where((F.size(vector_col) == dimensions) & finite)


def first_centroids(vectors: DataFrame, k: int, seed: int, id_col: str, vector_col: str, dimensions: int) -> list[list[int]]:
    """The k vectors with the least sha256 of ``seed:id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    chosen = _kept(vectors, vector_col, dimensions).select(digest.alias("digest"), F.col(vector_col).cast("array<double>").alias("v")).orderBy("digest", "v").limit(k)
    return [[_scaled(x) for x in row["v"]] for row in chosen.collect()]


def _long(value: int) -> int | None:
    return value if -_LONG <= value < _LONG else None


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    source = vectors.select(F.col(vector_col).alias("v"))
    centroids = first_centroids(vectors, k, seed, id_col, vector_col, dimensions)
    for _ in range(rounds if centroids else 0):
        counts, totals, _ = _sums(source, centroids, dimensions)
        centroids = [[t // n for t in total] if n else old for n, total, old in zip(counts, totals, centroids, strict=True)]
    inertia = _sums(source, centroids, dimensions)[2] if centroids else []
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches):
        screen = Screen(centroids) if centroids else None
        for batch in batches:
            rows, found = vectors_of(batch.column(1), dimensions)
            nearest = screen.assign(found) if screen else np.empty(0, np.int64)
            away = squared(found, screen.exact[nearest]) if len(nearest) else np.empty(0, np.int64)
            away = pa.array(away if away.dtype != object else [_long(int(x)) for x in away], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[: len(nearest)])), pa.array(nearest.astype(np.int32)), away], ["vec_id", "cluster", "distance"])

    placed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, SCHEMA)
    own = F.element_at(F.array(*[F.lit(_long(x)).cast("long") for x in inertia] or [F.lit(None).cast("long")]), F.col("cluster") + 1)
    digest = F.element_at(F.array(*[F.lit(x) for x in digests] or [F.lit(None).cast("string")]), F.col("cluster") + 1)
    return placed.select("*", own.alias("cluster_inertia"), F.lit(_long(sum(inertia))).cast("long").alias("inertia"), digest.alias("centroid_sha256"))


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64) -> str:
    """DuckDB SQL over ``embeddings`` for what ``cluster`` returns; a round is two tables."""
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dimensions}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), c) - 1 AS cluster, c FROM v QUALIFY cluster < {k}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v.c, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT v.r, v.vec_id, v.c, cluster, list_sum(list_transform(list_zip(v.c, t.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{i} t) v
  GROUP BY r, vec_id, v.c
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT t.cluster, coalesce(m.c, t.c) AS c FROM c{i} t LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c
    FROM (SELECT cluster, p, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(c) AS x, generate_subscripts(c, 1) AS p FROM a{i}) GROUP BY cluster, p) GROUP BY cluster
  ) m ON m.cluster = t.cluster
)""")
    return (
        ", ".join(steps)
        + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(t.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} t ON t.cluster = a.cluster
"""
    )
