"""Clustering around centroids in whole numbers, by a tournament of bisectors.

Vectors become whole numbers first, so every sum, mean and distance is exact and
a result does not depend on the order of rows or on machines. For each pair of
centroids ``i < j`` the bisector's normal ``2 (cj - ci)`` and threshold
``|cj|^2 - |ci|^2`` are computed once a round: a vector is nearer to ``j`` only if
its inner product with the normal is above the threshold, and zero favours the
smaller number. ``k - 1`` such sign tests, the winner so far against the next
centroid, leave the nearest one; its distance is then computed exactly.

A round sends each task ``k`` centroids and takes ``k`` counts and sums of
components from it, added up by Spark; the driver holds ``k`` rows. Vectors are
written once as whole numbers and never shuffled.

Defined results: a vector that is null, of another width, or holds a null or
non-finite component is left out, and so is one with a component beyond
``MOST_NUMBER`` after scaling (its squared distance may not fit a long). Seeds
come by the hash of the id (null as an empty text), then by the numbers, so rows
equal in id are ordered and equal rows may seed equal centroids; the larger number
of such a pair stays empty and is kept as it is. With fewer rows than ``k`` each
is a seed. Rows equal in every column stay rows of their own; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.llm.batches import table
from tablesteward.session import materialize, spread

# Production settings.
WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
# Largest whole number of a component: products of two vectors of up to 2^8 components then fit a long.
MOST_NUMBER = 1 << 26
MOST_WIDTH = 1 << 8
# Rows tested at once.
SLICE_ROWS = 8192


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str, width: int, scale: int) -> DataFrame:
    """``id, numbers`` of the rows that take part."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < MOST_NUMBER))
    kept = rows.where(F.coalesce((F.size("vector") == width) & finite, F.lit(False)))
    return kept.select("id", F.transform("vector", lambda x: F.floor(x * scale).cast("int")).alias("numbers"))


def seeds(rows: DataFrame, count: int, seed: int) -> np.ndarray:
    """The numbers of the ``count`` rows that come first by the hash of their id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = rows.select(F.sha2(told.cast("binary"), 256).alias("hash"), "numbers").orderBy("hash", "numbers").limit(count)
    return np.array([r["numbers"] for r in first.collect()], dtype=np.int64)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = (centroids * centroids).sum(axis=1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, points: np.ndarray) -> np.ndarray:
        winner = np.zeros(len(points), dtype=np.int64)
        for challenger in range(1, len(self.centroids)):
            for holder in range(challenger):
                at = np.flatnonzero(winner == holder)
                sides = points[at] @ self.normals[holder, challenger] - self.thresholds[holder, challenger]
                winner[at[sides > 0]] = challenger
        return winner

    def distances(self, points: np.ndarray, own: np.ndarray) -> np.ndarray:
        away = points - self.centroids[own]
        return np.einsum("ij,ij->i", away, away)


def as_points(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), width)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    count, width = centroids.shape
    bisectors = Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, sums = np.zeros(count, dtype=np.int64), np.zeros((count, width), dtype=np.int64)
        for part in sliced(batches):
            points = as_points(part["numbers"], width)
            own = bisectors.nearest(points)
            for cluster in np.unique(own):
                inside = points[own == cluster]
                sizes[cluster] += len(inside)
                sums[cluster] += inside.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(count), pa.int32()), pa.array(sizes), pa.array(list(sums), pa.list_(pa.int64()))],
            names=["cluster", "size", "sums"],
        )

    parts = rows.select("numbers").mapInArrow(run, "cluster int, size long, sums array<long>")
    exact = "decimal(38,0)"
    totals = [F.sum(F.get("sums", F.lit(i)).cast(exact)).alias(f"s{i}") for i in range(width)]
    # one row per centroid
    summed = parts.groupBy("cluster").agg(F.sum("size").alias("size"), *totals).collect()
    after = centroids.copy()
    for row in summed:
        if row["size"]:
            after[row["cluster"]] = [int(row[f"s{i}"]) // row["size"] for i in range(width)]
    return after


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, cluster, distance``."""
    bisectors, width = Bisectors(centroids), centroids.shape[1]
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("cluster int, distance long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            points = as_points(part["numbers"], width)
            own = bisectors.nearest(points)
            columns = [part["id"], pa.array(own.astype(np.int32)), pa.array(bisectors.distances(points, own))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def of_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1).cast(kind)


def clustered(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    width: int = WIDTH,
    scale: int = SCALE,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``<id>, cluster, distance, cluster_inertia, inertia, centroid_sha256``, and the final centroids."""
    if not 0 < width <= MOST_WIDTH:
        raise ValueError(f"a width of {width} is not between 1 and {MOST_WIDTH}")
    rows = materialize(whole_numbers(spread(vectors), id_column, vector_column, width, scale), "centroids-rows")
    places = seeds(rows, centroids, seed)
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not len(places):
        of = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], of).toDF(*names), places
    for _ in range(rounds):
        after = moved(rows, places)
        if np.array_equal(after, places):  # every further round would leave them too
            break
        places = after
    found = materialize(assigned(rows, places), "centroids-found")
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    per_cluster = [sums.get(i, 0) for i in range(len(places))]
    return found.select(
        F.col("id").alias(id_column), "cluster", "distance",
        of_cluster(per_cluster, "long").alias("cluster_inertia"),
        F.lit(sum(per_cluster)).cast("long").alias("inertia"),
        of_cluster([digest(c) for c in places], "string").alias("centroid_sha256"),
    ), places


def op13_bisectors(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {"op13_bisectors": op13_bisectors}
