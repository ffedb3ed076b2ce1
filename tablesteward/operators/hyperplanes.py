"""Approximate cosine retrieval by random hyperplanes in bands, reranked exactly.

A band's hyperplanes give a vector one bit each: the side it lies on. The bits of
a band are a code, and rows with the same code are a bucket. A question looks into
the buckets whose codes it would most easily have had (the cheapest sides to
cross), as many per band as its settings say. ``calibrated`` finds that number
from the data: for a bounded, documented sample of index vectors it takes their
exact neighbours, and asks how many buckets had to be opened to meet them.

Codes are a narrow table beside the index, kept up to date for changed vectors
only. Vectors meet in buckets, cut into blocks of bounded size; each block passes
on the best ``k`` per question, so no candidate pair is ever a row. A question
that meets fewer than ``k`` rows is searched exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteward.functions.vectors import vector_status
from tablesteward.operators.retrieval import BLOCK_ROWS, PAIR_SCHEMA, TOP_K, best_pairs, nearest
from tablesteward.session import materialize
from tablesteward.sources.snapshots import SnapshotTable

# Bits of a band beyond which a question would weigh too many codes.
MOST_BITS = 12
# Questions of a calibration, and the share of their neighbours that must be met.
SAMPLE_QUESTIONS, WANTED_RECALL = 256, 0.97


@dataclass(frozen=True)
class Hyperplanes:
    """How codes are made (fixed for an index), and how many buckets of a band a question opens."""

    dimensions: int
    bands: int = 8
    bits: int = 6
    seed: int = 11
    probes: int = 8

    def __post_init__(self):
        if not 0 < self.bits <= MOST_BITS:
            raise ValueError(f"{self.bits} bits are not between 1 and {MOST_BITS}")

    def planes(self):
        """``bands x bits`` normals, the same wherever they are made."""
        import numpy as np

        normals = np.random.default_rng(self.seed).standard_normal((self.bands * self.bits, self.dimensions))
        return normals / np.linalg.norm(normals, axis=1, keepdims=True)

    def margins(self, vectors, planes):
        """Signed distances from the planes: ``rows x bands x bits``."""
        return (vectors @ planes.T).reshape(len(vectors), self.bands, self.bits)

    def codes(self, margins):
        import numpy as np

        return (margins > 0) @ (1 << np.arange(self.bits))

    def costs(self, margins):
        """Squared distance to cross for every code of each band: ``rows x bands x codes``."""
        import numpy as np

        sides = (np.arange(1 << self.bits)[:, None] >> np.arange(self.bits)) & 1
        crossed = (margins > 0)[..., None, :] != (sides == 1)
        return np.einsum("nbcj,nbj->nbc", crossed.astype("float64"), margins**2)


def as_matrix(column):
    import numpy as np

    return np.asarray(column.flatten()).astype("float64").reshape(len(column), -1)


def usable(df: DataFrame, dimensions: int) -> DataFrame:
    return df.where(vector_status(F.col("vector"), dimensions) == "ok")


def vector_codes(df: DataFrame, key: str, settings: Hyperplanes) -> DataFrame:
    """``key, vector_hash, codes``: a code per band, for the usable vectors of ``df(key, vector)``."""
    rows = usable(df, settings.dimensions).select(key, F.xxhash64("vector").alias("vector_hash"), "vector")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        planes = settings.planes()
        for batch in batches:
            codes = settings.codes(settings.margins(as_matrix(batch["vector"]), planes)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [batch[key], batch["vector_hash"], pa.array(list(codes), pa.list_(pa.int32()))], names=[key, "vector_hash", "codes"]
            )

    return rows.mapInArrow(run, f"{key} {kind}, vector_hash long, codes array<int>")


def opened(questions: DataFrame, settings: Hyperplanes) -> DataFrame:
    """``q_id, vector, bucket``: the cheapest codes of each band; a bucket is ``band << bits | code``."""
    rows = questions.select("q_id", "vector")
    probes = min(settings.probes, 1 << settings.bits)

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        planes = settings.planes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                costs = settings.costs(settings.margins(as_matrix(part["vector"]), planes))
                first = np.argpartition(costs, probes - 1, axis=2)[:, :, :probes]
                buckets = (np.arange(settings.bands)[:, None] << settings.bits) + first
                told = pa.array(list(buckets.reshape(len(buckets), -1).astype("int32")), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["q_id"], part["vector"], told], names=["q_id", "vector", "buckets"])

    kinds = [rows.schema[name].dataType.simpleString() for name in rows.columns]
    found = rows.mapInArrow(run, f"q_id {kinds[0]}, vector {kinds[1]}, buckets array<int>")
    return found.select("q_id", "vector", F.explode("buckets").alias("bucket"))


def bucket_of(codes: Column, settings: Hyperplanes) -> Column:
    """The buckets of a row's codes."""
    return F.transform(codes, lambda code, band: F.shiftleft(band, settings.bits) + code)


def nearest_approximate(
    questions: DataFrame,
    index: DataFrame,
    codes: DataFrame,
    settings: Hyperplanes,
    k: int = TOP_K,
    max_distance: float | None = None,
    block_rows: int = BLOCK_ROWS,
    exclude_self: bool = False,
) -> DataFrame:
    """The ``k`` nearest rows found of each question, nearest first, as ``retrieval.nearest`` gives them.

    ``codes`` are the ``vector_codes`` of ``index(doc_id, vector)`` by these
    settings. An index row is copied once per band and a question once per
    bucket it opens and block of that bucket.
    """
    questions, index = (usable(df.select(key, "vector"), settings.dimensions) for df, key in ((questions, "q_id"), (index, "doc_id")))
    entries = codes.select("doc_id", F.explode(bucket_of(F.col("codes"), settings)).alias("bucket"))
    # Bounded by the settings, not by the data: at most bands << bits rows.
    sizes = materialize(entries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts")), "bucket-sizes")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    rows = (
        index.join(codes.select("doc_id", bucket_of(F.col("codes"), settings).alias("buckets")), "doc_id")
        .select("doc_id", "vector", F.explode("buckets").alias("bucket"))
        .join(F.broadcast(sizes), "bucket")
        .select("bucket", part.alias("part"), "doc_id", "vector")
    )
    asked = (
        opened(questions, settings)
        .join(F.broadcast(sizes), "bucket")
        .select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "q_id", "vector")
    )
    q_type, d_type = (f.schema[c].dataType.simpleString() for f, c in ((questions, "q_id"), (index, "doc_id")))
    pairs = (
        asked.groupBy("bucket", "part")
        .cogroup(rows.groupBy("bucket", "part"))
        .applyInArrow(best_pairs(k, max_distance, exclude_self), PAIR_SCHEMA.format(q=q_type, d=d_type))
    )
    rank = F.row_number().over(W.partitionBy("q_id").orderBy("distance", "doc_id"))
    # A row may be met in several bands.
    met = pairs.dropDuplicates(["q_id", "doc_id"]).withColumn("rank", rank).where(F.col("rank") <= k)
    met = materialize(met, "approximate")
    if max_distance is not None:  # few rows may be near enough, so few hits are no sign of a miss
        return met
    full = met.groupBy("q_id").count().where(F.col("count") >= k).select("q_id")
    short = materialize(questions.join(full, "q_id", "left_anti"), "short-questions")
    if short.isEmpty():
        return met
    exact = nearest(short, index, k, exclude_self=exclude_self)
    return met.join(full, "q_id", "left_semi").unionByName(exact)


def calibrated(
    index: DataFrame,
    settings: Hyperplanes,
    questions: DataFrame | None = None,
    k: int = TOP_K,
    sample: int = SAMPLE_QUESTIONS,
    wanted: float = WANTED_RECALL,
) -> Hyperplanes:
    """The settings with as many probes as ``wanted`` of the exact neighbours need.

    Asked are at most ``sample`` questions (default: index vectors), the first
    by the hash of their id; they are searched exactly against all of the index.
    Questions that lie farther from the index than its rows from one another
    need more probes, so give some where there are any.
    """
    import numpy as np

    rows = usable(index.select("doc_id", "vector"), settings.dimensions)
    asking = rows.withColumnRenamed("doc_id", "q_id") if questions is None else usable(questions.select("q_id", "vector"), settings.dimensions)
    # Picked by their ids alone; only those rows' vectors are read again.
    ids = materialize(asking.select("q_id").orderBy(F.xxhash64("q_id"), "q_id").limit(sample), "sampled-ids")
    asked = materialize(asking.join(F.broadcast(ids), "q_id"), "sampled-questions")
    hits = nearest(asked, rows, k, exclude_self=questions is None).select("q_id", "doc_id")
    # At most ``sample * k`` rows.
    met = hits.join(asked, "q_id").join(vector_codes(rows.join(hits.select("doc_id").distinct(), "doc_id"), "doc_id", settings), "doc_id")
    found = met.select("vector", "codes").toArrow()
    if not found.num_rows:
        return settings
    needed, planes = [], settings.planes()
    for batch in found.to_batches(max_chunksize=256):
        costs = settings.costs(settings.margins(as_matrix(batch["vector"]), planes))
        own = np.take_along_axis(costs, np.asarray(batch["codes"].to_pylist())[:, :, None], axis=2)
        needed.append(((costs < own).sum(axis=2) + 1).min(axis=1))
    probes = int(np.quantile(np.concatenate(needed), wanted, method="higher"))
    return replace(settings, probes=probes)


class CodeTable:
    """The codes of an index, stored beside it."""

    def __init__(self, spark: SparkSession, folder: str, settings: Hyperplanes):
        self.store, self.settings = SnapshotTable(spark, folder), settings

    def read(self) -> DataFrame | None:
        return self.store.read()

    def refresh(self, index: DataFrame) -> int:
        """Bring the codes up to date with ``index(doc_id, vector)``; returns how many were made anew.

        Only vectors that are new or changed are multiplied; codes of vectors
        that are gone are left out.
        """
        rows, kept = index.select("doc_id", "vector"), self.read()
        if kept is None:
            return self._written(vector_codes(rows, "doc_id", self.settings), None)
        live = usable(rows, self.settings.dimensions).select("doc_id", F.xxhash64("vector").alias("vector_hash"))
        same = materialize(kept.join(live, ["doc_id", "vector_hash"], "left_semi"), "kept-codes")
        changed = rows.join(same.select("doc_id"), "doc_id", "left_anti")
        return self._written(vector_codes(changed, "doc_id", self.settings), same)

    def _written(self, fresh: DataFrame, same: DataFrame | None) -> int:
        fresh = materialize(fresh, "fresh-codes")
        made = fresh.count()
        if same is None or made or same.count() != self.read().count():
            self.store.write(fresh if same is None else same.unionByName(fresh))
        return made


def searcher(codes: DataFrame, settings: Hyperplanes) -> Callable[..., DataFrame]:
    """``nearest_approximate`` over these codes, to be passed where ``nearest`` is the default."""

    def search(questions: DataFrame, index: DataFrame, k: int = TOP_K, max_distance: float | None = None) -> DataFrame:
        return nearest_approximate(questions, index, codes, settings, k, max_distance)

    return search
