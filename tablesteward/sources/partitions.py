"""A keyed table in hash partitions, of which a change rewrites only those it touches."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.session import materialize
from tablesteward.sources.snapshots import is_missing

COMMIT_SCHEMA = "version bigint, schema string, partitions map<string,bigint>"
PARTITION = "partition_number"
# Partitions of a new table; each should hold what one task can rewrite.
PARTITIONS = 64


@dataclass(frozen=True)
class Manifest:
    """A committed version: the schema as JSON, and the version that each partition was last written in."""

    version: int
    schema: str
    partitions: dict[int, int]


class PartitionedTable:
    """Rows under ``<folder>/version=V/partition_number=P``, found through the newest manifest.

    A change reads and writes the partitions of its keys only, into a folder of
    its own, and is committed by one appended manifest row that names for each
    partition the version to read. So a reader never sees half a change, a failed
    one leaves the table as it was, and older versions stay readable. A manifest
    has one entry per partition, whatever the table's size.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], partitions: int = PARTITIONS):
        self.spark, self.folder, self.keys, self.partitions = spark, folder.rstrip("/"), keys, partitions

    def manifest(self, version: int | None = None) -> Manifest | None:
        """A committed version, the latest unless one is named."""
        try:
            commits = self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.folder}/commits")
            commits = commits if version is None else commits.where(F.col("version") == version)
            row = commits.orderBy(F.desc("version")).first()
        except AnalysisException as problem:
            if not is_missing(problem):
                raise
            return None
        return Manifest(row["version"], row["schema"], {int(n): v for n, v in (row["partitions"] or {}).items()}) if row else None

    def current(self) -> int | None:
        found = self.manifest()
        return found.version if found else None

    def read(self, version: int | None = None) -> DataFrame | None:
        found = self.manifest(version)
        return None if found is None else self._rows(found, list(found.partitions))

    def write(self, df: DataFrame) -> int:
        """Replace the whole table."""
        return self._commit(df, self.manifest(), {})

    def change(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Replace or add rows by key, and remove the rows of the keys in ``deletes``; keys in both are kept as upserted.

        Returns the version, which stays the same if no key is given. Rows of
        ``upserts`` should have one row per key; null keys match null keys.
        """
        before = self.manifest()
        if before is None:
            if upserts is None:
                raise ValueError("the table has no version to delete from")
            return self.write(upserts)
        parts = [df for df in (upserts, deletes) if df is not None]
        named = [df.select(*self.keys) for df in parts]
        touched = named[0] if len(named) == 1 else named[0].unionByName(named[1])
        # written once, as both the list of partitions and the join read it
        touched = materialize(touched.distinct().withColumn(PARTITION, self._number()), "changed-keys")
        numbers = [row[0] for row in touched.select(PARTITION).distinct().collect()]  # one per partition at most
        if not numbers:
            return before.version
        left = self._rows(before, [n for n in numbers if n in before.partitions])
        kept = self._without(left, touched)
        after = kept if upserts is None else kept.unionByName(upserts, allowMissingColumns=True)
        return self._commit(after, before, {n: v for n, v in before.partitions.items() if n not in numbers})

    def _number(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int")

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        renamed = keys.select(*[F.col(key).alias(f"__{key}") for key in self.keys])
        same = [F.col(key).eqNullSafe(F.col(f"__{key}")) for key in self.keys]
        return rows.join(renamed, same, "left_anti")

    def _rows(self, found: Manifest, numbers: list[int]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(found.schema))
        if not numbers:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/version={found.partitions[n]}/{PARTITION}={n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths)

    def _commit(self, df: DataFrame, before: Manifest | None, others: dict[int, int]) -> int:
        version = 0 if before is None else before.version + 1
        path = f"{self.folder}/version={version}"
        # a failed earlier try may have left files of this version
        numbered = df.withColumn(PARTITION, self._number())
        numbered.repartition(PARTITION).write.mode("overwrite").partitionBy(PARTITION).parquet(path)
        found = self.spark.read.schema(numbered.schema).parquet(path).select(PARTITION).distinct().collect()
        partitions = others | {row[0]: version for row in found}
        listed = ", ".join(f"'{n}', {v}L" for n, v in sorted(partitions.items()))
        told = self.spark.range(version, version + 1, numPartitions=1).select(
            F.col("id").alias("version"), F.lit(df.schema.json()).alias("schema"),
            F.expr(f"map({listed})" if listed else "cast(map() as map<string,bigint>)").alias("partitions"),
        )
        told.write.mode("append").json(f"{self.folder}/commits")
        return version
