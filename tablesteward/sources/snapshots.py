"""A table kept as whole snapshots, for formats that cannot update in place."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_SCHEMA = "version bigint"


def is_missing(problem: AnalysisException) -> bool:
    """Whether a read failed because nothing was ever written there."""
    return problem.getCondition() == "PATH_NOT_FOUND"


class SnapshotTable:
    """Versions under ``<folder>/version=N``; a version counts once committed.

    A write goes to a folder of its own and is committed by an appended row, so
    a reader never sees half a snapshot and a failed write leaves the previous
    one current. Writing a version again replaces it, which makes retries safe.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self) -> int | None:
        """Latest committed version, or None."""
        try:
            commits = self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.folder}/commits")
            return commits.agg(F.max("version")).first()[0]
        except AnalysisException as problem:
            if not is_missing(problem):
                raise
            return None

    def path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def read(self, version: int | None = None) -> DataFrame | None:
        version = self.current() if version is None else version
        return None if version is None else self.spark.read.parquet(self.path(version))

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write and commit ``df`` as ``version`` (default: the next one)."""
        if version is None:
            latest = self.current()
            version = 0 if latest is None else latest + 1
        df.write.mode("overwrite").parquet(self.path(version))
        commit = self.spark.range(version, version + 1, numPartitions=1).toDF("version")
        commit.write.mode("append").json(f"{self.folder}/commits")
        return version
