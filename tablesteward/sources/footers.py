"""Row counts and column sizes from Parquet footers, without reading data pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteward.session import materialize
from tablesteward.sources.snapshots import SnapshotTable
from tablesteward.sources.tables import TableRef, data_files

FOOTER_SCHEMA = (
    "table_id string, path string, leaf string, leaf_index int, rows bigint, compressed_bytes bigint, plain_bytes bigint"
)


def footer_inventory(files: DataFrame) -> DataFrame:
    """One row per leaf column of each of ``files(table_id, path)``.

    Gives rows, and bytes as stored and unpacked.

    Footers are read inside tasks, one small ranged read per file.
    """

    def read_footers(batches):
        import pandas as pd
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            found = []
            for table_id, path in zip(batch["table_id"], batch["path"]):
                filesystem, inner = pafs.FileSystem.from_uri(path)
                with filesystem.open_input_file(inner) as handle:
                    footer = pq.read_metadata(handle)
                for leaf in range(footer.num_columns):
                    chunks = [footer.row_group(g).column(leaf) for g in range(footer.num_row_groups)]
                    found.append(
                        {
                            "table_id": table_id,
                            "path": path,
                            "leaf": footer.schema.column(leaf).path,
                            "leaf_index": leaf,
                            "rows": footer.num_rows,
                            "compressed_bytes": sum(chunk.total_compressed_size for chunk in chunks),
                            "plain_bytes": sum(chunk.total_uncompressed_size for chunk in chunks),
                        }
                    )
            if found:
                yield pd.DataFrame(found)

    footers = files.select("table_id", "path").mapInPandas(read_footers, FOOTER_SCHEMA)
    return footers.withColumn("column", F.substring_index("leaf", ".", 1))


def table_rows(inventory: DataFrame) -> DataFrame:
    """``table_id, num_rows`` (each file counted once, by its first leaf)."""
    return (
        inventory.where("leaf_index = 0").groupBy("table_id").agg(F.sum("rows").alias("num_rows"))
    )


def column_bytes(inventory: DataFrame) -> DataFrame:
    """``table_id, column, compressed_bytes, plain_bytes`` over all files."""
    return inventory.groupBy("table_id", "column").agg(
        F.sum("compressed_bytes").alias("compressed_bytes"), F.sum("plain_bytes").alias("plain_bytes")
    )


# What tells a file from the one that was read before.
FILE = ["table_id", "path", "file_bytes", "modified"]


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the version that is current, and how many files were read, kept and dropped."""

    version: int
    read: int
    kept: int
    dropped: int


class FooterStore:
    """The footer inventory of a warehouse, kept between runs as committed versions.

    A file is read again only if its path is new or its length or time of
    modification differs; entries of files that are gone are dropped. Nothing is
    written when nothing has changed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, SnapshotTable(spark, folder)

    def read(self) -> DataFrame | None:
        """The current inventory, as ``footer_inventory`` gives it, with the length and time of each file."""
        return self.store.read()

    def refresh(self, refs: list[TableRef]) -> Refresh:
        """Bring the inventory up to date with the files of these tables."""
        listed = materialize(data_files(self.spark, refs), "listed-files")
        before, version = self.read(), self.store.current()
        if before is None:
            return Refresh(self.store.write(self._footers(listed)), listed.count(), 0, 0)
        known = materialize(before.select(*FILE).distinct(), "known-files")
        fresh = materialize(listed.join(known, FILE, "left_anti"), "fresh-files")
        read, kept = fresh.count(), listed.join(known, FILE, "left_semi").count()
        dropped = known.count() - kept
        if read or dropped:
            same = before.join(listed.select(*FILE), FILE, "left_semi")
            version = self.store.write(same.unionByName(self._footers(fresh)))
        return Refresh(version, read, kept, dropped)

    def _footers(self, files: DataFrame) -> DataFrame:
        return footer_inventory(files).join(files.select(*FILE), ["table_id", "path"])
