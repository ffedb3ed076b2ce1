"""Finding the tables of a warehouse: a folder per dataset, or the catalog."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_PROJECT = "warehouse"
LOOKUPS = 8
R = TypeVar("R")


@dataclass(frozen=True)
class TableRef:
    """One table: its three-part name, where it is read, and what is known of it.

    ``path`` is set for folder tables; a table of the session catalog is read by
    name, and ``location`` is where its Parquet files are, if it has such.
    """

    project: str
    dataset: str
    table: str
    path: str | None = None
    table_type: str = "TABLE"
    description: str = ""
    sample_order: tuple[str, ...] = ()
    schema: T.StructType | None = field(default=None, compare=False)
    location: str | None = None

    @property
    def files(self) -> str | None:
        return self.path or self.location

    @property
    def table_id(self) -> str:
        return f"{self.project}.{self.dataset}.{self.table}"

    def read(self, spark: SparkSession) -> DataFrame:
        if self.path is None:
            return spark.table(f"`{self.dataset}`.`{self.table}`")
        reader = spark.read if self.schema is None else spark.read.schema(self.schema)
        return reader.parquet(self.path)

    @property
    def sampled(self) -> bool:
        return self.table_type in ("TABLE", "MATERIALIZED_VIEW")


def resolve_datasets(spark: SparkSession, datasets: str | list[str], project: str = DEFAULT_PROJECT) -> list[tuple[str, str]]:
    """``(project, dataset)`` for each name; no names means every database."""
    names = datasets.split(",") if isinstance(datasets, str) else list(datasets)
    names = [name.strip() for name in names if name.strip()]
    if not names:
        names = [database.name for database in spark.catalog.listDatabases()]
    return [tuple(name.split(".", 1)) if "." in name else (project, name) for name in names]


def catalog_tables(spark: SparkSession, datasets: str | list[str] = "", project: str = DEFAULT_PROJECT) -> list[TableRef]:
    """Every table of the named databases, as registered in the session catalog."""
    refs = []
    for owner, dataset in resolve_datasets(spark, datasets, project):
        for entry in spark.catalog.listTables(dataset):
            if not entry.isTemporary:
                kind = "VIEW" if entry.tableType == "VIEW" else "TABLE"
                ref = TableRef(owner, dataset, entry.name, None, kind, (entry.description or "").strip())
                refs.append(replace(ref, location=_location(spark, ref)))
    return refs


def _location(spark: SparkSession, ref: TableRef) -> str | None:
    """The folder of a catalog table kept as Parquet files."""
    facts = spark.sql(f"DESCRIBE TABLE EXTENDED `{ref.dataset}`.`{ref.table}`").where("col_name IN ('Provider', 'Location')")
    found = {row["col_name"]: row["data_type"] for row in facts.collect()}
    return found.get("Location") if found.get("Provider", "").lower() == "parquet" else None


def folder_tables(folder: str, names: list[str], dataset: str, project: str = DEFAULT_PROJECT) -> list[TableRef]:
    """Tables kept as ``<folder>/<name>.parquet`` (a file or a folder of files)."""
    return [TableRef(project, dataset, name, f"{folder}/{name}.parquet") for name in names]


def with_schemas(spark: SparkSession, refs: list[TableRef]) -> list[TableRef]:
    """The same tables with their schemas, so that each is looked up once.

    Looking up a folder is a small job; several run at a time.
    """

    def known(ref: TableRef) -> TableRef:
        return ref if ref.schema is not None else replace(ref, schema=ref.read(spark).schema)

    return each_table(known, refs)


def each_table(task: Callable[[TableRef], R], refs: list[TableRef]) -> list[R]:
    """``task`` for every table in order, a few at a time: it only plans or looks up."""
    with ThreadPoolExecutor(LOOKUPS) as pool:
        return list(pool.map(task, refs))


def register(spark: SparkSession, refs: list[TableRef]) -> None:
    """A temporary view per table, named by its full dotted name in backticks."""
    each_table(lambda ref: ref.read(spark).createOrReplaceTempView(f"`{ref.table_id}`"), with_schemas(spark, refs))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as listings and scans name it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString().rstrip("/")


def data_files(spark: SparkSession, refs: list[TableRef]) -> DataFrame:
    """``table_id, path, file_bytes, modified`` of every data file, listed by Spark."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load([ref.files for ref in refs])
        .select("path", F.col("length").alias("file_bytes"), F.col("modificationTime").alias("modified"))
        .where("file_bytes > 0")
    )
    # Two tables may share a folder, so a file can have more than one owner.
    inside = [F.concat("path", F.lit("/")).startswith(qualified(spark, ref.files) + "/") for ref in refs]
    owners = F.array_compact(F.array(*[F.when(hit, F.lit(ref.table_id)) for hit, ref in zip(inside, refs)]))
    return listing.select(F.explode(owners).alias("table_id"), "path", "file_bytes", "modified")


def partition_summaries(spark: SparkSession, refs: list[TableRef]) -> dict[str, tuple[str | None, list[str]]]:
    """By table: how it is partitioned, and its clustering (bucket) columns.

    A date partition is called ``DAY``, a timestamp ``HOUR``, an integer
    ``RANGE``; any other type is shown by its name. Folder tables are told from
    the path of one file each, found in one job for all of them.
    """
    found: dict[str, tuple[str | None, list[str]]] = {}
    stored = {ref.table_id: ref for ref in refs if ref.path is not None}
    if stored:
        one_file = data_files(spark, list(stored.values())).groupBy("table_id").agg(F.min("path").alias("path"))
        for row in one_file.collect():
            ref = stored[row["table_id"]]
            tail = row["path"].rsplit(ref.path.rstrip("/").rsplit("/", 1)[-1], 1)[-1]
            names = [part.split("=", 1)[0] for part in tail.split("/")[:-1] if "=" in part]
            types = {f.name: f.dataType.simpleString() for f in ref.read(spark).schema.fields} if names else {}
            found[ref.table_id] = (_describe([(name, types[name]) for name in names]), [])
    for ref in refs:
        if ref.path is None:
            columns = spark.catalog.listColumns(f"`{ref.dataset}`.`{ref.table}`")
            parts = [(c.name, c.dataType) for c in columns if c.isPartition]
            found[ref.table_id] = (_describe(parts), [c.name for c in columns if c.isBucket])
    return found


def _describe(parts: list[tuple[str, str]]) -> str | None:
    words = {"date": "DAY", "timestamp": "HOUR", "timestamp_ntz": "HOUR", "int": "RANGE", "bigint": "RANGE"}
    return ", ".join(f"{words.get(kind, kind.upper())} on `{name}`" for name, kind in parts) or None
