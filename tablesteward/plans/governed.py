"""Guarded runs of untrusted SQL: clean up, check, price, run with a time limit."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.functions.jsonsafe import json_safe
from tablesteward.functions.sqltext import ESCAPE_HATCHES, with_verdict
from tablesteward.plans.planwalk import leaves_engine, parsed, physical_leaves, refusal
from tablesteward.operators.scancost import MAX_BYTES, rejection_text
from tablesteward.session import materialize
from tablesteward.sources.footers import FooterStore, footer_inventory
from tablesteward.sources.tables import TableRef, data_files, qualified, register

# Fixed value: seconds a query may run.
TIMEOUT_SECONDS = 120.0

MESSAGES = {
    "empty": "the query text is empty",
    "multiple_statements": "only one statement may be run; remove the inner `;`",
    "not_read_only": "only SELECT queries may be run",
    "escape_hatch": "functions that leave the query engine are not allowed",
    "unknown_source": "the query reads something that is not a registered table",
}

# Leaves of a plan that read nothing from storage.
FREE_SCANS = (
    "LocalTableScanExec", "RangeExec", "OneRowRelationExec", "RDDScanExec", "EmptyRelationExec", "ReusedExchangeExec", "ReusedSubqueryExec",
)


@dataclass(frozen=True)
class Warehouse:
    """Registered tables and, if kept, a stored footer inventory of them."""

    spark: SparkSession
    refs: tuple[TableRef, ...]
    inventory: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, refs: list[TableRef]) -> Warehouse:
        register(spark, refs)
        return cls(spark, tuple(refs))

    def names(self) -> set[str]:
        """What a text may call the tables; those of the session catalog go by their database as well."""
        short = {f"{ref.dataset}.{ref.table}".lower() for ref in self.refs if ref.path is None}
        return short | {ref.table_id.lower() for ref in self.refs}

    def with_stored_inventory(self, folder: str | None = None) -> Warehouse:
        """Read all footers once now, instead of those of each query's tables.

        With a ``folder`` they are kept there from one time to the next, and only
        files that are new or have changed are read.
        """
        if folder is None:
            return replace(self, inventory=materialize(footer_inventory(data_files(self.spark, list(self.refs))), "footers"))
        store = FooterStore(self.spark, folder)
        store.refresh(list(self.refs))
        return replace(self, inventory=store.read())

    def footers(self, used: list[TableRef]) -> DataFrame:
        if self.inventory is not None:
            return self.inventory.where(F.col("table_id").isin([ref.table_id for ref in used]))
        return footer_inventory(data_files(self.spark, used))


@dataclass(frozen=True)
class Scan:
    table: TableRef
    columns: tuple[str, ...]
    partition_columns: tuple[T.StructField, ...]
    partition_filters: tuple[str, ...]


@dataclass(frozen=True)
class GovernedRun:
    """Outcome of a run; ``result`` is a lazy frame when ``status`` is success."""

    status: str
    sql: str | None
    error_code: str | None = None
    error: str | None = None
    estimated_bytes: int | None = None
    max_bytes_billed: int | None = None
    result: DataFrame | None = field(default=None, compare=False)

    def envelope(self, spark: SparkSession) -> DataFrame:
        """One row: status, column names, row count and bytes, or the error."""
        facts = [
            F.lit(self.status).alias("status"),
            F.lit(self.error_code).cast("string").alias("error_code"),
            F.lit(self.error).cast("string").alias("error"),
            F.lit(self.estimated_bytes).cast("bigint").alias("bytes_billed"),
        ]
        if self.result is None:
            nothing = [F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("bigint").alias("row_count")]
            return spark.range(1).select(*facts[:1], *nothing, *facts[1:])
        columns = F.array(*[F.lit(name) for name in self.result.columns]).alias("columns")
        return self.result.agg(F.count(F.lit(1)).alias("row_count")).select(facts[0], columns, "row_count", *facts[1:])


def governed_sql(
    warehouse: Warehouse, text: str | None, max_bytes: int = MAX_BYTES, parameters: dict | None = None
) -> GovernedRun:
    """Check and price ``text``: by its words, as parsed, as analysed and as planned.

    A relation that is not registered is refused on the parsed text, before
    Spark looks for it. Calls into the JVM are refused however they are written.

    Every failure comes back as a run with status ``error``. The result is lazy
    and JSON-safe; ``finish`` runs it under a time limit.
    """
    spark = warehouse.spark
    audited = with_verdict(spark.range(1).select(F.lit(text).cast("string").alias("sql")), "sql")
    checked = audited.select("cleaned", "verdict", F.col("masked").rlike(ESCAPE_HATCHES).alias("escapes")).first()
    code = checked["verdict"] if checked["verdict"] != "ok" else ("escape_hatch" if checked["escapes"] else None)
    if code:
        return GovernedRun("error", text if checked["cleaned"] is None else checked["cleaned"], code, MESSAGES[code])
    sql = checked["cleaned"]
    try:
        code = refusal(parsed(spark, sql), warehouse.names())
        result = None if code else spark.sql(sql, args=parameters)
        if result is not None and leaves_engine(result):
            code = "escape_hatch"
        scans = None if code else scanned_columns(result, warehouse.refs)
    except Exception as problem:
        return GovernedRun("error", sql, "execution_failed", f"query could not be planned: {problem}")
    if scans is None:
        code = code or "unknown_source"
        return GovernedRun("error", sql, code, MESSAGES[code])
    estimate = estimate_bytes(warehouse, scans)
    if estimate > max_bytes:
        message = spark.range(1).select(rejection_text(F.lit(estimate), max_bytes)).first()[0]
        return GovernedRun("error", sql, "over_budget", message, estimate, max_bytes)
    return GovernedRun("success", sql, None, None, estimate, max_bytes, json_safe(result))


def scanned_columns(planned: DataFrame, refs: tuple[TableRef, ...]) -> list[Scan] | None:
    """What the scans of a read-only frame would read; None if a source is not registered.

    Taken from the physical plan, where unused columns are already gone; of a
    cached relation, from the plan under the cache. Nothing is run and no
    setting of the session is touched, so runs may overlap.
    """
    spark, scans = planned.sparkSession, []
    for leaf in physical_leaves(planned):
        kind = leaf.getClass().getSimpleName()
        if kind in FREE_SCANS:
            continue
        paths = _root_paths(leaf) if kind == "FileSourceScanExec" else None
        if paths == []:  # every partition is pruned away
            continue
        table = _table_of(spark, paths, refs) if paths else None
        if table is None:
            return None
        partition_schema = T.StructType.fromJson(_json(leaf.relation().partitionSchema().json()))
        scans.append(
            Scan(
                table,
                tuple(f["name"] for f in _json(leaf.requiredSchema().json())["fields"]),
                tuple(partition_schema.fields),
                tuple(_static_filters(leaf)),
            )
        )
    return scans


def _json(text: str):
    import json

    return json.loads(text)


def _root_paths(leaf) -> list[str]:
    roots = leaf.relation().location().rootPaths().mkString("\n")
    return [path for path in roots.split("\n") if path]


def _table_of(spark: SparkSession, paths: list[str], refs: tuple[TableRef, ...]) -> TableRef | None:
    found = [qualified(spark, path) for path in paths]
    for ref in refs:
        # A partitioned catalog table is scanned by its pruned partition folders.
        if ref.files is not None and all(f"{path}/".startswith(qualified(spark, ref.files) + "/") for path in found):
            return ref
    return None


def _static_filters(leaf):
    """Partition conditions known before the run, as SQL over plain names."""
    filters = leaf.partitionFilters()
    for condition in (filters.apply(i) for i in range(filters.size())):
        if "dynamicpruning" in condition.toString().lower():
            continue
        text = condition.sql()
        attributes = condition.references().toSeq()
        for attribute in (attributes.apply(i) for i in range(attributes.size())):
            text = text.replace(attribute.sql(), f"`{attribute.name()}`")
        yield text


def estimate_bytes(warehouse: Warehouse, scans: list[Scan]) -> int:
    """Unpacked bytes of the scanned columns in the files that are not pruned.

    Like a dry run: a LIMIT or an ordinary filter does not lower it.
    """
    used = list({scan.table.table_id: scan.table for scan in scans}.values())
    if not used:
        return 0
    footers = warehouse.footers(used)
    parts = []
    for scan in scans:
        rows = footers.where((F.col("table_id") == scan.table.table_id) & F.col("column").isin(list(scan.columns)))
        for part in scan.partition_columns:
            value = F.url_decode(F.regexp_extract("path", f"/{part.name}=([^/]+)/", 1))
            rows = rows.withColumn(part.name, F.when(value != "__HIVE_DEFAULT_PARTITION__", value).cast(part.dataType))
        for condition in scan.partition_filters:
            rows = rows.where(condition)
        parts.append(rows.select("path", "leaf", "plain_bytes"))
    # A column chunk read by two scans of one query counts once.
    chunks = reduce(DataFrame.unionByName, parts).dropDuplicates(["path", "leaf"])
    return chunks.agg(F.coalesce(F.sum("plain_bytes"), F.lit(0))).first()[0]


def run_with_timeout(spark: SparkSession, action: Callable[[], object], seconds: float = TIMEOUT_SECONDS) -> object:
    """Run a Spark action; after ``seconds`` its jobs are cancelled by tag.

    Job tags of the context can be cancelled from another thread; those of the
    session belong to the thread that set them. Cancelling goes on until the
    action ends, as it may be between two jobs.
    """
    tag, context = f"governed-{uuid.uuid4().hex}", spark.sparkContext
    ended, expired = threading.Event(), threading.Event()

    def watch() -> None:
        if not ended.wait(seconds):
            expired.set()
            context.cancelJobsWithTag(tag)
            while not ended.wait(0.2):
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        return action()
    except Exception as problem:
        if expired.is_set():
            raise TimeoutError(f"query cancelled after {seconds:g} s") from problem
        raise
    finally:
        ended.set()
        context.removeJobTag(tag)


def finish(run: GovernedRun, spark: SparkSession, timeout: float = TIMEOUT_SECONDS) -> GovernedRun:
    """Run an accepted query once, keeping its rows in the shared folder.

    The returned run reads from there; a failure or timeout becomes an error.
    """
    if run.result is None:
        return run
    try:
        stored = run_with_timeout(spark, lambda: materialize(run.result, "result"), timeout)
    except Exception as problem:
        code = "timeout" if isinstance(problem, TimeoutError) else "execution_failed"
        return replace(run, status="error", error_code=code, error=f"query failed: {problem}", result=None)
    return replace(run, result=stored)
