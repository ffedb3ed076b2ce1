"""Schema cards: the text shown for a table, the text embedded, and its hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteward.operators.profile import SAMPLE_ROWS, catalog_columns, distinctive_values, sample_cells
from tablesteward.sources.footers import footer_inventory, table_rows
from tablesteward.sources.tables import TableRef, data_files, partition_summaries, with_schemas

TABLE_SCHEMA = (
    "table_id string, project string, dataset string, table string, table_type string, "
    "description string, partition_summary string, clustering array<string>"
)


def _lines(ordinal: str, line: Column) -> Column:
    """The lines of one group in order; groups are columns or sample rows of a table."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(ordinal, line.alias("line")))), lambda s: s["line"]), "\n")


def catalog_tables(spark: SparkSession, refs: list[TableRef]) -> DataFrame:
    """One row per table with its row count.

    Counts of Parquet tables come from the footers, all tables in one job;
    other tables of the session catalog are counted by Spark.
    """
    layout = partition_summaries(spark, refs)
    rows = [
        (r.table_id, r.project, r.dataset, r.table, r.table_type, r.description.strip(), *layout.get(r.table_id, (None, [])))
        for r in refs
    ]
    counts = None
    stored = [ref for ref in refs if ref.files is not None]
    if stored:
        counts = table_rows(footer_inventory(data_files(spark, stored)))
    for ref in (r for r in refs if r.files is None):
        counted = ref.read(spark).agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(ref.table_id).alias("table_id"), "num_rows")
        counts = counted if counts is None else counts.unionByName(counted)
    tables = spark.createDataFrame(rows, TABLE_SCHEMA)
    if counts is None:
        return tables.withColumn("num_rows", F.lit(None).cast("bigint"))
    # A table without data files has no footer: that is zero rows.
    return tables.join(counts, "table_id", "left").withColumn("num_rows", F.coalesce("num_rows", F.lit(0)))


def schema_cards(tables: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """Add ``column_names``, ``card``, ``embed_text``, ``content_hash``, ``doc_id``.

    All grouping is per table, so a group is as large as a table has columns.
    """
    modifier = F.when(F.col("mode") != "NULLABLE", F.concat(F.lit(", "), "mode")).otherwise(F.lit(""))
    note = F.when(F.col("description") != "", F.concat(F.lit(" — "), "description")).otherwise(F.lit(""))
    bullet = F.concat(F.lit("- `"), "path", F.lit("` ("), "type", modifier, F.lit(")"), note)
    per_column = columns.groupBy("table_id").agg(
        _lines("ordinal", bullet).alias("column_lines"),
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "path"))), lambda s: s["path"]).alias("column_names"),
    )

    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "cell"))), lambda s: s["cell"]), " | ")
    header = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column"))), lambda s: s["column"])
    grid = (
        cells.groupBy("table_id", "row_no")
        .agg(row.alias("line"), header.alias("header"))
        .groupBy("table_id")
        .agg(
            F.count(F.lit(1)).alias("sampled"),
            F.first("header").alias("header"),
            _lines("row_no", F.col("line")).alias("rows_text"),
        )
    )
    representative = distinctive_values(cells).groupBy("table_id").agg(
        _lines("position", F.concat(F.lit("- "), "column", F.lit(": "), "values")).alias("value_lines")
    )

    full = (
        tables.join(per_column, "table_id", "left").join(grid, "table_id", "left").join(representative, "table_id", "left")
    )

    def only_if(condition: Column, *parts: Column | str) -> Column:
        return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    described = only_if(F.col("description") != "", "Description: ", F.col("description"))
    counted = only_if(F.col("num_rows").isNotNull(), "Approximate rows: ", F.format_number("num_rows", 0))
    grid_text = F.concat_ws(
        "\n",
        F.concat(F.lit("\n## Sample rows ("), F.col("sampled").cast("string"), F.lit(")")),
        F.array_join("header", " | "),
        F.array_join(F.transform("header", lambda _: F.lit("---")), " | "),
        F.col("rows_text"),
    )
    # The labels of the card and embed-text format, which stored hashes depend on.
    card = F.concat_ws(
        "\n",
        F.concat(F.lit("# Table: `"), "table_id", F.lit("`")),
        only_if(F.col("table_type") != "TABLE", "Type: ", F.col("table_type")),
        described,
        counted,
        only_if(F.col("partition_summary").isNotNull(), "Partitioned by: ", F.col("partition_summary")),
        only_if(F.size("clustering") > 0, "Clustered by: ", F.array_join("clustering", ", ")),
        F.lit("\n## Columns"),
        F.col("column_lines"),
        F.when(F.col("sampled") > 0, grid_text),
    )
    embed_text = F.concat_ws(
        "\n",
        F.concat(F.lit("Warehouse table: "), "table_id"),
        F.concat(F.lit("Table name: "), F.replace("table", F.lit("_"), F.lit(" "))),
        F.concat(F.lit("Dataset: "), F.replace("dataset", F.lit("_"), F.lit(" "))),
        described,
        counted,
        F.concat(F.lit("Columns: "), F.array_join(F.coalesce("column_names", F.array()), ", ")),
        F.concat(F.lit("Representative values:\n"), "value_lines"),
    )
    texts = full.withColumns({"card": card, "embed_text": embed_text})
    return with_identity(
        texts.select(
            "table_id", "project", "dataset", "table", "table_type", "description", "num_rows", "column_names", "card", "embed_text"
        )
    )


def with_identity(cards: DataFrame) -> DataFrame:
    """Add ``content_hash`` (SHA-256 of card, NUL, embed text) and ``doc_id``."""
    payload = F.concat("card", F.lit("\x00"), "embed_text")
    return cards.withColumns(
        {"content_hash": F.sha2(payload, 256), "doc_id": F.replace("table_id", F.lit("/"), F.lit("_"))}
    )


def collect_cards(spark: SparkSession, refs: list[TableRef], sample: int = SAMPLE_ROWS) -> DataFrame:
    """Cards of all tables; nothing is written (this is also the dry run)."""
    opened = with_schemas(spark, refs)
    return schema_cards(catalog_tables(spark, opened), catalog_columns(spark, opened), sample_cells(spark, opened, sample))
