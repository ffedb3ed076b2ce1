"""What a table holds: columns, sizes, sample cells, representative values."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.functions.text import format_cell, raw_text_sql, shown_text
from tablesteward.sources.tables import TableRef, each_table, with_schemas

# Sampling size and the rules for representative values.
SAMPLE_ROWS = 5
MAX_VALUE_COLUMNS = 8
MAX_VALUE_CHARS = 40
NUMBER_LIKE = r"^[\d.\-+:/ ]+$"
PLACE_COLUMNS = "address|city|county|state|site|cbsa|zip|postal|street|location|latitude|longitude"

COLUMN_SCHEMA = "table_id string, ordinal int, path string, type string, mode string, description string"
CELL_SCHEMA = "table_id string, ordinal int, column string, type string, row_no int, cell string"


def union_all(frames: list[DataFrame]) -> DataFrame:
    """One flat union; pairing halves keeps the plan tree shallow."""
    while len(frames) > 1:
        frames = [reduce(DataFrame.unionByName, frames[i : i + 2]) for i in range(0, len(frames), 2)]
    return frames[0]


def array_sql(texts: list[str]) -> str:
    """SQL for an array of string literals."""
    quoted = [text.replace("\\", "\\\\").replace("'", "\\'") for text in texts]
    return "array(" + ", ".join(f"'{text}'" for text in quoted) + ")"


def iter_fields(schema: T.StructType, prefix: str = ""):
    """``(dotted path, field)``, parents first; arrays of structs are entered too."""
    for field in schema.fields:
        path = prefix + field.name
        yield path, field
        inner = field.dataType
        if isinstance(inner, T.ArrayType):
            inner = inner.elementType
        if isinstance(inner, T.StructType):
            yield from iter_fields(inner, path + ".")


def field_type(field: T.StructField) -> tuple[str, str]:
    """Type and mode: arrays are their element type with mode REPEATED."""
    kind, mode = field.dataType, "NULLABLE" if field.nullable else "REQUIRED"
    if isinstance(kind, T.ArrayType):
        kind, mode = kind.elementType, "REPEATED"
    return ("STRUCT" if isinstance(kind, T.StructType) else kind.simpleString().upper()), mode


def catalog_columns(spark: SparkSession, refs: list[TableRef]) -> DataFrame:
    """One row per column of every table, nested columns by dotted path."""
    rows = []
    for ref in with_schemas(spark, refs):
        for ordinal, (path, field) in enumerate(iter_fields(ref.read(spark).schema), start=1):
            kind, mode = field_type(field)
            description = (field.metadata or {}).get("comment", "").strip()
            rows.append((ref.table_id, ordinal, path, kind, mode, description))
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns replaced by their leaves, named by dotted path; arrays stay whole."""

    def leaves(schema: T.StructType, parents: tuple[str, ...] = ()):
        for field in schema.fields:
            path = (*parents, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, path)
            else:
                yield F.col(".".join(f"`{part}`" for part in path)).alias(".".join(path))

    return df.select(*leaves(df.schema))


FIXED_BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def value_bytes_sql(value: str, data_type: T.DataType) -> str:
    """SQL for the logical size of one value: UTF-8 length of text, else a fixed width."""
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return f"octet_length({value})"
    if isinstance(data_type, T.ArrayType):
        inner = data_type.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            each = f"coalesce({value_bytes_sql('x', inner)}, 0)"
            return f"aggregate({value}, 0L, (total, x) -> total + {each})"
        return f"size({value}) * {FIXED_BYTES.get(type(inner), 8)}"
    if isinstance(data_type, T.StructType):
        return "(" + " + ".join(f"coalesce({value_bytes_sql(f'{value}.`{f.name}`', f.dataType)}, 0)" for f in data_type.fields) + ")"
    if isinstance(data_type, T.MapType):
        keys = value_bytes_sql(f"map_keys({value})", T.ArrayType(data_type.keyType))
        return f"({keys} + {value_bytes_sql(f'map_values({value})', T.ArrayType(data_type.valueType))})"
    return f"if({value} IS NULL, NULL, {FIXED_BYTES.get(type(data_type), 8)})"


def column_logical_bytes(spark: SparkSession, refs: list[TableRef]) -> DataFrame:
    """Rows and logical bytes of each top-level column; one scan per table.

    Fixed-width columns cost a count; only the others are measured.
    """
    def totals(ref: TableRef) -> DataFrame:
        df = ref.read(spark)
        fields, sums = df.schema.fields, []
        for f in fields:
            if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
                total = f"coalesce(sum({value_bytes_sql(f'`{f.name}`', f.dataType)}), 0L)"
            else:
                total = f"count(`{f.name}`) * {FIXED_BYTES.get(type(f.dataType), 8)}"
            sums.append(f"cast({total} AS bigint)")
        return df.selectExpr(
            f"{array_sql([ref.table_id])}[0] AS table_id",
            "count(1) AS rows",
            f"{array_sql([f.name for f in fields])} AS columns",
            f"{array_sql([field_type(f)[0] for f in fields])} AS types",
            f"{array_sql([field_type(f)[1] for f in fields])} AS modes",
            f"array({', '.join(sums)}) AS sizes",
        )

    per_table = each_table(totals, with_schemas(spark, refs))
    entries = F.posexplode(F.arrays_zip("columns", "types", "modes", "sizes")).alias("pos", "c")
    return union_all(per_table).select("table_id", "rows", entries).select(
        "table_id",
        "rows",
        (F.col("pos") + 1).alias("ordinal"),
        F.col("c.columns").alias("column"),
        F.col("c.types").alias("type"),
        F.col("c.modes").alias("mode"),
        F.col("c.sizes").alias("logical_bytes"),
    )


def sample_rows(df: DataFrame, limit: int = SAMPLE_ROWS, order: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of a table, scalar columns only.

    Without ``order`` this is a plain limit, which stops after the first
    partitions. With it the sample is deterministic: the leading order column
    is read alone to find its ``limit``-th smallest value, and that bound is
    pushed into the scan of the other columns. Null rows come last and fill the
    sample where fewer than ``limit`` others exist.
    """
    scalars = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    narrow = df.select(*[f"`{name}`" for name in scalars])
    if not order:
        return narrow.limit(limit)
    lead = F.col(f"`{order[0]}`")
    smallest = df.select(lead.alias("lead")).where(lead.isNotNull()).orderBy("lead").limit(limit)
    rest = [F.col(f"`{name}`") for name in (*order[1:], *[s for s in scalars if s not in order])]
    near = narrow.where(lead <= smallest.agg(F.max("lead")).scalar())
    # A plan of its own: merged with the bound's it would keep the bound out of the scan.
    some = df.where(lead.isNotNull()).select(lead.alias("some")).limit(limit)
    last = narrow.where(lead.isNull() & (some.agg(F.count("some")).scalar() < limit)).orderBy(*rest).limit(limit)
    return near.union(last).orderBy(lead.asc_nulls_last(), *rest).limit(limit)


def sample_cells(spark: SparkSession, refs: list[TableRef], limit: int = SAMPLE_ROWS) -> DataFrame:
    """Sample rows of all tables in long form, one rendered cell per row."""
    if limit <= 0:
        return spark.createDataFrame([], CELL_SCHEMA)

    def rendered(ref: TableRef) -> DataFrame | None:
        try:
            sample = sample_rows(ref.read(spark), limit, ref.sample_order)
        except AnalysisException:  # a table that cannot be read has no sample, its card is still made
            return None
        fields = sample.schema.fields
        if not fields:
            return None
        # A limited sample is one partition in its order, which the id keeps.
        return sample.selectExpr(
            f"{array_sql([ref.table_id])}[0] AS table_id",
            "monotonically_increasing_id() AS place",
            f"{array_sql([f.name for f in fields])} AS columns",
            f"{array_sql([field_type(f)[0] for f in fields])} AS types",
            f"array({', '.join(raw_text_sql(f.name, f.dataType) for f in fields)}) AS texts",
        )

    opened = with_schemas(spark, [ref for ref in refs if ref.sampled])
    per_table = [frame for frame in each_table(rendered, opened) if frame is not None]
    if not per_table:
        return spark.createDataFrame([], CELL_SCHEMA)
    row_no = F.row_number().over(W.partitionBy("table_id").orderBy("place"))
    numbered = union_all(per_table).withColumn("row_no", row_no)
    cells = numbered.select("table_id", "row_no", F.posexplode(F.arrays_zip("columns", "types", "texts")).alias("pos", "c"))
    return cells.select(
        "table_id",
        (F.col("pos") + 1).alias("ordinal"),
        F.col("c.columns").alias("column"),
        F.col("c.types").alias("type"),
        "row_no",
        format_cell(shown_text(F.col("c.texts"), F.col("c.types"))).alias("cell"),
    )


def distinctive_values(cells: DataFrame, max_columns: int = MAX_VALUE_COLUMNS) -> DataFrame:
    """Sampled text values that say what a table holds, in column order.

    Left out: place columns, columns whose sampled values are all distinct, and
    those with long or only number-like values.
    """
    value = F.when(F.col("cell") != "NULL", F.col("cell"))
    stats = (
        cells.where((F.col("type") == "STRING") & ~F.col("column").rlike("(?i)" + PLACE_COLUMNS))
        .groupBy("table_id", "ordinal", "column")
        .agg(
            F.sort_array(F.collect_set(value)).alias("found"),
            F.count(F.lit(1)).alias("rows"),
            F.max(F.length(value)).alias("longest"),
            F.bool_and(value.rlike(NUMBER_LIKE)).alias("number_like"),
        )
    )
    kept = stats.where(
        (F.size("found") > 0)
        & (F.size("found") != F.col("rows"))
        & (F.col("longest") <= MAX_VALUE_CHARS)
        & ~F.col("number_like")
    )
    order = F.row_number().over(W.partitionBy("table_id").orderBy("ordinal"))
    return (
        kept.withColumn("position", order)
        .where(F.col("position") <= max_columns)
        .select("table_id", "position", "column", F.array_join("found", ", ").alias("values"))
    )
