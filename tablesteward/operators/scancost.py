"""Bytes a query would scan: estimates, limits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteward.functions.text import format_bytes

# Fixed value: the default byte ceiling of one query.
MAX_BYTES = 20 * 1024**3

ADVICE = "LIMIT does not reduce the bytes read: select fewer columns and filter on the partition column"


def query_costs(query_columns: DataFrame, column_bytes: DataFrame, size: str = "logical_bytes") -> DataFrame:
    """``query_id, estimated_bytes`` from the columns each query reads.

    A column named twice by one query counts once. ``column_bytes`` should be a
    stored table: Spark then knows its size (a row per catalog column) and
    broadcasts it as long as it is small, whichever table most queries read.
    """
    used = query_columns.select("query_id", "table_id", "column").distinct()
    sizes = column_bytes.select("table_id", "column", F.col(size).alias("bytes"))
    return (
        used.join(sizes, ["table_id", "column"], "left")
        .groupBy("query_id")
        .agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("estimated_bytes"))
    )


def rejection_text(estimate: Column, limit: int) -> Column:
    return F.concat(
        F.lit("query would scan "), format_bytes(estimate), F.lit(", above the limit of "),
        format_bytes(F.lit(limit)), F.lit(f"; {ADVICE}"),
    )


def cost_verdict(costs: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Add ``status``, ``max_bytes_billed`` and ``error`` (strictly above the limit)."""
    over = F.col("estimated_bytes") > limit
    return costs.withColumns(
        {
            "status": F.when(over, F.lit("error")).otherwise(F.lit("success")),
            "max_bytes_billed": F.lit(limit).cast("bigint"),
            "error": F.when(over, rejection_text(F.col("estimated_bytes"), limit)),
        }
    )


def cost_report(costs: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """One row per status: queries, total and largest estimate, and their texts."""
    totals = cost_verdict(costs, limit).groupBy("status").agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("estimated_bytes").alias("total_bytes"),
        F.max("estimated_bytes").alias("largest_bytes"),
    )
    return totals.withColumn("total_text", format_bytes(F.col("total_bytes")))
