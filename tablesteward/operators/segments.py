"""Ordered scans within a key that stay split when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteward.session import materialize

SEGMENT = "segment"


# Rows one task can sort with ease; more rows make more segments.
SEGMENT_ROWS = 5_000_000


def ordered_segments(df: DataFrame, keys: list[str], order: list[str], segments: int | None = None) -> DataFrame:
    """``df`` with a ``segment`` number: contiguous ranges of (keys, order).

    Range partitioning splits a hot key over many segments as long as the order
    columns differ. The result is written once, so that every later branch sees
    the same segments.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = segments or max(usual, -(-df.count() // SEGMENT_ROWS))
    ranged = df.repartitionByRange(count, *keys, *order).withColumn(SEGMENT, F.spark_partition_id())
    return materialize(ranged, "segments")


def within_segment(keys: list[str], order: list[str]):
    return W.partitionBy(*keys, SEGMENT).orderBy(*order)


def with_carry(rows: DataFrame, summary: DataFrame, keys: list[str], carries: dict[str, Column]) -> DataFrame:
    """Join to each segment of a key what the key's earlier segments add up to.

    ``summary`` has a row per (keys, segment); ``carries`` are window
    expressions over the rows before. Only a key that crosses a range border has
    a second segment, so at most one row per segment is left to broadcast.
    """
    later = summary.withColumns(carries).withColumn(
        "__nth", F.row_number().over(W.partitionBy(*keys).orderBy(SEGMENT))
    )
    borders = later.where(F.col("__nth") > 1).select(*keys, SEGMENT, *carries)
    return rows.join(F.broadcast(borders), [*keys, SEGMENT], "left")


def earlier_segments(keys: list[str]):
    return W.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
