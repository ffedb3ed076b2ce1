"""Period-over-period change and composition over aggregated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteward.functions.arithmetic import change_columns, share_columns


def percentage_change(df: DataFrame, old: str, new: str, digits: int | None = 2) -> DataFrame:
    return df.withColumns(change_columns(F.col(old), F.col(new), digits))


def proportion(df: DataFrame, part: str, total: Column | None = None, digits: int | None = 2) -> DataFrame:
    """Add the share of ``part`` in the total (of the whole column unless given).

    The total is a scalar subquery, so no window gathers all rows in one task.
    """
    if total is None:
        total = df.agg(F.sum(part)).scalar()
    return df.withColumns(share_columns(F.col(part), total, digits))


def period_change(
    df: DataFrame, entity: list[str], period: Column, measure: Column, digits: int | None = 2
) -> DataFrame:
    """Total per entity and period, and its change from the period before.

    Rows are summed before the window, which then sees one row per period.
    """
    totals = df.groupBy(*entity, period.alias("period")).agg(F.sum(measure).alias("total"))
    before = F.lag("total").over(W.partitionBy(*entity).orderBy("period"))
    return totals.withColumn("previous", before).withColumns(change_columns(F.col("previous"), F.col("total"), digits))
