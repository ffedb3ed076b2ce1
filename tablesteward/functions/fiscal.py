"""Local calendar and fiscal year of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The time zone of the calendar and the month the year starts in.
ZONE = "America/Sao_Paulo"
FISCAL_START_MONTH = 4


def local_clock(moment: Column, zone: str = ZONE, source_zone: Column | None = None) -> Column:
    """Wall-clock time in ``zone`` of a zoneless timestamp (UTC unless told)."""
    return F.convert_timezone(source_zone if source_zone is not None else F.lit("UTC"), F.lit(zone), moment)


def fiscal_year(local: Column) -> Column:
    """The calendar year in which the fiscal year of ``local`` began."""
    return F.year(local) - (F.month(local) < FISCAL_START_MONTH).cast("int")


def with_calendar(df: DataFrame, moment: str, zone: str = ZONE) -> DataFrame:
    """Add local time, date, month label, and current and previous fiscal year."""
    value, source = F.col(moment), None
    if isinstance(df.schema[moment].dataType, T.TimestampType):
        value, source = value.cast("timestamp_ntz"), F.current_timezone()
    local = local_clock(value, zone, source)
    # Formats take a date, so the session's own time zone cannot shift anything.
    day = local.cast("date")
    return df.withColumns(
        {
            "local_time": F.substring(local.cast("string"), 1, 19),
            "local_date": F.date_format(day, "dd/MM/yyyy"),
            "month_label": F.date_format(day, "MMMM/yyyy"),
            "fiscal_year": fiscal_year(local),
            "previous_fiscal_year": fiscal_year(local) - 1,
        }
    )
