"""Trace records of callbacks, and the spacing of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.operators.segments import SEGMENT, earlier_segments, ordered_segments, with_carry, within_segment

# Fixed value: least time between two calls.
MIN_INTERVAL_SECONDS = 1.0


def trace_rows(records: DataFrame, keep_partial: bool = False) -> DataFrame:
    """``ts, kind, agent, fields`` with null and empty fields left out.

    ``records`` has a ``fields`` map and a ``partial`` flag; partial model
    responses are dropped unless asked for.
    """
    kept = records if keep_partial else records.where(~((F.col("kind") == "llm_response") & F.col("partial")))
    filled = F.map_filter("fields", lambda _, value: value.isNotNull() & (value != ""))
    return kept.select("ts", "kind", "agent", filled.alias("fields"))


def trace_rollup(trace: DataFrame) -> DataFrame:
    """Blocks, errors and tokens per agent and kind; token fields that are no number count as none."""
    tokens_in = F.try_element_at("fields", F.lit("tokens_in")).try_cast("bigint")
    tokens_out = F.try_element_at("fields", F.lit("tokens_out")).try_cast("bigint")
    failed = F.try_element_at("fields", F.lit("error")).isNotNull()
    return trace.groupBy("agent", "kind").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(failed).alias("errors"),
        F.coalesce(F.sum(tokens_in), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(tokens_out), F.lit(0)).alias("tokens_out"),
        F.sum(F.size("fields")).alias("fields"),
    )


def _micros(calls: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch of a timestamp, or of a zoneless one as it reads."""
    if isinstance(calls.schema[ts].dataType, T.TimestampType):
        return F.unix_micros(ts)
    since = F.col(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("decimal(18,6)") * 1_000_000).cast("bigint")


def call_gaps(calls: DataFrame, caller: str, ts: str, call_id: str, interval: float = MIN_INTERVAL_SECONDS) -> DataFrame:
    """``caller, call_id, gap_micros, wait_micros``: calls closer than ``interval``.

    A call's gap is the time since the caller's call before it; the wait is what
    is missing to the interval. Callers of any size are split into segments.
    """
    keys, order = [caller], ["micros", call_id]
    rows = ordered_segments(calls.select(caller, call_id, _micros(calls, ts).alias("micros")), keys, order)
    local = rows.withColumn("before", F.lag("micros").over(within_segment(keys, order)))
    summary = rows.groupBy(*keys, SEGMENT).agg(F.max("micros").alias("last"))
    carried = with_carry(local, summary, keys, {"last_before": F.max("last").over(earlier_segments(keys))})
    gap = F.col("micros") - F.coalesce("before", "last_before")
    step = int(round(interval * 1_000_000))
    return (
        carried.withColumn("gap_micros", gap)
        .where(F.col("gap_micros") < step)
        .select(caller, call_id, "gap_micros", (F.lit(step) - F.col("gap_micros")).alias("wait_micros"))
    )


def paced_release(calls: DataFrame, caller: str, ts: str, call_id: str, interval: float = MIN_INTERVAL_SECONDS) -> DataFrame:
    """When each call may run if a caller's calls keep ``interval`` apart.

    The i-th release is ``i*d + max(t_j - j*d)`` over ``j <= i``: a running
    maximum. Within a segment it runs over local positions; what earlier
    segments add is their row count and the best of their shifted maxima.
    """
    keys, order = [caller], ["micros", call_id]
    step = int(round(interval * 1_000_000))
    rows = ordered_segments(calls.select(caller, call_id, _micros(calls, ts).alias("micros")), keys, order)
    window = within_segment(keys, order)
    local = rows.withColumn("i", F.row_number().over(window).cast("bigint") - 1)
    local = local.withColumn("slack", F.col("micros") - F.col("i") * step)
    local = local.withColumn("peak", F.max("slack").over(window))
    summary = local.groupBy(*keys, SEGMENT).agg(F.max("slack").alias("seg_peak"), F.count(F.lit(1)).alias("seg_rows"))
    earlier = earlier_segments(keys)
    summary = summary.withColumn("start", F.coalesce(F.sum("seg_rows").over(earlier), F.lit(0)))
    summary = summary.withColumn("shifted", F.col("seg_peak") - F.col("start") * step)
    carried = with_carry(
        local,
        summary,
        keys,
        {"rows_before": F.max("start").over(earlier.rowsBetween(0, 0)), "peak_before": F.max("shifted").over(earlier)},
    )
    start = F.coalesce("rows_before", F.lit(0))
    peak = F.greatest(F.col("peak") - start * step, F.col("peak_before"))
    release = (start + F.col("i")) * step + peak
    return carried.select(
        caller, call_id, "micros", release.alias("release_micros"), (release - F.col("micros")).alias("wait_micros")
    )
