"""Joins by time: the row that held at a moment, and the rows inside an interval.

Neither compares all rows of a key: as-of joins are ordered scans over range
segments, so a key with most rows is split and one row is carried over each
border; interval joins meet in time bins, so a hot key is split by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteward.operators.segments import SEGMENT, earlier_segments, ordered_segments, with_carry, within_segment

# Bins that an interval may span before a coarser level takes it, and levels of bins.
SPAN, LEVELS = 16, 8


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tie: str, segments: int | None = None
) -> DataFrame:
    """``left`` with ``matched``: the latest row of ``right`` of the same keys, at or before ``left_at``.

    ``matched`` is a struct of the columns of ``right`` other than the keys, null
    if there is none. Of rows at the same time the largest ``tie`` counts. Null
    keys are a key of their own; rows of ``right`` without a time match nothing,
    and rows of ``left`` without one have no match. Every row of ``left`` comes
    back once.
    """
    values = F.struct(*[F.col(f"`{name}`") for name in right.columns if name not in keys])
    own = F.struct(*[F.col(f"`{name}`") for name in left.columns])
    seen = right.where(F.col(right_at).isNotNull()).select(
        *keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), values.alias("__value")
    )
    asked = left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), own.alias("__own"))
    rows = ordered_segments(seen.unionByName(asked, allowMissingColumns=True), keys, ["__at", "__side", "__tie"], segments)
    rows = rows.withColumns({f"__key{i}": F.coalesce(F.to_json(F.struct(key)), F.lit("")) for i, key in enumerate(keys)})
    key_names = [f"__key{i}" for i in range(len(keys))]
    latest = F.last("__value", ignorenulls=True)
    order = within_segment(key_names, ["__at", "__side", "__tie"]).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = rows.withColumn("__here", latest.over(order))
    at = F.struct("__at", "__tie")
    ends = rows.where("__side = 0").groupBy(*key_names, SEGMENT).agg(F.max_by("__value", at).alias("__value"))
    # every segment of a key, those without a row of ``right`` too, passes on what came before it
    places = rows.groupBy(*key_names, SEGMENT).agg(F.lit(1).alias("__one"))
    summary = places.join(ends, [*key_names, SEGMENT], "left")
    carried = with_carry(filled.where("__side = 1"), summary, key_names, {"__before": latest.over(earlier_segments(key_names))})
    held = F.when(F.col("__at").isNotNull(), F.coalesce("__here", "__before"))
    return carried.select("__own.*", held.alias("matched"))


def interval_join(
    spans: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, width_seconds: int
) -> DataFrame:
    """All pairs of a span and a point of the same keys with ``start <= at <= end``, as ``span`` and ``point`` structs.

    ``width_seconds`` is the usual length of a span. A span is a row for each bin
    it touches, at most ``SPAN`` + 1 of them: longer ones take coarser bins, each
    level ``SPAN`` times as wide; the last takes all that are longer still. A
    point is a row for each level that some span needs. Spans and points without
    a time, spans that end before they start, and null keys have no pairs.
    """
    low, high = F.unix_micros(F.col(start).cast("timestamp")), F.unix_micros(F.col(end).cast("timestamp"))
    usable = spans.where(F.col(start) <= F.col(end))
    width = width_seconds * 1_000_000
    levels = [width * SPAN**n for n in range(LEVELS) if n == 0 or width * SPAN**n < 1 << 58]  # spans of a level fit a long
    level = sum(((high - low > F.lit(w).cast("long") * SPAN).cast("int") for w in levels[:-1]), F.lit(0))
    of_level = F.element_at(F.array(*[F.lit(w).cast("long") for w in levels]), F.col("__level") + 1)

    def bin_of(moment):
        return F.floor(moment / of_level)

    leveled = usable.select(*keys, F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("span"), level.alias("__level"), low.alias("__low"), high.alias("__high"))
    binned = leveled.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__low")), bin_of(F.col("__high")))))
    # at most one row per level
    used = [r["__level"] for r in leveled.select("__level").distinct().collect()]
    moments = points.where(F.col(at).isNotNull()).select(
        *keys, F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("point"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("__moment"),
        F.explode(F.array(*[F.lit(n) for n in used]).cast("array<int>")).alias("__level"),
    )
    moments = moments.withColumn("__bin", bin_of(F.col("__moment")))
    met = binned.join(moments, [*keys, "__level", "__bin"])
    return met.where(F.col("__moment").between(F.col("__low"), F.col("__high"))).select(*keys, "span", "point")
