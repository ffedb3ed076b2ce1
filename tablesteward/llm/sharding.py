"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of text, id), so equal texts are neighbours. A
sample, in which each record appears with a chance in proportion to its bytes,
gives quantile boundaries of many more ranges than shards; boundaries fall
between texts, except inside a text whose copies fill whole ranges. Every
record's range is found by binary search; ranges that turn out overfull are
subdivided by a sample of their own. Inside its range a record knows the bytes
before it, and with the sums of the ranges before, its place among all bytes,
which names its shard. A group of equal texts goes into one shard as a whole
unless it is larger than a hundredth of a shard; then it is cut between copies.

What reaches the driver is bounded by settings: the sample (``RANGE_SAMPLE``
keys per range) and one sum per range.

Defined results: a null text has no bytes and is grouped with empty ones; a
record weighs its bytes plus one; null ids come first; rows equal in id and
text take neighbouring slots; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.llm.batches import fresh_names, map_columns, table
from tablesteward.session import materialize

SHARDS = 8
RANGES_PER_SHARD = 16
RANGE_ROWS = 1_000_000
RANGE_SAMPLE = 64
OVERFULL = 2.0
WHOLE_GROUP = 0.01
FIRST = -(1 << 63)


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, place, size, text_crc32, text_hash`` for each row; ``place`` orders copies of a text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    identity = F.col(id_column).cast("long")
    return docs.select(
        identity.alias("id"),
        F.coalesce(identity, F.lit(FIRST)).alias("place"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )


def sampled_boundaries(rows: DataFrame, total: int, ranges: int, seed: int) -> list[tuple[int, int]]:
    """Boundaries at the quantiles of a sample of about ``RANGE_SAMPLE`` keys per range."""
    wanted = ranges * RANGE_SAMPLE
    draw = F.pmod(F.xxhash64("text_hash", "place", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = F.col("size") * F.lit(wanted / max(total, 1))
    sample = rows.where(draw < rate).select("text_hash", "place", F.greatest("size", F.lit(total / wanted)).alias("weight"))
    keys = sorted(tuple(row) for row in sample.collect())
    if not keys:
        return []
    weights = np.cumsum([weight for _, _, weight in keys])
    marks = np.searchsorted(weights, weights[-1] * np.arange(1, ranges) / ranges)
    found: list[tuple[int, int]] = []
    for text_hash, place, _ in (keys[m] for m in marks):
        # the first boundary inside a text moves to its start; further ones cut a text that fills whole ranges
        key = (text_hash, place) if found and found[-1][0] == text_hash else (text_hash, FIRST)
        if key not in found[-1:]:
            found.append(key)
    return found


def in_range(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with the number of boundaries at or before each key."""
    hashes = np.array([h for h, _ in bounds], dtype=np.int64)
    places = np.array([p for _, p in bounds], dtype=np.int64)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())])

    def run(batch) -> dict:
        own, place = np.asarray(batch["text_hash"]), np.asarray(batch["place"])
        low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        found = low.copy()
        tied = np.flatnonzero(low < high)
        for at in np.unique(low[tied]):
            mine = tied[low[tied] == at]
            found[mine] = at + np.searchsorted(places[at : high[mine[0]]], place[mine], "right")
        return {name: batch[name] for name in names} | {"range": pa.array(found.astype(np.int32))}

    return map_columns(rows, run, schema)


def range_sums(rows: DataFrame, bounds: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    sums = in_range(rows, bounds).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return {row["range"]: (row["bytes"], row["n"]) for row in sums.collect()}


def splitters(rows: DataFrame, shards: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Boundaries that leave no range overfull, and each range's bytes and rows."""
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    ranges = max(shards * RANGES_PER_SHARD, math.ceil(count / RANGE_ROWS))
    bounds = sampled_boundaries(rows, total or 0, ranges, seed=0)
    sums = range_sums(rows, bounds)
    usual = max(1.0, (total or 0) / ranges)
    for again in range(1, 9):
        overfull = {r: bytes_ for r, (bytes_, n) in sums.items() if bytes_ > OVERFULL * usual and n > 1}
        if not overfull:
            break
        placed = in_range(rows, bounds)
        more = set(bounds)
        inside = placed.where(F.col("range").isin(list(overfull))).drop("range")
        parts = math.ceil(sum(overfull.values()) / usual)
        more |= set(sampled_boundaries(inside, sum(overfull.values()), max(2, 2 * parts), seed=again))
        if len(more) == len(bounds):
            break
        bounds = sorted(more)
        sums = range_sums(rows, bounds)
    return bounds, sums


def sharded(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS) -> DataFrame:
    """``id, size, text_crc32, text_hash, shard, slot`` for each row."""
    spark = docs.sparkSession
    rows = materialize(keyed(docs, id_column, text_column), "shard-keys")
    bounds, sums = splitters(rows, shards)
    total = sum(bytes_ for bytes_, _ in sums.values())
    starts, bytes_before, rows_before = [], 0, 0
    for number in sorted(sums):
        starts.append((number, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + sums[number][0], rows_before + sums[number][1]
    known = spark.createDataFrame(starts, "range int, bytes_before long, rows_before long")
    order = W.partitionBy("range").orderBy("text_hash", "place")
    group = W.partitionBy("range", "text_hash")
    before = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    ranked = (
        in_range(rows, bounds)
        .withColumns({"nth": F.row_number().over(order), "before": before})
        .withColumns({"group_bytes": F.sum("size").over(group), "group_before": F.min("before").over(group)})
        .join(known, "range")
    )
    whole = F.col("group_bytes") <= F.lit(WHOLE_GROUP * total / shards)
    middle = F.when(whole, F.col("group_before") + F.col("group_bytes") / 2).otherwise(F.col("before") + F.col("size") / 2)
    shard = F.least(F.floor((F.col("bytes_before") + middle) * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1))
    ranked = materialize(
        ranked.select(
            "id", "size", "text_crc32", "text_hash", shard.cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("nth"),
        ),
        "shard-rows",
    )
    first = ranked.groupBy("shard").agg(F.min("nth").alias("first"))
    return ranked.join(first, "shard").select("id", "size", "text_crc32", "text_hash", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS) -> None:
    """``docs`` as one folder of Parquet files per shard; files hold neighbouring slots.

    Columns of ``docs`` called ``shard`` or ``slot`` give way to the places.
    """
    places = materialize(sharded(docs, id_column, text_column, shards), "shard-places")
    docs = docs.drop("shard", "slot")
    id_name, hash_name = fresh_names(docs, "id", "hash")
    spots = places.groupBy(F.col("id").alias(id_name), F.col("text_hash").alias(hash_name)).agg(
        F.min("shard").alias("shard"), F.min("slot").alias("slot")
    )
    own_hash: Column = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    placed = docs.join(spots, F.col(id_column).cast("long").eqNullSafe(F.col(id_name)) & (own_hash == F.col(hash_name)))
    placed.repartitionByRange("shard", "slot").drop(id_name, hash_name).write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op7_sharding": op7_sharding}
