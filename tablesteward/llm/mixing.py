"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share by weight of all words, stopped at a multiple of
its size, the excess reshared by weight. A document is wanted ``target / size of
its source`` times: the whole part is certain, the rest is a fractional copy.
Fractional copies are settled in pairs: words move at random from one document
to the other, keeping their sum and every expectation, until one of the two is
whole. Documents are paired inside hash buckets; what is left of each source in
a bucket, one document at most, goes on to the bucket's parent in a reduction
tree, and the root's last document is rounded to the nearer side. So a source
misses its target by half a document at most.

Randomness comes from hashes of ids and texts, and buckets from the number of
rows, so reruns agree whatever the layout of files.

Defined results: sizes are words, a null text has none; sources rank by code
point with null last; documents without words are taken zero times; rows equal
in id and text are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.llm.batches import as_bytes, fresh_names, map_columns, table
from tablesteward.operators.segments import SEGMENT, ordered_segments, within_segment
from tablesteward.session import materialize

# Production settings: repeating weights, the most copies of a document, rows per
# bucket and children per node of the tree.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BUCKET_ROWS = 1024
FAN_IN = 16
SEED = 17

BIG = "decimal(38,0)"


def sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(text_column).alias("text_key"),
        F.col(source_column).cast("string").alias("source"),
        F.col(text_column).alias("text"),
    )

    def run(batch) -> dict:
        sizes = [len(text.split()) if text else 0 for text in as_bytes(batch["text"])]
        return {name: batch[name] for name in ("id", "text_key", "source")} | {"size": sizes}

    return map_columns(rows, run, T.StructType.fromDDL("id long, text_key long, source string, size long"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """``source, rank, source_size, target`` for each source.

    One aggregate over the sources for each round of resharing; sums are whole
    numbers, so targets do not depend on the order of rows.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    parts = ordered_segments(sums, [], ["unnamed", "source"])
    before = (
        parts.groupBy(SEGMENT)
        .agg(F.count("*").alias("n"))
        .select(SEGMENT, (F.sum("n").over(W.orderBy(SEGMENT)) - F.col("n")).alias("before"))
    )
    rank = F.row_number().over(within_segment([], ["unnamed", "source"])) + F.col("before") - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        parts.join(before, SEGMENT)
        .select("source", rank.alias("rank"), "source_size")
        .withColumn("weight", weight.cast("long"))
        .withColumn("most", F.col("source_size") * most_copies)
    )
    ranked = materialize(ranked, "mixing-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = Fraction(0)
    while True:
        full = F.col("most").cast(BIG) * F.lit(level.denominator).cast(BIG) <= F.col("weight") * F.lit(level.numerator).cast(BIG)
        held, open_weight = ranked.agg(
            F.sum(F.when(full, F.col("most"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        raised = Fraction(total - (held or 0), open_weight) if open_weight else level
        if raised == level:
            break
        level = raised
    share = F.col("weight") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    return ranked.select("source", "rank", "source_size", F.least(F.col("most").cast("double"), share).alias("target"))


def chance(level: int, *numbers: int) -> float:
    """A number in [0, 1) that only the arguments decide."""
    packed = struct.pack(f"<{len(numbers)}q", *numbers)
    return xxhash.xxh64_intdigest(packed, SEED + level) / 2**64


def settle(a: list, b: list, level: int) -> None:
    """Move words between two fractional copies, ``[id, text_key, size, part]``, until one is whole."""
    up = min((1.0 - a[3]) * a[2], b[3] * b[2])
    down = min(a[3] * a[2], (1.0 - b[3]) * b[2])
    if chance(level, a[0], a[1], b[0], b[1]) * (up + down) < down:
        give, take, words, full_take, empty_give = b, a, up, up == (1.0 - a[3]) * a[2], up == b[3] * b[2]
    else:
        give, take, words, full_take, empty_give = a, b, down, down == (1.0 - b[3]) * b[2], down == a[3] * a[2]
    give[3] = 0.0 if empty_give else give[3] - words / give[2]
    take[3] = 1.0 if full_take else take[3] + words / take[2]


def settled(rows: DataFrame, level: int) -> DataFrame:
    """Rows of sorted buckets with their parts settled but for one of each source and bucket."""
    schema = rows.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, open_row, open_at = None, None, None
        for batch in batches:
            columns = [batch[name].to_pylist() for name in names]
            keep = {name: i for i, name in enumerate(names)}
            parts, out = columns[keep["part"]], []
            for at, (bucket, rank, id_, key, size) in enumerate(
                zip(*(columns[keep[n]] for n in ("bucket", "rank", "id", "text_key", "size")), strict=True)
            ):
                if (bucket, rank) != place:
                    if open_row is not None and open_at is None:
                        out.append(open_row)
                    place, open_row, open_at = (bucket, rank), None, None
                if not 0.0 < parts[at] < 1.0:
                    continue
                here = [id_ if id_ is not None else -1, key, size, parts[at]]
                if open_row is None:
                    open_row, open_at = here + [tuple(column[at] for column in columns)], at
                    continue
                settle(open_row, here, level)
                parts[at] = here[3]
                if open_at is not None:
                    parts[open_at] = open_row[3]
                if not 0.0 < open_row[3] < 1.0:
                    if open_at is None:
                        out.append(open_row)
                    open_row, open_at = None, None
                    if 0.0 < here[3] < 1.0:
                        open_row, open_at = here + [tuple(column[at] for column in columns)], at
            # the open row leaves its batch and is told when it is settled
            if open_at is not None:
                held = open_at
                for column in columns:
                    del column[held]
                open_at = None
            columns = [
                column + [row[3] if name == "part" else row[4][keep[name]] for row in out]
                for name, column in zip(names, columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, batch.schema, strict=True)], names=names)
            kinds = batch.schema
        if open_row is not None:
            last = [row if name != "part" else open_row[3] for name, row in zip(names, open_row[4], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(last, kinds, strict=True)], names=names)

    order = ["bucket", "rank", "id", "text_key"]
    return rows.repartition("bucket").sortWithinPartitions(*order).mapInArrow(run, schema)


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
) -> DataFrame:
    """``id, text_key, size, source_size, target, copies`` for each row."""
    rows = materialize(sized(docs, id_column, text_column, source_column), "mixing-sizes")
    sources = materialize(source_targets(rows, weights, most_copies), "mixing-targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("wanted"))
    buckets, count = 1, rows.count()
    while buckets * BUCKET_ROWS < count:
        buckets *= 2
    placed = (
        rows.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("wanted", F.least(wanted, F.lit(float(most_copies))))
        .select(
            "id", "text_key", "size", "source_size", "target", "rank",
            F.pmod(F.xxhash64("id", "text_key"), F.lit(buckets)).alias("bucket"),
            whole.cast("int").alias("whole"),
            F.when(F.col("size") > 0, F.col("wanted") - whole).otherwise(0.0).alias("part"),
        )
    )
    done, level = None, 0
    while True:
        level_rows = materialize(settled(placed, level), f"mixing-level{level}")
        fractional = (F.col("part") > 0) & (F.col("part") < 1)
        decided = level_rows.where(~fractional)
        done = decided if done is None else done.union(decided)
        if buckets == 1:
            last = level_rows.where(fractional)
            break
        buckets = -(-buckets // FAN_IN)
        placed = level_rows.where(fractional).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        level += 1
    done = done.union(last.withColumn("part", F.when(F.col("part") >= 0.5, 1.0).otherwise(0.0)))
    return done.select(
        "id", "text_key", "size", "source_size", "target", (F.col("whole") + F.col("part").cast("int")).alias("copies")
    )


def repeated_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; documents taken zero times go.

    Rows equal in id and text share their copies. The copies grow with ``docs``, so
    they are never broadcast: texts move in the join once, at any size.
    """
    own_id, key, copies, rows_of, copy = fresh_names(docs, "id", "key", "copies", "rows", "copy")
    taken = mixed(docs, id_column, text_column, **settings).groupBy("id", "text_key").agg(
        F.sum("copies").cast("int").alias(copies), F.count("*").alias(rows_of)
    )
    taken = taken.where(F.col(copies) > 0).withColumnsRenamed({"id": own_id, "text_key": key})
    taken = materialize(taken, "mixing-copies")
    names = [F.col(f"`{name}`") for name in docs.columns]

    def found(rows: Column) -> DataFrame:
        of_row = F.col(id_column).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_column) == F.col(key))
        return docs.join(taken.where(rows).drop(rows_of).hint("merge"), of_row)

    def copied(rows: DataFrame) -> DataFrame:
        return rows.select(*names, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)

    single = copied(found(F.col(rows_of) == 1))
    if taken.where(F.col(rows_of) > 1).isEmpty():
        return single
    return single.union(copied(found(F.col(rows_of) > 1).dropDuplicates([id_column, key])))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


QUERIES = {"op3_mixing": op3_mixing}
