"""Near duplicates by 64-bit SimHash fingerprints, compared exactly in tiles.

A fingerprint is the majority vote, bit by bit, of the XXH64 hashes (seed 42) of a
text's word shingles. Distinct fingerprints are laid out in tiles by their
population counts, one count for each 16-bit (or 8-bit) segment. The counts of
two fingerprints cannot differ by more than their differing bits, so a pair of
tiles whose counts differ by more than the radius is skipped; every other pair
of tiles is compared whole with exclusive-or and bit counts. Tiles hold at most
about 1,024 fingerprints, equal fingerprints are compared once, and a pair of
tiles gives the edges of a spanning forest of its links, not all its pairs.

Defined results: texts without words (null, empty, blank) have fingerprint zero
and link like any other; texts with fewer words than a shingle are one shingle;
repeated rows are near duplicates of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.llm.batches import as_bytes, fresh_names, map_columns, table
from tablesteward.llm.components import connected_components
from tablesteward.session import materialize

# Fixed values of the fingerprint.
SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2

TILE = 1024
# Above so many distinct fingerprints, tiles are laid out by 8 counts instead of 4.
FINE_LAYOUT = 1 << 24

# Hashes turned into votes at once, whatever the length of a text.
BLOCK = 1 << 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BYTE_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text, as an unsigned number."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    width = min(width, len(words))
    count = len(words) - width + 1
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, count, BLOCK):
        shingles = zip(*(words[start + k : min(start + BLOCK, count) + k] for k in range(width)), strict=True)
        hashes = np.array([hashed(join(shingle), SEED) for shingle in shingles], dtype="<u8")
        cells = hashes.view(np.uint8).reshape(-1, 8) + BYTE_PLACE
        counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
        votes += (counts @ BYTE_BITS).ravel()
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``id, text_key, fp``: the fingerprint as a signed long, and a hash that tells rows of one id apart."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text")
    )

    def run(batch) -> dict:
        values = np.array([fingerprint(text, width) for text in as_bytes(batch["text"])], dtype=np.uint64)
        return {"id": batch["id"], "text_key": batch["text_key"], "fp": pa.array(values.view(np.int64))}

    return map_columns(rows, run, T.StructType.fromDDL("id long, text_key long, fp long"))


def half_offsets(segments: int, radius: int) -> list[int]:
    """Codes of count differences within the radius, one of each opposite pair, zero left out."""
    found = set()
    for places in product(range(segments), repeat=radius):
        for signs in product((-1, 0, 1), repeat=radius):
            steps = [0] * segments
            for place, sign in zip(places, signs, strict=True):
                steps[place] += sign
            if any(steps) and next(s for s in steps if s) > 0:
                found.add(sum(step * 32**k for k, step in enumerate(steps)))
    return sorted(found)


def bucket_code(fp: Column, segments: int, radius: int) -> Column:
    """The segments' population counts as digits; room for the radius on either side keeps digits apart."""
    bits = 64 // segments
    code = F.lit(0).cast("long")
    for k in range(segments):
        part = F.shiftrightunsigned(fp, k * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        code = code + (F.bit_count(part).cast("long") + radius) * F.lit(32**k).cast("long")
    return code


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two sets of fingerprints."""
    at, to = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
    nodes, place = np.unique(np.concatenate([left[at], right[to]]), return_inverse=True)
    a, b = place[: len(at)], place[len(at) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def compared(rows: DataFrame, radius: int) -> DataFrame:
    """Edges out of ``home, visitor, fp`` rows: a tile's own rows, then those it is compared with."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own = None, np.empty(0, dtype=np.uint64)
        done = False

        def edges(other: np.ndarray) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(own), TILE):
                a, b = forest(own[start : start + TILE], other, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        for batch in batches:
            homes, visits = (np.asarray(batch[name]) for name in ("home", "visitor"))
            values = np.asarray(batch["fp"]).view(np.uint64)
            cuts = np.flatnonzero((homes[1:] != homes[:-1]) | (visits[1:] != visits[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(homes)], strict=True):
                if start == end:
                    continue
                if homes[start] != tile:
                    if not done:
                        yield from edges(own)
                    tile, own, done = homes[start], np.empty(0, dtype=np.uint64), False
                if not visits[start]:
                    own = np.concatenate([own, values[start:end]])
                    continue
                if not done:
                    yield from edges(own)
                    done = True
                for at in range(start, end, TILE):
                    yield from edges(values[at : min(at + TILE, end)])
        if not done:
            yield from edges(own)

    return rows.mapInArrow(run, "a long, b long")


def linked(distinct: DataFrame, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (column ``fp``, no repeats) within the radius of each other.

    Tile sizes per bucket are at most 21**segments rows of two numbers; Spark
    broadcasts them only while they are small.
    """
    segments = segments or (4 if distinct.count() <= FINE_LAYOUT else 8)
    placed = distinct.select("fp", bucket_code(F.col("fp"), segments, radius).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = placed.join(sizes, "bucket").select(
        "fp", "bucket", "tiles", F.pmod(F.xxhash64("fp"), "tiles").cast("int").alias("tile")
    )
    tiled = materialize(tiled, "simhash-tiles")
    home = F.xxhash64("bucket", "tile")
    own = tiled.select(home.alias("home"), F.lit(False).alias("visitor"), "fp")
    earlier = (
        tiled.where("tile > 0")
        .select("fp", "bucket", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("tile"))
        .select(home.alias("home"), F.lit(True).alias("visitor"), "fp")
    )
    steps = F.array(*[F.lit(step).cast("long") for step in half_offsets(segments, radius)])
    known = tiled.groupBy("bucket").agg(F.first("tiles").alias("tiles"))
    nearby = (
        tiled.select("fp", F.explode(F.transform(steps, lambda step: F.col("bucket") - step)).alias("bucket"))
        .join(known, "bucket")
        .select("fp", "bucket", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
        .select(home.alias("home"), F.lit(True).alias("visitor"), "fp")
    )
    rows = own.union(earlier).union(nearby)
    return compared(rows.repartition("home").sortWithinPartitions("home", "visitor"), radius)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    segments: int | None = None,
) -> DataFrame:
    """``id, text_key, fp, class, component_id`` for each row: the smallest id reachable over links."""
    marked = materialize(fingerprints(docs, id_column, text_column, width), "simhash-fingerprints")
    groups = materialize(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-groups")
    labels = connected_components(linked(groups.select("fp"), radius, segments), "a", "b")
    labelled = groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("label", "fp").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    classes = materialize(labelled.join(least, "label").select("fp", F.col("label").alias("class"), "component_id"), "simhash-classes")
    return marked.join(classes, "fp").select("id", "text_key", "fp", "class", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The document with the smallest id of each component, in all columns of ``docs``.

    Rows are found again by id and text hash; of rows equal in both, one stays.
    """
    rows = near_duplicates(docs, id_column, text_column).groupBy("class", "id", "text_key").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "text_key", "times"))
    chosen = materialize(rows.groupBy("class").agg(first.alias("it")).select("it.id", "it.text_key", "it.times"), "simhash-kept")

    own_id, key = fresh_names(docs, "id", "key")

    def found(times: Column) -> DataFrame:
        kept = chosen.where(times).select(F.col("id").alias(own_id), F.col("text_key").alias(key))
        same = F.col(id_column).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_column) == F.col(key))
        return docs.join(kept, same, "left_semi")

    repeated = F.col("times") > 1
    if chosen.where(repeated).isEmpty():
        return found(~repeated)
    return found(~repeated).union(found(repeated).dropDuplicates([id_column, text_column]))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES = {"op4_simhash": op4_simhash}
