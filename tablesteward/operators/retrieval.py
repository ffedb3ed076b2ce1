"""Exact cosine retrieval of cards for questions, and the context text made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteward.functions.vectors import DIMENSIONS, QUERY_INSTRUCTION, Embedder, embed_column, vector_status
from tablesteward.session import materialize

# Cards per question, and the rule between cards.
TOP_K = 5
CARD_RULE = "\n\n---\n\n"
CONTEXT_HEADER = (
    "# TABLES FOR THIS QUESTION\n\n"
    "The tables below are the closest to the question. Use only these, by their full names.\n\n"
)
# Numbers per block: two blocks of doubles are 100 MB, a fair task. Small tables are cut
# into as many blocks as keep a cluster busy, none of fewer rows than the least.
BLOCK_NUMBERS = 4096 * 1536
BLOCK_ROWS, SIDE_BLOCKS = 4096, 8
# Rows of a matrix product.
QUESTION_ROWS, INDEX_ROWS = 512, 4096
DISTANCE_DIGITS = 6

PAIR_SCHEMA = "q_id {q}, doc_id {d}, distance double"


def block_count(rows: int, wanted: int, dimensions: int, rows_per_block: int | None = None) -> int:
    """How many blocks hold so many rows: ``wanted`` if they are neither too small nor too large then.

    Every block meets all blocks of the other side, so each further one sends
    that side once more.
    """
    if rows_per_block is None:
        most = max(1, BLOCK_NUMBERS // max(1, dimensions))
        rows_per_block = min(most, max(BLOCK_ROWS, -(-rows // wanted)))
    return max(1, -(-rows // rows_per_block))


def usual_width(index: DataFrame) -> int:
    """The width that most index vectors have; of two as frequent the larger."""
    widths = index.where(F.size("vector") > 0).groupBy(F.size("vector").alias("width")).count()
    most = widths.orderBy(F.desc("count"), F.desc("width")).first()
    return most["width"] if most else 0


def unusable_vectors(df: DataFrame, key: str, dimensions: int) -> DataFrame:
    """``key, status`` of the rows whose vectors a search leaves out."""
    return df.select(key, vector_status(F.col("vector"), dimensions).alias("status")).where(F.col("status") != "ok")


def best_pairs(k: int, max_distance: float | None, exclude_self: bool) -> Callable:
    """A cogroup function: the best ``k`` pairs of each question of a block with the rows of a block.

    The index block is read some rows at a time; a question takes from the later
    ones only what is nearer than the ``k`` it holds.
    """
    ceiling = float("inf") if max_distance is None else float(max_distance)
    digits, question_rows, index_rows = DISTANCE_DIGITS, QUESTION_ROWS, INDEX_ROWS
    step = 10.0**-digits

    def best(question_block, index_block):
        import numpy as np
        import pyarrow as pa

        def matrix(table):
            vectors = table.column("vector").combine_chunks()
            return vectors.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(vectors), -1)

        empty = pa.table(
            {
                "q_id": question_block.column("q_id").slice(0, 0),
                "doc_id": index_block.column("doc_id").slice(0, 0),
                "distance": pa.array([], pa.float64()),
            }
        )
        if question_block.num_rows == 0 or index_block.num_rows == 0:
            return empty
        # Ascending ids make a stable sort break ties the right way.
        index_block = index_block.sort_by("doc_id")
        asked, candidates = matrix(question_block), matrix(index_block)
        q_ids, d_ids = question_block.column("q_id"), index_block.column("doc_id")
        d_values = d_ids.to_numpy() if exclude_self else None
        q_values = q_ids.to_numpy() if exclude_self else None

        def nearest_of(start, stop):
            """Row, index row and distance of the best pairs of some questions, nearest first."""
            held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            # The least product that may still be one of the best, before rounding.
            least = np.full(stop - start, 1.0 - ceiling - 0.6 * step)
            for first in range(0, len(candidates), index_rows):
                products = asked[start:stop] @ candidates[first : first + index_rows].T
                bound = least[:, None]
                if first == 0 and k < products.shape[1]:
                    if exclude_self:
                        products[q_values[start:stop, None] == d_values[None, :index_rows]] = -np.inf
                    bound = np.maximum(bound, np.partition(products, -k, axis=1)[:, -k, None] - step)
                picked = np.flatnonzero(products >= bound)
                row, col = np.divmod(picked, products.shape[1])
                found = np.round(1.0 - products.ravel()[picked], digits) + 0.0
                col += first
                kept = np.isfinite(found) & (found <= ceiling)
                if exclude_self:
                    kept &= q_values[start + row] != d_values[col]
                if not kept.any():
                    continue
                row, col, found = (np.concatenate((old, new[kept])) for old, new in zip(held, (row, col, found), strict=True))
                order = np.lexsort((col, found, row))
                row, col, found = row[order], col[order], found[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
                held = row[rank < k], col[rank < k], found[rank < k]
                last = rank == k - 1
                # Later rows have larger ids, so a question that holds k takes no equal distance.
                least[row[last]] = 1.0 - found[last] + 0.4 * step
            return held[0] + start, held[1], held[2]

        parts = [nearest_of(start, min(start + question_rows, len(asked))) for start in range(0, len(asked), question_rows)]
        rows, cols, distances = (np.concatenate(column) for column in zip(*parts, strict=True))
        return pa.table(
            {"q_id": q_ids.take(pa.array(rows)), "doc_id": d_ids.take(pa.array(cols)), "distance": pa.array(distances)}
        )

    return best


def nearest(
    questions: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    max_distance: float | None = None,
    block_rows: int | None = None,
    exclude_self: bool = False,
    dimensions: int | None = None,
) -> DataFrame:
    """The ``k`` nearest index vectors of each question, nearest first.

    ``questions(q_id, vector)`` and ``index(doc_id, vector)`` hold unit vectors
    and unique ids. Both are cut into hashed blocks of bounded size (default: by
    the width of the vectors); each pair of blocks is one matrix product in one task, which passes on only its best
    ``k`` per question. No row pair is ever emitted beyond that and nothing goes
    through the driver. Equal distances (to six digits) go to the smaller id.
    Vectors that are missing, of another size than ``dimensions`` (default: the
    index's usual width), or not finite take no part; ``unusable_vectors`` lists
    them.
    """
    dimensions = usual_width(index) if dimensions is None else dimensions
    questions, index = (df.where(vector_status(F.col("vector"), dimensions) == "ok") for df in (questions, index))
    q_blocks = block_count(questions.select("q_id").count(), SIDE_BLOCKS, dimensions, block_rows)
    d_blocks = block_count(index.select("doc_id").count(), max(SIDE_BLOCKS, SIDE_BLOCKS**2 // q_blocks), dimensions, block_rows)
    q_type, d_type = (f.schema[c].dataType.simpleString() for f, c in ((questions, "q_id"), (index, "doc_id")))

    def blocked(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.select(
            key,
            "vector",
            F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
        )

    left = blocked(questions, "q_id", "q_block", q_blocks, "d_block", d_blocks)
    right = blocked(index, "doc_id", "d_block", d_blocks, "q_block", q_blocks)
    pairs = (
        left.groupBy("q_block", "d_block")
        .cogroup(right.groupBy("q_block", "d_block"))
        .applyInArrow(best_pairs(k, max_distance, exclude_self), PAIR_SCHEMA.format(q=q_type, d=d_type))
    )
    rank = F.row_number().over(W.partitionBy("q_id").orderBy("distance", "doc_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def context_blocks(hits: DataFrame, cards: DataFrame, header: str = CONTEXT_HEADER) -> DataFrame:
    """``q_id, context``: cards of the hits, nearest first, under a header.

    Hits without a card are dropped after the limit, so fewer may remain. A
    group has at most ``k`` rows.
    """
    shown = hits.join(cards.select("doc_id", "card"), "doc_id").where("card IS NOT NULL AND card != ''")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "card"))), lambda s: s["card"])
    return shown.groupBy("q_id").agg(F.concat(F.lit(header), F.array_join(ordered, CARD_RULE)).alias("context"))


def retrieve_contexts(
    questions: DataFrame,
    index: DataFrame,
    embedder: Embedder,
    k: int = TOP_K,
    max_distance: float | None = None,
    dimensions: int = DIMENSIONS,
    instruction: str = QUERY_INSTRUCTION,
    search: Callable[..., DataFrame] = nearest,
) -> DataFrame:
    """Add ``context`` to ``questions(question, ...)``; ``''`` where nothing fits.

    Each distinct non-empty text is embedded and searched once, whatever number
    of rows ask it. ``index`` has ``doc_id, embedding, card``. ``search`` is the
    exact ``nearest`` or ``hyperplanes.searcher`` for a large index.
    """
    key: Column = F.sha2("question", 256)
    asked = questions.where(F.col("question") != "").select("question").distinct()
    embedded = embed_column(asked, "question", "vector", embedder, instruction, dimensions)
    # Embedding is the dear step, so its result is kept once for all that follows.
    vectors = materialize(embedded.select(key.alias("q_id"), "vector"), "question-vectors")
    hits = search(vectors, index.select("doc_id", F.col("embedding").alias("vector")), k, max_distance)
    # Kept, so that its size is known: a question most rows ask is then either
    # broadcast or split by the adaptive skew join.
    found = materialize(context_blocks(hits, index), "contexts")
    return (
        questions.withColumn("__q_id", key)
        .join(found.withColumnRenamed("q_id", "__q_id"), "__q_id", "left")
        .drop("__q_id")
        .withColumn("context", F.coalesce("context", F.lit("")))
    )
