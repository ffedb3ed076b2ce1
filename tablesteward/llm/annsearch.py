"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a cell is a
pair of centroids. A query takes cells in the order of the summed inner products
of its halves with the two centroids, by a heap over the sorted half distances
(each pop offers the two neighbours of a pair). It stops when the cells taken
are expected to hold a given share of its k nearest: rows scatter around their
cell's centroids about normally, with the residual variance measured when the
codebooks were fitted, so the expected number of rows of a cell above any score
is known. Clustered vectors stop early; independent random ones need about half
of all cells. Rows of taken cells are reranked by the exact inner product of the
original vectors in double precision.

Codebooks are fitted on at most ``SAMPLE`` distinct vectors, picked by hash; all
rows are indexed. What is broadcast is bounded: two codebooks and one count per
cell, at most ``MOST_CENTROIDS`` squared. Equal vectors are searched once: a
vector keeps its ``k + 1`` smallest ids, which are all that any answer can hold,
and equal queries share one answer.

Defined results: vectors that are null, empty, zero, of another width than most
(of two as frequent the larger), or hold null or non-finite components take no
part; fewer than k candidates are all returned; ties go to the smaller id; rows equal in id and vector count once; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.llm.batches import table
from tablesteward.session import materialize

# Production settings.
K = 20
SAMPLE = 20_000
FEWEST_CENTROIDS, MOST_CENTROIDS = 8, 1024
FIT_ROUNDS = 8
EXPECTED_SHARE = 0.97
SCORE_BINS = 1024
BLOCK_ROWS = 4096
QUERY_BLOCK = 512
# Distinct queries that one task looks up cells for.
QUERIES_PER_TASK = 128


def usable(vector: Column) -> Column:
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(numbers & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), width)


def distinct_vectors(rows: DataFrame, most_ids: int) -> DataFrame:
    """``vector_key, vector, ids``: the smallest ids of each distinct vector, at most ``most_ids``.

    The limit per vector works before the shuffle, so a vector that a third of
    all rows share sends few of them.
    """
    order = W.partitionBy("vector").orderBy("id")
    few = rows.dropDuplicates(["id", "vector"]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most_ids)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vector_key", F.xxhash64("vector"))


def centroid_count(rows: int) -> int:
    wanted = 2 ** math.floor(math.log2(max(rows, 2)) / 2 - 1.5)
    return int(min(MOST_CENTROIDS, max(FEWEST_CENTROIDS, wanted)))


def nearest_centroid(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * points @ centroids.T, axis=1)


def fitted(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """A codebook by k-means over a sample that fits the driver."""
    rng = np.random.default_rng(seed)
    points = points[np.lexsort(points.T)]
    centroids = points[rng.choice(len(points), min(count, len(points)), replace=False)]
    for _ in range(FIT_ROUNDS):
        own = nearest_centroid(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=len(centroids))
        filled = sizes > 0
        centroids[filled] = sums[filled] / sizes[filled, None]
    return centroids


def normal_tail(x: np.ndarray) -> np.ndarray:
    """The chance above x of a standard normal number, to about 1e-4."""
    t = 1.0 / (1.0 + 0.33267 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.4361836 + t * (-0.1201676 + t * 0.9372980))
    return np.where(x < 0, 1.0 - tail, tail)


class MultiIndex:
    """Codebooks of the two halves, rows per cell, and the spread of rows around their cells."""

    def __init__(self, sample: np.ndarray, count: int):
        self.cut = max(1, sample.shape[1] // 2)
        self.books = [fitted(half, count, seed) for seed, half in enumerate(self.halves(sample))]
        rest = [half - book[nearest_centroid(half, book)] for half, book in zip(self.halves(sample), self.books, strict=True)]
        self.spread = [float((r**2).mean()) if r.size else 0.0 for r in rest]
        self.sizes = np.zeros((len(self.books[0]), len(self.books[1])), dtype=np.int64)

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[:, : self.cut], points[:, self.cut :]

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = (nearest_centroid(h, book) for h, book in zip(self.halves(points), self.books, strict=True))
        return first, second

    def border(self, scores: np.ndarray, deviation: float, wanted: int) -> float:
        """The score that ``wanted`` rows are expected to exceed.

        Cells are counted by score once, in ``SCORE_BINS`` bins; the search reads the bins.
        """
        least, most = float(scores.min()), float(scores.max())
        step = max(most - least, 1e-12) / SCORE_BINS
        bins = np.minimum(((scores - least) / step).astype(np.int64), SCORE_BINS - 1)
        rows = np.bincount(bins.ravel(), self.sizes.ravel(), SCORE_BINS)
        middles = least + (np.arange(SCORE_BINS) + 0.5) * step
        low, high = least - 9 * deviation, most + 9 * deviation
        for _ in range(32):
            middle = (low + high) / 2
            above = (rows * normal_tail((middle - middles) / max(deviation, 1e-12))).sum()
            low, high = (middle, high) if above > wanted else (low, middle)
        return (low + high) / 2

    def probes(self, query: np.ndarray, k: int) -> np.ndarray:
        """The cells to search, as a matrix of truth over centroid pairs."""
        ahead = [query[: self.cut] @ self.books[0].T, query[self.cut :] @ self.books[1].T]
        scores = ahead[0][:, None] + ahead[1][None, :]
        deviation = math.sqrt(
            self.spread[0] * (query[: self.cut] ** 2).sum() + self.spread[1] * (query[self.cut :] ** 2).sum()
        )
        wanted = min(k + 1, int(self.sizes.sum()))
        border = self.border(scores, deviation, wanted)
        expected = self.sizes * normal_tail((border - scores) / max(deviation, 1e-12))
        total = expected.sum()
        orders = [np.argsort(-a, kind="stable") for a in ahead]
        sorted_ahead = [a[o] for a, o in zip(ahead, orders, strict=True)]
        taken = np.zeros(self.sizes.shape, dtype=bool)
        heap, offered = [(-(sorted_ahead[0][0] + sorted_ahead[1][0]), 0, 0)], {(0, 0)}
        found, rows = 0.0, 0
        while heap and (found < EXPECTED_SHARE * total or rows < wanted):
            _, i, j = heapq.heappop(heap)
            cell = orders[0][i], orders[1][j]
            taken[cell] = True
            found += expected[cell]
            rows += int(self.sizes[cell])
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(orders[0]) and b < len(orders[1]) and (a, b) not in offered:
                    offered.add((a, b))
                    heapq.heappush(heap, (-(sorted_ahead[0][a] + sorted_ahead[1][b]), a, b))
        return taken


def fit_index(distinct: DataFrame, sample: int = SAMPLE) -> MultiIndex:
    """Codebooks out of a hash-picked sample of at most ``sample`` distinct vectors."""
    rows = distinct.count()
    picked = distinct.where(F.pmod(F.xxhash64("vector_key"), F.lit(max(1, -(-rows // sample)))) == 0) if rows > sample else distinct
    return MultiIndex(as_matrix(picked.select("vector").limit(sample).toArrow()["vector"].combine_chunks()), centroid_count(rows))


def assigned(distinct: DataFrame, shared) -> DataFrame:
    """The distinct vectors with their cell."""
    schema = T.StructType([*distinct.schema.fields, T.StructField("first", T.IntegerType()), T.StructField("second", T.IntegerType())])
    names = distinct.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, second = shared.value.cells(as_matrix(batch["vector"]))
                cells = [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=[*names, "first", "second"])

    return distinct.mapInArrow(run, schema)


def probed(queries: DataFrame, shared, k: int) -> DataFrame:
    """``query_key, vector, first, seconds``: for each first centroid the second ones to search, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, key, vector in zip(as_matrix(batch["vector"]), batch["vector_key"], batch["vector"], strict=True):
                taken = shared.value.probes(query, k)
                firsts = np.flatnonzero(taken.any(axis=1)).astype(np.int32)
                bits = np.packbits(taken[firsts], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key.as_py()] * len(firsts)), pa.array([vector.as_py()] * len(firsts), batch["vector"].type),
                        pa.array(firsts), pa.array([row.tobytes() for row in bits], pa.binary()),
                    ],
                    names=["query_key", "vector", "first", "seconds"],
                )

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("vector_key", "vector").mapInArrow(run, f"query_key long, vector {kind}, first int, seconds binary")


def reranked(pairs: DataFrame, k: int, width: int) -> DataFrame:
    """Exact scores of a block's rows for the queries that probe their cells; each query's best stay.

    ``pairs`` holds both sides of each block in order: rows of the index, then queries.
    """
    schema = pa.schema([("query_key", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, seconds = None, [], [], []
        ready = None

        def best(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if ready is None:
                return
            points, second, own_ids = ready
            queries = as_matrix(part["vector"])
            bits = np.unpackbits(np.array([np.frombuffer(b, dtype=np.uint8) for b in part["seconds"].to_pylist()]), axis=1)
            scores = np.where(bits[:, second].astype(bool), queries @ points.T, -np.inf)
            few = min(k + 1, scores.shape[1])
            edge = -np.partition(-scores, few - 1, axis=1)[:, few - 1]
            keep = (scores >= edge[:, None]) & (scores > -np.inf)
            at, of = np.nonzero(keep)
            counts = np.array([len(own_ids[o]) for o in of], dtype=np.int64)
            if not len(of):
                return
            keys = np.repeat(np.asarray(part["query_key"])[at], counts)
            found = np.repeat(scores[at, of], counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.concatenate([own_ids[o] for o in of])), pa.array(found)], schema=schema
            )

        for batch in batches:
            blocks, sides = np.asarray(batch["block"]), np.asarray(batch["side"])
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (sides[1:] != sides[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if blocks[start] != block:
                    block, ids, vectors, seconds, ready = blocks[start], [], [], [], None
                if sides[start] == 0:
                    ids += [np.asarray(x.values) for x in part["ids"]]
                    vectors.append(as_matrix(part["vector"]))
                    seconds.append(np.asarray(part["second"]))
                    continue
                if ready is None and vectors:
                    ready = np.concatenate(vectors), np.concatenate(seconds), ids
                for at in range(0, part.num_rows, QUERY_BLOCK):
                    yield from best(part.slice(at, QUERY_BLOCK))

    return pairs.mapInArrow(run, "query_key long, id long, score double")


def nearest(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, id, score``: for each query row its k nearest other rows found."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), is_query.alias("asks"))
    rows = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    usual = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = usual["width"] if usual else 0
    rows = materialize(rows.where(F.size("vector") == F.lit(width)), "ann-rows")
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    distinct = materialize(distinct_vectors(rows.select("id", "vector"), k + 1), "ann-vectors")
    index = fit_index(distinct)
    shared = spark.sparkContext.broadcast(index)
    cells = materialize(assigned(distinct, shared), "ann-cells")
    counts = cells.groupBy("first", "second").count().toArrow()
    index.sizes[np.asarray(counts["first"]), np.asarray(counts["second"])] = np.asarray(counts["count"])
    shared = spark.sparkContext.broadcast(index)
    blocks = {first: max(1, -(-int(n) // BLOCK_ROWS)) for first, n in enumerate(index.sizes.sum(axis=1))}
    block_count = F.element_at(F.array(*[F.lit(blocks[f]) for f in range(len(blocks))]), F.col("first") + 1)
    asked = rows.where("asks").select("id", F.xxhash64("vector").alias("query_key"), "vector")
    questions = materialize(asked.groupBy("vector").agg(F.first("query_key").alias("vector_key")), "ann-questions")
    # A given number of partitions is kept as it is: looking up cells is dear, and its rows are few.
    tasks = max(1, -(-questions.count() // QUERIES_PER_TASK))
    empty = F.lit(None)
    index_side = cells.select(
        F.struct("first", F.pmod("vector_key", block_count).alias("part")).alias("spot"), F.lit(0).alias("side"),
        "ids", "vector", "second", empty.cast("long").alias("query_key"), empty.cast("binary").alias("seconds"),
    )
    part = F.explode(F.sequence(F.lit(0).cast("long"), (block_count - 1).cast("long"))).alias("part")
    query_side = (
        probed(questions.repartition(tasks, "vector_key"), shared, k)
        .select("*", part)
        .select(
            F.struct("first", "part").alias("spot"), F.lit(1).alias("side"), empty.cast("array<long>").alias("ids"), "vector",
            empty.cast("int").alias("second"), "query_key", "seconds",
        )
    )
    both = index_side.union(query_side).withColumn("block", F.xxhash64("spot")).drop("spot")
    found = reranked(both.repartition("block").sortWithinPartitions("block", "side"), k, width)
    best = W.partitionBy("query_key").orderBy(F.desc("score"), "id")
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    answers = top.groupBy("query_key").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("answer"))
    answers = materialize(answers, "ann-answers")
    own = asked.select(F.col("id").alias("query_id"), "query_key").distinct().join(answers, "query_key")
    others = F.slice(F.filter("answer", lambda x: x["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "it")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("it.id").alias("id"), F.col("it.score").alias("score")
    )


def op2_multi_index(spark, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {"op2_multi_index": op2_multi_index}
