"""Embedding through a slow or failing service: requests at a time, retries, failures as rows."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablesteward.functions.vectors import DIMENSIONS, INPUT_CHARS, Embedder, embed_input

# Fixed value: requests that one task has under way.
REQUESTS = 8
# Texts of a request, tries of it, and seconds before the second try (doubled each time).
TEXTS, TRIES, PAUSE = 64, 3, 0.5


def requested(embedder: Embedder, texts: list[str], dimensions: int, tries: int, pause: float) -> list[tuple[list[float] | None, str | None]]:
    """A unit vector or an error for each text, in order.

    A request that keeps failing is made again text by text, so that one bad text
    does not take its neighbours along. An answer of another shape is a failure.
    """
    import numpy as np

    def once(part: list[str]) -> list[tuple[list[float] | None, str | None]]:
        matrix = np.asarray(embedder(part), "float64")
        if matrix.shape != (len(part), dimensions):
            raise ValueError(f"embedder returned {matrix.shape}, expected {(len(part), dimensions)}")
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return [(row.tolist(), None) for row in np.divide(matrix, norms, out=matrix, where=norms > 0)]

    def tried(part: list[str]) -> list[tuple[list[float] | None, str | None]]:
        for attempt in range(tries):
            try:
                return once(part)
            except Exception as problem:
                if attempt + 1 == tries:
                    raise
                time.sleep(pause * 2**attempt)
                told = problem
        raise told

    if not texts:
        return []
    try:
        return tried(texts)
    except Exception as problem:
        if len(texts) == 1:
            return [(None, f"{type(problem).__name__}: {problem}")]
        middle = len(texts) // 2
        return [*requested(embedder, texts[:middle], dimensions, 1, pause), *requested(embedder, texts[middle:], dimensions, 1, pause)]


def in_order(calls: Iterator[Callable[[], object]], window: int) -> Iterator[object]:
    """Results of calls in their order, ``window`` of them under way, no more begun ahead."""
    with ThreadPoolExecutor(window) as pool:
        pending: deque[Future] = deque()
        for call in calls:
            pending.append(pool.submit(call))
            if len(pending) >= window:
                yield pending.popleft().result()
        while pending:
            yield pending.popleft().result()


def embed_with_requests(
    df: DataFrame,
    text: str,
    output: str,
    embedder: Embedder,
    instruction: str = "",
    dimensions: int = DIMENSIONS,
    error: str = "embed_error",
    requests: int = REQUESTS,
    texts: int = TEXTS,
    tries: int = TRIES,
    pause: float = PAUSE,
) -> DataFrame:
    """Add the unit vector of a text column, and why there is none where embedding failed.

    For embedders that wait for something: ``requests`` requests of ``texts``
    texts are under way in each task, and rows keep their order and number. A
    task holds the rows of its requests and nothing more. Null text gives a null
    vector without an error. Columns called ``output`` or ``error`` are replaced.
    """
    kept = [name for name in df.columns if name not in (output, error)]
    limit = getattr(embedder, "input_chars", INPUT_CHARS)
    (asked,) = [name for name in ["__asked" + "_" * n for n in range(len(df.columns) + 1)] if name not in df.columns][:1]
    rows = df.select(*[F.col(f"`{name}`") for name in kept], embed_input(F.col(f"`{text}`"), instruction, limit).alias(asked))
    made = [T.StructField(output, T.ArrayType(T.DoubleType())), T.StructField(error, T.StringType())]
    schema = T.StructType([*rows.schema.fields[:-1], *made])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            inputs = part[asked].to_pylist()
            known = [t for t in inputs if t is not None]
            found = iter(requested(embedder, known, dimensions, tries, pause))
            pairs = [next(found) if t is not None else (None, None) for t in inputs]
            columns = [part[name] for name in kept]
            own = [pa.array([v for v, _ in pairs], arrow.field(output).type), pa.array([e for _, e in pairs], pa.string())]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, *own], arrow, strict=True)], schema=arrow)

        parts = (batch.slice(at, texts) for batch in batches for at in range(0, batch.num_rows, texts))
        yield from in_order(((lambda part=part: answer(part)) for part in parts), requests)

    return rows.mapInArrow(run, schema)
