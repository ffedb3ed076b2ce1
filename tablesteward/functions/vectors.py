"""Vector expressions and the built-in offline embedder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.functions.text import bind

# Vector width and the longest input an embedder is given.
DIMENSIONS = 1536
INPUT_CHARS = 8192 * 4 - 2000

# Both sides of a search use one embedder but say which side they are.
DOCUMENT_INSTRUCTION = "Represent this table so that questions about its data find it.\n\n"
QUERY_INSTRUCTION = "Represent this question so that it finds the tables that answer it.\n\n"

# Takes a list of texts, returns a matrix with a row for each.
Embedder = Callable[[list[str]], object]


def embed_input(text: Column, instruction: str = "", limit: int | None = INPUT_CHARS) -> Column:
    """The text an embedder is given; ``limit`` is what its model reads, None for all."""
    whole = F.concat(F.lit(instruction), text)
    return whole if limit is None else F.substring(whole, 1, limit)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy in double; a zero vector stays as it is.

    The norm is bound once per vector; written inline it would be evaluated
    again for every element.
    """

    def divided(norm: Column) -> Column:
        return F.transform(vector, lambda x: F.when(norm == 0.0, x.cast("double")).otherwise(x.cast("double") / norm))

    return bind(l2_norm(vector), divided)


def vector_status(vector: Column, dimensions: int) -> Column:
    """``ok``, ``missing``, ``wrong_size`` or ``not_finite``."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), F.lit("missing"))
        .when(F.size(vector) != dimensions, F.lit("wrong_size"))
        .when(~numbers, F.lit("not_finite"))
        .otherwise(F.lit("ok"))
    )


def hashed_term_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Offline embedder: counts of ASCII words by hash bucket.

    A word's bucket is the number given by the first eight hex digits of its
    MD5, modulo the width.
    """

    def embed(texts):
        import hashlib
        import re
        from collections import Counter

        import numpy as np

        word_pattern, buckets = re.compile("[A-Za-z0-9]+"), {}

        def bucket(word):
            if word not in buckets:
                buckets[word] = int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % dimensions
            return buckets[word]

        matrix = np.zeros((len(texts), dimensions))
        for row, text in enumerate(texts):
            words = Counter(word_pattern.findall(text))
            places = np.fromiter((bucket(word) for word in words), "int64", len(words))
            np.add.at(matrix[row], places, np.fromiter(words.values(), "float64", len(words)))
        return matrix

    embed.input_chars = None  # counts words of texts of any length
    return embed


def embed_column(
    df: DataFrame,
    text: str,
    output: str,
    embedder: Embedder,
    instruction: str = "",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """Add the unit vector of a text column; null text gives a null vector.

    ``embedder`` takes a list of texts and returns a matrix with a row for each;
    a matrix of another width fails the job. Rows stay where they are, so there
    is nothing to put back in order. An embedder says by its ``input_chars``
    how many characters its model reads (``INPUT_CHARS`` if it does not say).
    """

    limit = getattr(embedder, "input_chars", INPUT_CHARS)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def unit_vectors(inputs):
        import numpy as np
        import pyarrow as pa

        known = np.asarray(inputs.is_valid())
        texts = inputs.drop_null().to_pylist()
        matrix = np.asarray(embedder(texts) if texts else np.zeros((0, dimensions)), "float64")
        if matrix.shape != (len(texts), dimensions):
            raise ValueError(f"embedder returned {matrix.shape}, expected {(len(texts), dimensions)}")
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
        matrix = np.divide(matrix, norms, out=matrix, where=norms > 0)
        ends = np.cumsum(known * dimensions)
        offsets = pa.array(np.concatenate(([0], ends)).astype("int32"))
        mask = None if known.all() else pa.array(~known)
        return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()), mask=mask)

    # Marked so that a filter on the vector does not embed every text twice.
    return df.withColumn(output, unit_vectors.asNondeterministic()(embed_input(F.col(text), instruction, limit)))
