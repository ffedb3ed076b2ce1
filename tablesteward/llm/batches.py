"""Arrow batches of rows in and out of Python, words, and tables kept in the shared folder."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablesteward.session import materialize

# The blanks between words, as bytes and as a Java character class.
BLANKS = b" \t\n\x0b\x0c\r"
BLANK_CLASS = r"[ \t\n\x0B\f\r]"

# Rows put through Python at once; texts of any length stay whole.
SLICE_BYTES = 8 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def byte_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * limit // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def map_columns(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: T.StructType) -> DataFrame:
    """``df`` through ``function``, which makes columns (lists or arrays) out of each slice of a batch."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                made = function(part)
                columns = [
                    made[f.name] if isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(made[f.name], f.type)
                    for f in arrow
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case, for columns of our own beside it."""
    taken, out = {name.lower() for name in df.columns}, []
    for name in names:
        made, nth = f"__{name}", 0
        while made.lower() in taken:
            nth += 1
            made = f"__{name}_{nth}"
        taken.add(made.lower())
        out.append(made)
    return out


def numbered(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder with a ``row_id`` that stays the same from then on.

    Tables may hold a key twice; what is split off a row finds it again by this
    number.
    """
    return materialize(df.withColumn("row_id", F.monotonically_increasing_id()), purpose)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


# A vocabulary file is broadcast; larger files are refused.
MOST_FILE_BYTES = 64 << 20


class ShippedFile:
    """A small file's bytes on every executor, known by their digest."""

    def __init__(self, shared, digest: str):
        self.shared, self.digest = shared, digest

    @property
    def value(self) -> bytes:
        return self.shared.value


def shipped_bytes(spark, path: str) -> ShippedFile:
    with open(path, "rb") as file:
        data = file.read(MOST_FILE_BYTES + 1)
    if len(data) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    return ShippedFile(spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest())


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


LETTER_BYTES = {letter: byte for byte, letter in byte_letters().items()}


def token_bytes_of_letters(token: str) -> bytes:
    """An entry of a byte-level vocabulary as bytes; added tokens hold other letters and are their text."""
    try:
        return bytes(LETTER_BYTES[letter] for letter in token)
    except KeyError:
        return token.encode()
