"""Escaping of state keys that a store reserves (``__name__``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved wrapper, its escape, and the prefix of unsaved keys.
RESERVED, ESCAPE, UNSAVED_PREFIX = "__", "_Z_", "temp:"


def _rewrap(key: Column, wrapper: str, replacement: str) -> Column:
    width = len(wrapper)
    inner = F.substring(key, F.lit(width + 1), F.length(key) - 2 * width)
    wrapped = key.startswith(wrapper) & key.endswith(wrapper) & (F.length(key) > 2 * width)
    return F.when(wrapped, F.concat(F.lit(replacement), inner, F.lit(replacement))).otherwise(key)


def encode_key(key: Column) -> Column:
    return _rewrap(key, RESERVED, ESCAPE)


def decode_key(key: Column) -> Column:
    return _rewrap(key, ESCAPE, RESERVED)


def is_saved(key: Column) -> Column:
    return ~key.startswith(UNSAVED_PREFIX)
