"""JSON texts laid out on one line or over many, token by token in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesteward.functions.text import bind

# What a JSON text is made of, the longest text kept on one line, and an indent.
TOKEN = r'"(?:\\.|[^"\\])*+"|[{}\[\],:]|[^\s{}\[\],:"]++'
LINE_CHARS = 80
INDENT = "  "
# Elements that are summed at once.
CHUNK = 256


def running_sums(numbers: Column) -> Column:
    """The sum of each element and those before it; long arrays are summed chunk by chunk."""

    def summed(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(so_far: Column, n: Column) -> Column:
            return F.struct((so_far["at"] + n).alias("at"), F.array_append(so_far["out"], so_far["at"] + n).alias("out"))

        return F.aggregate(values, start, step, lambda done: done["out"])

    def by_chunks(values: Column) -> Column:
        count = F.ceil(F.size(values) / F.lit(CHUNK)).cast("int")
        numbers_of = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: summed(F.slice(values, i * CHUNK + 1, F.lit(CHUNK))))

        def raised(chunks: Column) -> Column:
            totals = summed(F.transform(chunks, lambda c: F.coalesce(F.get(c, F.size(c) - 1), F.lit(0))))
            return bind(
                totals,
                lambda before: F.flatten(
                    F.transform(chunks, lambda chunk, i: F.transform(chunk, lambda n: n + F.coalesce(F.get(before, i - 1), F.lit(0))))
                ),
            )

        return bind(numbers_of, raised)

    return bind(numbers, lambda values: F.when(F.size(values) <= CHUNK, summed(values)).otherwise(by_chunks(values)))


def laid_out(value: Column, layout: Callable[[Column], Column]) -> Column:
    return bind(F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0)), lambda tokens: F.array_join(layout(tokens), ""))


def json_line(value: Column) -> Column:
    """A JSON text on one line, a blank after each comma and colon."""

    def layout(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t))

    return laid_out(value, layout)


def json_lines(value: Column) -> Column:
    """A JSON text with a line for each member, indented by depth."""

    def layout(tokens: Column) -> Column:
        deltas = F.transform(tokens, lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0))

        def pieces(depths: Column) -> Column:
            def piece(token: Column, i: Column) -> Column:
                line = F.concat(F.lit("\n"), F.repeat(F.lit(INDENT), F.get(depths, i)))
                opens, closes = token.isin("{", "["), token.isin("}", "]")
                ends_at_once = opens & F.get(tokens, i + 1).isin("}", "]")
                empty = closes & F.get(tokens, i - 1).isin("{", "[")
                return (
                    F.when(F.coalesce(ends_at_once | empty, F.lit(False)), token)
                    .when(opens | (token == ","), F.concat(token, line))
                    .when(closes, F.concat(line, token))
                    .when(token == ":", F.lit(": "))
                    .otherwise(token)
                )

            return F.transform(tokens, piece)

        return bind(running_sums(deltas), pieces)

    return laid_out(value, layout)


def json_value_text(value: Column, line_chars: int = LINE_CHARS) -> Column:
    """A JSON text as a reader is shown it: on one line if it is short, else over many; null stays null.

    The text is taken as valid JSON; strings are kept as they are written.
    """
    return bind(json_line(value), lambda line: F.when(F.length(line) > line_chars, json_lines(line)).otherwise(line))
