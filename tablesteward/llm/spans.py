"""Spans of pattern matches as column expressions, without Python.

Java's matcher names no positions in Spark SQL, so matches are wrapped in a mark,
the text is split at the marks, and lengths are added up: odd pieces are the
matches. The mark is a control character that no pattern here can match; one in
the text is first changed to another, which moves nothing. Positions are code
points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, OTHER = "\x01", "\x02"
CONTEXT = 24
# Elements of an array that are folded at once, and characters that a cut reads over.
CHUNK = 512
PAGE = 1024
# Steps of a search in an array of any length.
HALVES = "array(" + ", ".join(str(1 << n) for n in range(30, -1, -1)) + ")"
HIT_TYPE = "start:bigint,end:bigint,hit:string,before:string,after:string"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, hit, before, after>>`` of the leftmost non-overlapping matches.

    Linear in the text: a running sum of the pieces' lengths tells the places.
    """
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return bound(F.split(marked, MARK, -1), lambda pieces: bound(running(char_lengths(pieces), total), lambda ends: hits_of(pieces, ends)))


def char_lengths(pieces: Column) -> Column:
    return F.transform(pieces, lambda piece: F.char_length(piece).cast("long"))


def running(numbers: Column, combine) -> Column:
    """What ``combine`` makes of each number and all before it, for an array of any length.

    Arrays longer than a chunk are folded chunk by chunk, and then over the
    chunks, so that no long array is copied for each of its elements.
    """

    def folded(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

        def step(so_far: Column, n: Column) -> Column:
            reached = combine(so_far["at"], n)
            return F.struct(reached.alias("at"), F.array_append(so_far["out"], reached).alias("out"))

        return F.aggregate(values, start, step, lambda done: done["out"])

    def by_chunks(values: Column) -> Column:
        count = F.ceil(F.size(values) / F.lit(CHUNK)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: folded(F.slice(values, i * CHUNK + 1, F.lit(CHUNK))))

        def raised(parts: Column) -> Column:
            tops = folded(F.transform(parts, lambda part: F.coalesce(F.get(part, F.size(part) - 1), F.lit(0).cast("long"))))

            def one(part: Column, base: Column) -> Column:
                return F.transform(part, lambda n: combine(base, n))

            return bound(
                tops,
                lambda top: F.flatten(F.transform(parts, lambda part, i: one(part, F.coalesce(F.get(top, i - 1), F.lit(0).cast("long"))))),
            )

        return bound(chunks, raised)

    return bound(numbers, lambda values: F.when(F.size(values) <= CHUNK, folded(values)).otherwise(by_chunks(values)))


def total(a: Column, b: Column) -> Column:
    return a + b


def hits_of(pieces: Column, ends: Column) -> Column:
    """The odd pieces with their places and what touches them."""

    def hit(nth: Column) -> Column:
        at = 2 * nth + 1
        return F.struct(
            F.get(ends, at - 1).alias("start"),
            F.get(ends, at).alias("end"),
            F.get(pieces, at).alias("hit"),
            F.substring(F.get(pieces, at - 1), -CONTEXT, CONTEXT).alias("before"),
            F.substring(F.get(pieces, at + 1), 1, 1).alias("after"),
        )

    count = F.floor(F.size(pieces) / 2).cast("int")
    none = F.array().cast(f"array<struct<{HIT_TYPE}>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), hit)).otherwise(none)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def places(hits: Column, kind: str, order: int) -> Column:
    """Hits as ``struct<start, kind_no, end, kind>``, which sort as spans are listed."""
    return F.transform(
        hits, lambda h: F.struct(h["start"].alias("start"), F.lit(order).alias("kind_no"), h["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    told = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(told, ",")


def kind_counts(kinds: tuple[str, ...], spans: str = "base") -> list[Column]:
    """``n_<kind>`` of a column of spans."""

    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [of(kind) for kind in kinds]


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def touches(hits: Column, span: Column) -> Column:
    """Whether a span overlaps one of sorted hits that do not overlap one another.

    Only the last hit that starts before the span's end can; it is searched by halves.
    """

    def step(below: Column, half: Column) -> Column:
        at = below + half
        return F.when((at <= F.size(hits)) & (F.get(hits, at - 1)["start"] < span["end"]), at).otherwise(below)

    below = F.aggregate(F.filter(F.expr(HALVES), lambda h: h <= F.size(hits)), F.lit(0), step)
    return F.coalesce(F.get(hits, below - 1)["end"] > span["start"], F.lit(False))


def cut(pages: Column, start: Column, end: Column) -> Column:
    """Characters of a text that is held as pages."""
    first, last = F.floor(start / PAGE).cast("int"), F.floor((end - 1) / PAGE).cast("int")
    near = F.array_join(F.slice(pages, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substr(near, (start - first * PAGE + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping sorted spans replaced by the first one's ``[kind]``."""
    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))

    def made(pages: Column) -> Column:
        def with_reach(reach: Column) -> Column:
            def before(i: Column) -> Column:
                return F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long"))

            fresh = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= before(i))
            told = F.transform(
                fresh,
                lambda i: F.concat(cut(pages, before(i), F.get(spans, i)["start"]), F.lit("["), F.get(spans, i)["kind"], F.lit("]")),
            )
            rest = cut(pages, F.element_at(reach, -1), F.char_length(text).cast("long"))
            return F.concat(F.array_join(told, ""), rest)

        return bound(running(F.transform(spans, lambda s: s["end"]), F.greatest), with_reach)

    return F.when(F.size(spans) > 0, bound(pages, made)).otherwise(text)
