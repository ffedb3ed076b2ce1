"""Text expressions: trimming, number text, sample cells, byte sizes, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All Unicode blanks, which trimming removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Limits and marks used when text is shortened.
CELL_CHARS = 60
PREVIEW_CHARS = 80
CONTENT_CHARS = 200
ARGUMENT_CHARS = 600
ELLIPSIS = "…"
ZONED_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def clip(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, marked with an ellipsis if any were cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(ELLIPSIS))).otherwise(text)


def truncate_marked(text: Column, limit: int) -> Column:
    """Trim, and if longer than ``limit`` cut and say how many characters went."""
    trimmed = strip(text)
    dropped = F.length(trimmed) - F.lit(limit)
    cut = F.concat(
        rstrip(F.substring(trimmed, 1, limit)), F.lit(ELLIPSIS + " (+"), dropped.cast("string"), F.lit(" chars)")
    )
    return F.when(dropped > 0, cut).otherwise(trimmed)


def number_text(value: Column) -> Column:
    """Shortest decimal text of a finite double, plain between 1e-4 and 1e16.

    Spark switches to ``E`` notation at 1e7 and below 1e-3; this does so only
    outside the wider range and writes the exponent with a sign and two digits.
    """
    spark_text = value.cast("string")
    plain = F.regexp_replace(spark_text.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(spark_text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(spark_text, "E", -1)
    digits = F.regexp_replace(exponent, "-", "")
    padded = F.when(F.length(digits) == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    sign = F.when(exponent.startswith("-"), F.lit("e-")).otherwise(F.lit("e+"))
    return (
        F.when(~spark_text.contains("E"), spark_text)
        .when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e16), plain)
        .otherwise(F.concat(mantissa, sign, padded))
    )


def iso_timestamp(value: Column, zoned: bool) -> Column:
    """ISO-8601 text; the fraction, of six digits, appears only when it is not zero."""
    if zoned:
        return F.replace(F.date_format(value, ZONED_FORMAT), F.lit(".000000"), F.lit(""))
    return iso_zoneless(value.cast("string"))


def iso_zoneless(text: Column) -> Column:
    """ISO form of the text Spark casts a zoneless timestamp to; no time zone takes part."""
    joined = F.replace(text, F.lit(" "), F.lit("T"))
    return F.when(text.contains("."), F.rpad(joined, 26, "0")).otherwise(joined)


def interval_seconds(value: Column) -> Column:
    return value.cast("decimal(18,6)").cast("double")


def raw_text_sql(name: str, data_type: T.DataType) -> str:
    """SQL for a scalar column as text that ``shown_text`` can finish by its type."""
    column = f"`{name}`"
    if isinstance(data_type, T.TimestampType):
        return f'date_format({column}, "{ZONED_FORMAT}")'
    if isinstance(data_type, T.DayTimeIntervalType):
        return f"cast(cast({column} AS decimal(18,6)) AS string)"
    if isinstance(data_type, T.BinaryType):
        return f"base64({column})"
    return f"cast({column} AS string)"


def shown_text(raw: Column, kind: Column) -> Column:
    """Raw text of a scalar as the sample grid shows it (null stays null).

    ``kind`` is the type name; one expression serves all columns of a sample.
    """
    number = raw.try_cast("double")
    numeric = kind.rlike("^(DOUBLE|FLOAT|DECIMAL|INTERVAL)")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return (
        F.when(numeric & finite, number_text(number))
        .when(numeric & raw.isNotNull(), F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(raw))
        .when(kind == "TIMESTAMP_NTZ", iso_zoneless(raw))
        .when(kind == "TIMESTAMP", F.replace(raw, F.lit(".000000"), F.lit("")))
        .otherwise(raw)
    )


def format_cell(text: Column) -> Column:
    """One sample value on one line: pipes escaped, capped, null as ``NULL``."""
    one_line = strip(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))
    return F.coalesce(clip(one_line, CELL_CHARS), F.lit("NULL"))


def format_bytes(count: Column) -> Column:
    """A byte count in 1024 steps, two decimals from KB upwards, TB the top unit."""
    value = count.cast("double")
    size = F.abs(value)
    text = F.when(size < 1024.0, F.format_string("%d B", value.cast("bigint")))
    for power, unit in enumerate(("KB", "MB", "GB"), start=1):
        scaled = F.bround(value / F.lit(1024.0**power), 2)
        text = text.when(size < 1024.0 ** (power + 1), F.format_string(f"%.2f {unit}", scaled))
    return text.otherwise(F.format_string("%.2f TB", F.bround(value / F.lit(1024.0**4), 2)))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, for values that need a lambda.

    Plain values need no help: generated code shares their repeated parts.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nonempty(texts: Column) -> Column:
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def question_text(parts: Column) -> Column:
    """Question of a message: its non-empty text parts, one per line, trimmed."""
    return F.coalesce(strip(F.array_join(nonempty(parts), "\n")), F.lit(""))


def message_preview(parts: Column) -> Column:
    """First characters of a message's texts joined by blanks; null without text."""
    return bind(
        F.array_join(nonempty(parts), " "), lambda joined: F.when(joined != "", clip(joined, PREVIEW_CHARS))
    )


def content_summary(parts: Column, limit: int = CONTENT_CHARS) -> Column:
    """One line per part of ``array<struct<text,call,response,code>>``."""

    # The labels of the parts.
    def line(part: Column) -> Column:
        return (
            F.when(part["text"] != "", F.concat(F.lit("text: '"), truncate_marked(part["text"], limit), F.lit("'")))
            .when(part["call"].isNotNull(), F.concat(F.lit("function_call: "), part["call"]))
            .when(part["response"].isNotNull(), F.concat(F.lit("function_response: "), part["response"]))
            .when(part["code"].isNotNull(), F.lit("code_execution_result"))
            .otherwise(F.lit("other_part"))
        )

    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, line), "\n")).otherwise(F.lit("None"))


def kv_render(entries: Column, limit: int = ARGUMENT_CHARS) -> Column:
    """``key: value`` lines of a ``map<string,string>``, long text as a block.

    Values that are not text are given as JSON by the caller, laid out by
    ``jsontext.json_value_text``.
    """

    def line(entry: Column) -> Column:
        return bind(truncate_marked(entry["value"], limit), lambda text: shown(entry["key"], text))

    def shown(key: Column, text: Column) -> Column:
        block = F.regexp_replace(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n  ")
        return F.when(text.contains("\n"), F.concat(key, F.lit(":\n  "), block)).otherwise(F.concat(key, F.lit(": "), text))

    def lines(given: Column) -> Column:
        return F.when(F.size(given) > 0, F.array_join(F.transform(F.map_entries(given), line), "\n")).otherwise(F.lit("{}"))

    return bind(entries, lines)
