"""Clean-up and read-only audit of SQL text, as JVM-side string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteward.functions.text import BLANKS, strip

# Fence tags, statement openers and write keywords of the dialect.
FENCE_TAGS = ("sql", "bigquery", "googlesql")
READ_OPENERS = ("SELECT", "WITH")
WRITE_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "DROP", "ALTER", "TRUNCATE",
    "GRANT", "REVOKE", "EXPORT", "LOAD", "CALL", "DECLARE", "EXECUTE",
)

FENCE_OPEN = r"```[ \t]*(?:" + "|".join(FENCE_TAGS) + r")?[ \t]*\r?\n?"
FENCED_BLOCK = "(?is)" + FENCE_OPEN + "(.*?)```"

# Comments, triple-quoted text and quoted text, tried in this order at each
# position. Possessive repeats keep long literals off the regex stack.
MASKED_SPANS = (
    r"(?s)--[^\n]*+|#[^\n]*+|/\*.*?(?:\*/|\z)"
    r"|'''.*?(?:'''|\z)"
    r'|""".*?(?:"""|\z)'
    r"|'(?:\\.|[^'\\])*+(?:'|\\?\z)"
    r'|"(?:\\.|[^"\\])*+(?:"|\\?\z)'
    r"|`(?:\\.|[^`\\])*+(?:`|\\?\z)"
)

# Functions of Spark's own dialect that reach outside the query, and USING with
# a command instead of a column list (script transforms).
ESCAPE_HATCHES = r"(?iU)(?<!\w)(?:(?:reflect|java_method|try_reflect)\s*\(|using(?!\w)(?!\s*+\())"


def unfence(text: Column) -> Column:
    """The first fenced block of the text; an unclosed opening fence is dropped."""
    stripped = strip(text)
    return (
        F.when(text.rlike(FENCED_BLOCK), F.regexp_extract(text, FENCED_BLOCK, 1))
        .when(stripped.startswith("```"), F.regexp_replace(stripped, "(?i)^" + FENCE_OPEN, ""))
        .otherwise(text)
    )


def mask(text: Column) -> Column:
    """Each comment, literal and quoted name replaced by one blank."""
    return F.regexp_replace(text, MASKED_SPANS, " ")


def is_read_only(masked: Column) -> Column:
    """True if masked text opens with SELECT or WITH and holds no write keyword."""
    body = F.ltrim(strip(masked), F.lit("( \t\r\n"))
    opener = F.upper(F.regexp_extract(body, "^[A-Za-z_]+", 0))
    writes = r"(?iU)(?<!\w)(?:" + "|".join(WRITE_KEYWORDS) + r")(?!\w)"
    return opener.isin(*READ_OPENERS) & ~body.rlike(writes)


def with_cleaned_sql(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Add ``cleaned``, ``masked`` and ``error_code`` (null if one statement).

    ``error_code`` is ``empty`` or ``multiple_statements``; ``cleaned`` is null
    then. The stages are separate projections so that no regex runs twice.
    """
    body = F.rtrim(strip(unfence(F.col(text))), F.lit(BLANKS + ";"))
    cleaned, masked, code = prefix + "cleaned", prefix + "masked", prefix + "error_code"
    staged = df.withColumn(cleaned, body).withColumn(masked, mask(F.col(cleaned)))
    problem = F.when(F.coalesce(F.col(cleaned), F.lit("")) == "", F.lit("empty")).when(
        F.col(masked).contains(";"), F.lit("multiple_statements")
    )
    staged = staged.withColumn(code, problem)
    return staged.withColumn(cleaned, F.when(F.col(code).isNull(), F.col(cleaned)))


def with_verdict(df: DataFrame, text: str) -> DataFrame:
    """Add the clean-up columns and ``verdict``: ``ok`` or the first failed check."""
    staged = with_cleaned_sql(df, text)
    return staged.withColumn(
        "verdict",
        F.coalesce(F.col("error_code"), F.when(is_read_only(F.col("masked")), F.lit("ok")), F.lit("not_read_only")),
    )
