"""Tables and columns that SQL texts name, found for a whole log in one pass.

Texts are cut into tokens and told apart by these with all literals alike, so a log
of a few statements with many values has few distinct texts. Windows over their positions say which
query block a token belongs to, in which of its clauses it stands, and how far
the block's scope reaches. A name after FROM or JOIN is a table unless a WITH name
that ends before it says otherwise; every other name is looked up among the
columns of the tables in scope, the innermost first. Names are matched by joins
with the catalog, so nothing is planned or looked up per text.

What this does not see is priced too high, not too low: a column that a WITH
query selects and nobody reads counts, as does a name that only looks like one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteward.functions.sqltext import with_verdict
from tablesteward.operators.scancost import query_costs
from tablesteward.session import materialize, spread

# What a text is made of, first match first.
COMMENT = r"--[^\n]*+|#[^\n]*+|/\*.*?(?:\*/|\z)"
STRING = (
    r"(?:\b[rR])'[^']*+'|(?:\b[rR])\"[^\"]*+\""
    r"|'''.*?(?:'''|\z)|\"\"\".*?(?:\"\"\"|\z)"
    r"|'(?:\\.|[^'\\])*+(?:'|\\?\z)|\"(?:\\.|[^\"\\])*+(?:\"|\\?\z)"
)
NAME = r"(?:`[^`]*+`|[A-Za-z_][A-Za-z0-9_$]*+)"
TOKEN = f"(?s){COMMENT}|{STRING}|{NAME}(?:\\s*+\\.\\s*+{NAME})*+(?:\\s*+\\.\\s*+\\*)?|[0-9][A-Za-z0-9_.]*+|\\S"
LITERAL, NUMBER = "''", "0"

CLAUSES = (
    "with", "select", "from", "join", "on", "using", "where", "group", "having", "qualify", "window", "order", "limit",
)
SET_OPERATORS = ("union", "intersect", "except", "minus")
# Words that may follow a table and are no alias of it.
AFTER_TABLE = (
    *CLAUSES, *SET_OPERATORS, "inner", "left", "right", "full", "cross", "natural", "outer", "semi", "anti", "lateral",
    "tablesample", "pivot", "unpivot", "for", "offset", "fetch", "sort", "cluster", "distribute", "as",
)
TABLE_CLAUSES = ("from", "join", "on", "using")
LEAVING_CALLS = ("reflect", "java_method", "try_reflect")


def tokens(text: Column) -> Column:
    """The tokens of a text in order; comments are left out, literals are all alike."""

    def begins(token: Column, *marks: str) -> Column:
        return reduce(or_, [token.startswith(mark) for mark in marks])

    def alike(token: Column) -> Column:
        literal = begins(token, "'", '"', "r'", 'r"', "R'", 'R"')
        return F.when(literal, F.lit(LITERAL)).when(F.substring(token, 1, 1).between("0", "9"), F.lit(NUMBER)).otherwise(F.lower(token))

    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(F.filter(found, lambda t: ~begins(t, "--", "#", "/*")), alike)


def accepted(log: DataFrame, text: str, *names: str) -> DataFrame:
    """``names, words, text_key`` of the accepted texts of a log, as they would be run."""
    told = with_verdict(log.select(*names, text), text).where("verdict = 'ok'")
    worded = told.select(*names, tokens(F.col("cleaned")).alias("words"))
    return worded.withColumn("text_key", F.sha2(F.array_join("words", "\x00"), 256))


def path_of(word: Column) -> Column:
    """The parts of a dotted name, quoted or not."""
    return F.split(F.regexp_replace(word, r"[`\s]", ""), r"\.")


def is_name(word: Column) -> Column:
    return word.rlike("^[`a-z_]")


def marked_tokens(texts: DataFrame) -> DataFrame:
    """The names and stars of ``texts(text_key, words)`` with where they stand.

    All windows are within one text, so they share the partitioning of the
    distinct texts and shuffle nothing.
    """
    rows = texts.select("text_key", F.posexplode("words").alias("pos", "word"))
    order = W.partitionBy("text_key").orderBy("pos")
    word = F.col("word")
    opens, closes = word == "(", word == ")"
    rows = rows.select(
        "*",
        *(F.coalesce(F.lag("word", n).over(order), F.lit("")).alias(f"back{n}") for n in (1, 2, 3)),
        *(F.coalesce(F.lead("word", n).over(order), F.lit("")).alias(f"next{n}") for n in (1, 2)),
        F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order).alias("depth"),
        F.max((word == "recursive").cast("int")).over(W.partitionBy("text_key")).alias("recursive"),
    )
    # A closing bracket belongs to the level that it ends.
    rows = rows.withColumn("level", F.col("depth") + closes.cast("int"))
    level = W.partitionBy("text_key", "level").orderBy("pos")
    opens_query = opens & F.col("next1").isin("select", "with")
    opened = F.when(opens, F.struct("pos", opens_query.alias("query"), F.col("back1").alias("before"), F.col("back2").alias("name")))
    rows = rows.withColumn("opener", F.last(opened, ignorenulls=True).over(level))
    ends_query = closes & F.coalesce(F.col("opener.query"), F.lit(False))
    rows = rows.withColumn("block_depth", F.sum(F.when(opens_query, 1).when(ends_query, -1).otherwise(0)).over(order))
    block = W.partitionBy("text_key", "block_depth").orderBy("pos")
    rows = rows.withColumn("block", F.coalesce(F.max(F.when(opens_query, F.col("pos"))).over(block), F.lit(-1)))
    rows = rows.withColumn("own", F.coalesce(F.col("opener.pos"), F.lit(-1)) == F.col("block"))
    # SELECTs of one block that a set operator parts see different tables.
    parts = F.col("own") & word.isin(*SET_OPERATORS) & ~F.col("back1").endswith("*")
    rows = rows.withColumn("part", F.sum(parts.cast("int")).over(W.partitionBy("text_key", "block").orderBy("pos")))
    scope = W.partitionBy("text_key", "block", "part")
    begins = F.col("own") & word.isin(*CLAUSES) & ~((word == "from") & (F.col("back1") == "distinct"))
    rows = rows.withColumn("clause", F.coalesce(F.last(F.when(begins, word), ignorenulls=True).over(scope.orderBy("pos")), F.lit("")))
    named = F.when((F.col("back1") == "as") & (F.col("clause") == "select"), word)
    rows = rows.withColumns(
        {"low": F.min("pos").over(scope), "high": F.max("pos").over(scope), "aliases": F.collect_set(named).over(scope)}
    )
    follows = (
        (F.col("own") & (F.col("back1") == "from") & (F.col("back2") != "distinct"))
        | (F.col("back1") == "join")
        | (F.col("own") & (F.col("back1") == ",") & F.col("clause").isin(*TABLE_CLAUSES))
    )
    call = F.col("next1") == "("
    alias_place = is_name(F.col("back1")) & ~F.col("back1").isin(*AFTER_TABLE) & F.col("clause").isin("from", "join")
    alias_place &= F.col("back2").isin("from", "join", ",")
    star = (word == "*") & F.col("own") & (F.col("clause") == "select") & F.col("back1").isin("select", "distinct", "all", ",")
    ordered_alias = (F.col("clause") == "order") & F.array_contains("aliases", word)
    kind = (
        F.when(ends_query & (F.col("opener.before") == "as"), F.lit("with"))
        .when(star | word.rlike(r"\.\s*\*$"), F.lit("star"))
        .when(~is_name(word), F.lit(None))
        .when(call & F.element_at(path_of(word), -1).isin(*LEAVING_CALLS), F.lit("leaving"))
        .when(follows & ~call & ~word.isin("lateral", "unnest", "select"), F.lit("table"))
        .when(call | (F.col("back1") == "as") | (F.col("next1") == "as") & (F.col("next2") == "("), F.lit(None))
        .when(alias_place | ordered_alias, F.lit(None))
        .otherwise(F.lit("column"))
    )
    path = path_of(F.when(kind == "with", F.col("opener.name")).otherwise(word))
    alias = F.when(F.col("next1") == "as", F.col("next2")).when(
        is_name(F.col("next1")) & ~F.col("next1").isin(*AFTER_TABLE), F.col("next1")
    )
    seen_from = F.when((kind == "with") & (F.col("recursive") == 1), F.col("opener.pos")).otherwise(F.col("pos"))
    return rows.select(
        "text_key", seen_from.alias("pos"), kind.alias("kind"), path.alias("path"), "low", "high",
        F.regexp_replace(F.coalesce(alias, F.element_at(path, -1)), "`", "").alias("alias"),
    ).where(F.col("kind").isNotNull())


def table_names(columns: DataFrame) -> DataFrame:
    """``name, table_id``: what a text may call the tables of ``columns(table_id, column)``, with or without the outer names."""
    ids = columns.select("table_id").distinct()
    parts = F.split(F.lower("table_id"), r"\.")
    shorter = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    return ids.select("table_id", F.explode(shorter).alias("name"))


def distinct_texts(log: DataFrame, text: str) -> DataFrame:
    """``text_key, words`` of every accepted text once."""
    return texts_of(accepted(log, text))


def texts_of(worded: DataFrame) -> DataFrame:
    """``text_key, words`` once each, of rows that hold them."""
    return worded.groupBy("text_key").agg(F.first("words").alias("words"))


def kept_words(log: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, words, text_key`` of the accepted texts, stored: no text is checked or cut into tokens twice.

    All rows are stored and then filtered. A filter before would be moved below
    the clean-up, whose patterns would run again for each use in it.
    """
    told = with_verdict(spread(log.select(key, text)), text)
    worded = told.select(key, F.when(F.col("verdict") == "ok", tokens(F.col("cleaned"))).alias("words"))
    keyed = worded.withColumn("text_key", F.sha2(F.array_join("words", "\x00"), 256))
    return materialize(keyed, "log-words").where("words IS NOT NULL")


def text_references(texts: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``text_key, table_id, column`` that texts read, and ``text_key, code`` of those not to be run.

    ``columns(table_id, column)`` is the catalog. A text that names a table
    outside it is an ``unknown_source``, one that calls out of the engine an
    ``escape_hatch``.
    """
    marks = materialize(marked_tokens(texts), "sql-names")
    withs = marks.where("kind = 'with'").select("text_key", F.element_at("path", 1).alias("name"), F.col("pos").alias("ready"))
    named = marks.where("kind = 'table'").withColumn("name", F.array_join("path", "."))
    known_with = (named["text_key"] == withs["text_key"]) & (named["name"] == withs["name"]) & (withs["ready"] < named["pos"])
    tables = named.join(withs, known_with, "left_anti").join(table_names(columns), "name", "left")
    tables = materialize(tables.select("text_key", "alias", "name", "low", "high", "table_id"), "sql-tables")
    refused = tables.where("table_id IS NULL").select("text_key", F.lit("unknown_source").alias("code"))
    leaving = marks.where("kind = 'leaving'").select("text_key", F.lit("escape_hatch").alias("code"))
    codes = refused.unionByName(leaving).groupBy("text_key").agg(F.min("code").alias("code"))

    catalog = columns.select("table_id", "column", F.lower("column").alias("lower_column")).distinct()
    inside = tables.where("table_id IS NOT NULL").select("text_key", "alias", "low", "high", "table_id", F.col("name").alias("of"))
    asked = marks.where("kind = 'column'").select("text_key", "pos", "path")
    own = F.col("path")[0] == F.col("alias")
    # `a.b`: column b of the table called a, or field b of a column a.
    choices = F.array_compact(
        F.array(
            F.col("path")[0],
            F.when(own, F.get("path", F.lit(1))),
            F.when(F.array_join(F.slice("path", 1, F.size("path") - 1), ".") == F.col("of"), F.element_at("path", -1)),
        )
    )
    met = (
        asked.join(inside, "text_key")
        .where(F.col("pos").between(F.col("low"), F.col("high")))
        .select("text_key", "pos", "low", "table_id", F.explode(choices).alias("lower_column"))
        .join(catalog, ["table_id", "lower_column"])
    )
    innermost = F.max("low").over(W.partitionBy("text_key", "pos"))
    used = met.withColumn("innermost", innermost).where("low = innermost").select("text_key", "table_id", "column")
    stars = marks.where("kind = 'star'").select(
        "text_key", "pos", F.when(F.size("path") > 1, F.array_join(F.slice("path", 1, F.size("path") - 1), ".")).alias("whose"),
        F.col("low").alias("star_low"),
    )
    spread = (
        stars.join(inside, "text_key")
        .where((F.col("low") == F.col("star_low")) & (F.col("whose").isNull() | F.col("whose").isin(F.col("alias"), F.col("of"))))
        .join(catalog, "table_id")
        .select("text_key", "table_id", "column")
    )
    return used.unionByName(spread).distinct(), codes


def log_columns(log: DataFrame, key: str, text: str, columns: DataFrame) -> DataFrame:
    """``<key>, table_id, column`` for the accepted texts of a log."""
    kept = kept_words(log, key, text)
    read, _ = text_references(texts_of(kept), columns)
    read = materialize(read, "text-columns")
    return kept.drop("words").join(read, "text_key").drop("text_key")


def log_costs(log: DataFrame, key: str, text: str, column_bytes: DataFrame, size: str = "logical_bytes") -> DataFrame:
    """``<key>, estimated_bytes`` for the accepted texts of a log that read something.

    Distinct texts are priced; the log itself is only joined with the prices.
    """
    kept = kept_words(log, key, text)
    read, _ = text_references(texts_of(kept), column_bytes)
    priced = query_costs(read.withColumnRenamed("text_key", "query_id"), column_bytes, size).withColumnRenamed("query_id", "text_key")
    priced = materialize(priced, "text-prices")
    return kept.drop("words").join(priced, "text_key").drop("text_key")


def log_refusals(log: DataFrame, key: str, text: str, columns: DataFrame, escape: str) -> DataFrame:
    """``<key>, code``: why each text of a log would be refused; null where it would not.

    ``escape`` is a pattern over masked text. What the words of a text do not
    show is left to the governed run, which also looks at its plans.
    """
    checked = with_verdict(log.select(key, text), text)
    by_words = F.when(F.col("verdict") != "ok", F.col("verdict")).when(F.col("masked").rlike(escape), F.lit("escape_hatch"))
    words = F.when(F.col("verdict") == "ok", tokens(F.col("cleaned")))
    checked = checked.select(key, by_words.alias("by_words"), words.alias("words"))
    checked = checked.withColumn("text_key", F.sha2(F.array_join("words", "\x00"), 256))
    checked = materialize(checked, "log-words")
    _, codes = text_references(texts_of(checked.where("words IS NOT NULL")), columns)
    codes = materialize(codes, "text-codes")
    return checked.drop("words").join(codes, "text_key", "left").select(key, F.coalesce("by_words", "code").alias("code"))
