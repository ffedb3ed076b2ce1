"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, digit runs as one 0, words joined by one
blank) and hashed. Every distinct text of a host that has a line counts once for
it, and a line is above the limit when it is in more than a share of the host's
distinct texts, and in more than a few of them. A caller may give ``line_limit``, a
fixed number that rows are counted against, instead.
A line above the host's limit stays in the host's first document that passes the
rules on its own text (smallest id; under ``line_limit``, of all documents) and is
removed from the others; a document that loses more than a given share of
its word characters that way is depleted and rejected, and so is one that fails
the rules on its own text.

Defined results: a null text is an empty one (no words, fails the rules); a null
host is a host of its own; lines without words never count; repeated rows count
as documents of their own under ``line_limit``, and rows that share the smallest id all keep the
line; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.llm.batches import BLANKS, as_bytes, fresh_names, map_columns, numbered, table

# Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8

# Production settings: the percentage of a host's distinct texts that may have a
# line, texts that always may, and the share of its word characters that a document may lose.
LINE_PERCENT, LEAST_TEXTS = 5, 5
MAX_LOST = 0.5

NOT_WORD_CHARS = BLANKS + bytes(range(0x80, 0xC0))
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = "array<struct<line_hash:long,line_chars:long,line_times:long>>"


def characters(text: bytes) -> int:
    """Code points outside blanks."""
    return len(text.translate(None, NOT_WORD_CHARS))


def repeated_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words inside windows of ``width`` words that occur at least twice.

    Windows get exact numbers by doubling: equal pairs of numbers get one number.
    """
    count = len(words) - width + 1
    if count < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.array([first.setdefault(word, at) for at, word in enumerate(words)], dtype=np.int64)
    if len(first) == len(words):
        return 0
    step = 1
    while step < width:
        pairs = ids[:-step] * (len(words) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    times = np.bincount(ids)
    starts = np.flatnonzero(times[ids] >= 2)
    if not len(starts):
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def normalised(line: bytes) -> bytes:
    """Lower-cased words joined by one blank, digit runs as one 0."""
    flat = b" ".join(line.split()).translate(LOWER)
    if not any(digit in flat for digit in b"0123456789"):
        return flat
    out, inside = bytearray(), False
    for byte in flat:
        digit = 48 <= byte <= 57
        if not digit:
            out.append(byte)
        elif not inside:
            out.append(48)
        inside = digit
    return bytes(out)


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(normalised(line), digest_size=8).digest(), "little", signed=True)


def measured(text: bytes | None) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The counts of a text, and its lines: hash, word characters in all, times."""
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    duplicates, lines = 0, {}
    for line in text.split(b"\n"):
        if not (chars := characters(line)):
            continue
        duplicates += line in seen
        seen.add(line)
        key = line_hash(line)
        before = lines.get(key, (0, 0))
        lines[key] = (before[0] + chars, before[1] + 1)
    counts = [len(words), characters(text), len(text) - len(text.translate(None, SYMBOLS)), duplicates, repeated_words(words)]
    return counts, [(key, chars, times) for key, (chars, times) in lines.items()]


def row_key(text_column: str, host_column: str):
    """Rows equal in id and in this have equal verdicts."""
    return F.xxhash64(F.col(host_column).cast("string"), F.col(text_column))


def line_profile(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """``row_id, id, row_key, host, counts..., lines`` for each row; the text itself is left behind."""
    schema = T.StructType.fromDDL(
        "id long, row_key long, host string, " + ", ".join(f"{name} long" for name in COUNTS) + f", lines {LINES}"
    )
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        row_key(text_column, host_column).alias("row_key"),
        F.col(host_column).cast("string").alias("host"),
        F.col(text_column).alias("text"),
    )

    def run(batch) -> dict:
        found = [measured(text) for text in as_bytes(batch["text"])]
        made = {name: [counts[i] for counts, _ in found] for i, name in enumerate(COUNTS)}
        lines = [[{"line_hash": h, "line_chars": c, "line_times": t} for h, c, t in own] for _, own in found]
        return made | {"id": batch["id"], "row_key": batch["row_key"], "host": batch["host"], "lines": lines}

    return numbered(map_columns(rows, run, schema), "line-profile")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def lines_above(profile: DataFrame, line_limit: int | None) -> DataFrame:
    """Lines of more documents of a host than the limit, one row for each document that loses one."""
    host_key = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))
    keyed = profile.withColumn("host_key", host_key)
    home = F.when(~base_failed(), F.col("id")).alias("passing_id")
    lines = keyed.select("row_id", "id", home, "row_key", "host_key", F.inline("lines"))
    if line_limit is None:
        texts = keyed.groupBy("host_key", "row_key").agg(F.lit(1).alias("held")).groupBy("host_key").agg(F.count("*").alias("texts"))
        above = (
            lines.groupBy("host_key", "line_hash", "row_key")
            .agg(F.min("passing_id").alias("least_id"))
            .groupBy("host_key", "line_hash")
            .agg(F.count("*").alias("line_docs"), F.min("least_id").alias("home_id"))
            .where(F.col("line_docs") > LEAST_TEXTS)
            .join(texts, "host_key")
            .where(100 * F.col("line_docs") > LINE_PERCENT * F.col("texts"))
        )
    else:
        above = (
            lines.groupBy("host_key", "line_hash")
            .agg(F.count("*").alias("line_docs"), F.min("id").alias("home_id"))
            .where(F.col("line_docs") > line_limit)
        )
    return lines.join(above, ["host_key", "line_hash"]).where(~F.col("id").eqNullSafe(F.col("home_id")))


def judged(profile: DataFrame, line_limit: int | None, max_lost: float) -> DataFrame:
    """The profile's rows with what they lose and their verdicts."""
    lost = (
        lines_above(profile, line_limit)
        .groupBy("row_id")
        .agg(
            F.sum("line_chars").alias("lost_chars"),
            F.sum("line_times").alias("lost_lines"),
            F.collect_list("line_hash").alias("lost_hashes"),
        )
    )
    return (
        profile.drop("lines", "host")
        .join(lost, "row_id", "left")
        .na.fill(0, ["lost_chars", "lost_lines"])
        .withColumn("base_failed", base_failed())
        .withColumn("depleted", F.col("lost_chars") > max_lost * F.col("word_chars"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def quality_verdicts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    line_limit: int | None = None,
    max_lost: float = MAX_LOST,
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, what it loses, ``depleted`` and ``kept``."""
    verdicts = judged(line_profile(docs, id_column, text_column, host_column), line_limit, max_lost)
    return verdicts.select(
        F.col("id").alias(id_column), *COUNTS, "base_failed", "lost_chars", "lost_lines", "depleted", "kept"
    )


def without_lines(docs: DataFrame, text_column: str, hashes_column: str) -> DataFrame:
    """``docs`` with the lines of the given hashes cut out of their texts."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != hashes_column])

    def run(batch) -> dict:
        texts = []
        for text, hashes in zip(as_bytes(batch[text_column]), batch[hashes_column].to_pylist(), strict=True):
            if text is not None and hashes:
                gone = set(hashes)
                text = b"\n".join(line for line in text.split(b"\n") if not characters(line) or line_hash(line) not in gone)
            texts.append(None if text is None else text.decode())
        return {f.name: texts if f.name == text_column else batch[f.name] for f in schema.fields}

    return map_columns(docs, run, schema)


def clean_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    line_limit: int | None = None,
    max_lost: float = MAX_LOST,
) -> DataFrame:
    """The documents that pass, without their lines above the limit; all columns of ``docs``.

    Only rows that are rejected or lose lines are looked for; texts move in the
    join only where those are too many for Spark to broadcast.
    """
    verdicts = judged(line_profile(docs, id_column, text_column, host_column), line_limit, max_lost)
    id_name, key, passes, hashes = fresh_names(docs, "id", "key", "kept", "hashes")
    changed = (
        verdicts.where(~F.col("kept") | (F.col("lost_lines") > 0))
        .groupBy(F.col("id").alias(id_name), F.col("row_key").alias(key))
        .agg(F.min("kept").alias(passes), F.first("lost_hashes").alias(hashes))
    )
    same_row = F.col(id_column).cast("long").eqNullSafe(F.col(id_name)) & (row_key(text_column, host_column) == F.col(key))
    kept = docs.join(changed, same_row, "left").where(F.coalesce(passes, F.lit(True)))
    touched = kept.select(*[F.col(f"`{name}`") for name in docs.columns], hashes)
    return without_lines(touched, text_column, hashes)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_rules": op10_quality_rules}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
ORACLE = {
    "op10_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce('=' || source, '') AS host, coalesce('=' || text, '') AS body,
         coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), hosts AS (SELECT host, count(DISTINCT body) AS texts FROM d GROUP BY host
), lines AS (
  SELECT row_id, doc_id, host, body, line, length(array_to_string({_WORDS.format("line")}, '')) AS chars,
         regexp_replace(translate(array_to_string({_WORDS.format("line")}, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm
  FROM (SELECT row_id, doc_id, host, body, unnest(string_split(t, chr(10))) AS line FROM d)
), worded AS (SELECT * FROM lines WHERE chars > 0
), dup AS (
  SELECT row_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY row_id
), windows AS (
  SELECT row_id, i, list_slice(w, i, i + {WINDOW_WORDS - 1}) AS win
  FROM (SELECT row_id, w, unnest(range(1, len(w) - {WINDOW_WORDS - 2})) AS i FROM d)
), twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS n FROM windows) WHERE n > 1
), rep AS (
  SELECT row_id, count(DISTINCT spot) AS n_repeat_words
  FROM (SELECT row_id, unnest(range(i, i + {WINDOW_WORDS})) AS spot FROM twice) GROUP BY row_id
), failed AS (
  SELECT row_id, len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed
  FROM d LEFT JOIN rep USING (row_id)
), own AS (
  SELECT row_id, doc_id, host, body, norm, sum(chars) AS chars, count(*) AS times FROM worded GROUP BY ALL
), held AS (
  SELECT host, norm, min(CASE WHEN NOT base_failed THEN doc_id END) AS home, count(DISTINCT body) AS line_docs
  FROM own JOIN failed USING (row_id) GROUP BY host, norm HAVING count(DISTINCT body) > {LEAST_TEXTS}
), above AS (
  SELECT host, norm, home FROM held JOIN hosts USING (host) WHERE 100 * line_docs > {LINE_PERCENT} * texts
), lost AS (
  SELECT row_id, sum(chars) AS lost_chars, sum(times) AS lost_lines FROM own JOIN above USING (host, norm)
  WHERE doc_id IS DISTINCT FROM home GROUP BY row_id
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, base_failed,
         coalesce(lost_chars, 0)::BIGINT AS lost_chars, coalesce(lost_lines, 0)::BIGINT AS lost_lines
  FROM d JOIN failed USING (row_id) LEFT JOIN dup USING (row_id) LEFT JOIN lost USING (row_id) LEFT JOIN rep USING (row_id)
), judged AS (SELECT *, lost_chars > {MAX_LOST} * word_chars AS depleted FROM counted
)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""
}
