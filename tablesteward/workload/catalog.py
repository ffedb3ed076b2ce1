"""Registered queries: profiling tables, schema cards, index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteward.operators import cardindex, cards, profile
from tablesteward.session import materialize, scratch_path
from tablesteward.sources.footers import FooterStore, column_bytes, footer_inventory, table_rows
from tablesteward.sources.partitions import PartitionedTable
from tablesteward.sources.snapshots import SnapshotTable
from tablesteward.sources.tables import TableRef, data_files, partition_summaries
from tablesteward.workload import inputs
from tablesteward.workload.inputs import DATASET, DESCRIPTIONS, INDEX_SQL, PROJECT, TABLES, table, table_refs

MODEL, WIDTH = "hashed-terms", 1536


def catalog_tables(spark, sf_dir):
    return cards.catalog_tables(spark, table_refs(sf_dir)).select(
        "table_id", "dataset", "table", "table_type", "description", "num_rows"
    )


def column_logical_bytes(spark, sf_dir):
    return profile.column_logical_bytes(spark, table_refs(sf_dir)).withColumnRenamed("column", "column_name")


def footer_sizes(spark, sf_dir):
    """Columns found in the footers; byte counts depend on the writer, so only their presence is shown."""
    inventory = footer_inventory(data_files(spark, table_refs(sf_dir)))
    return (
        table_rows(inventory)
        .join(column_bytes(inventory), "table_id")
        .select("table_id", F.col("column").alias("column_name"), "num_rows", (F.col("plain_bytes") > 0).alias("stored"))
    )


def index_change(spark, sf_dir):
    """The older index kept in partitions, brought up to date with the live cards in one change."""
    live, older = inputs.index_inputs(spark, sf_dir)
    kept = PartitionedTable(spark, scratch_path(spark, "partitioned-index"), ["doc_id"])
    kept.write(older)
    gone = kept.read().select("doc_id").join(live.select("doc_id"), "doc_id", "left_anti")
    kept.change(cardindex.stale_cards(live, kept.read(), MODEL, WIDTH), gone)
    return kept.read()


def footer_refresh(spark, sf_dir):
    """Events kept as a file per type; the inventory at first, unchanged, and after one type is written anew."""
    path = scratch_path(spark, "events-by-type")
    table(spark, sf_dir, "events").repartition("event_type").write.partitionBy("event_type").parquet(path)
    ref, store = TableRef(PROJECT, DATASET, "events_by_type", path), FooterStore(spark, scratch_path(spark, "footer-store"))
    steps = []
    for step in range(3):
        if step == 2:
            clicks = materialize(table(spark, sf_dir, "events").where("event_type = 'click' AND value > 100").drop("event_type"), "clicks")
            clicks.coalesce(1).write.mode("overwrite").parquet(f"{path}/event_type=click")
        done = store.refresh([ref])
        counted = table_rows(store.read()).select(
            F.lit(step).alias("step"), F.lit(done.read).alias("files_read"), F.lit(done.kept).alias("files_kept"),
            F.lit(done.dropped).alias("files_dropped"), "num_rows",
        )
        steps.append(materialize(counted, "footer-step"))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def partitioned_events(spark, sf_dir):
    """Events written by day, then described from what is on disk."""
    path = scratch_path(spark, "events-by-day")
    by_day = table(spark, sf_dir, "events").withColumn("event_day", F.to_date("ts"))
    # Few files per day, and a day too large for one task is split.
    by_day.hint("rebalance", "event_day").write.partitionBy("event_day").parquet(path)
    ref = TableRef(PROJECT, DATASET, "events_by_day", path)
    summary, _ = partition_summaries(spark, [ref])[ref.table_id]
    return ref.read(spark).agg(
        F.lit(ref.table_id).alias("table_id"),
        F.lit(summary).alias("partition_summary"),
        F.countDistinct("event_day").alias("partitions"),
        F.count(F.lit(1)).alias("num_rows"),
    ).select("table_id", "partition_summary", "partitions", "num_rows")


def sample_cells(spark, sf_dir):
    cells = profile.sample_cells(spark, table_refs(sf_dir))
    return cells.select("table_id", "ordinal", F.col("column").alias("column_name"), "row_no", "cell")


def format_cell(spark, sf_dir):
    from tablesteward.functions.text import format_cell as rendered

    return table(spark, sf_dir, "pages").select("page_id", rendered(F.col("html")).alias("cell"))


def distinctive_values(spark, sf_dir):
    found = profile.distinctive_values(profile.sample_cells(spark, table_refs(sf_dir)))
    return found.select("table_id", "position", F.col("column").alias("column_name"), "values")


def schema_cards(spark, sf_dir):
    return cards.collect_cards(spark, table_refs(sf_dir)).select("table_id", "card")


def embed_text(spark, sf_dir):
    return cards.collect_cards(spark, table_refs(sf_dir)).select("table_id", "embed_text")


def content_hash(spark, sf_dir):
    return cards.collect_cards(spark, table_refs(sf_dir)).select("doc_id", "content_hash")


def index_diff(spark, sf_dir):
    live, index = inputs.index_inputs(spark, sf_dir)
    return cardindex.index_diff(live, index, MODEL, WIDTH)


def _updated(spark, sf_dir):
    """The index after stale cards were put in, as a committed snapshot."""
    live, index = inputs.index_inputs(spark, sf_dir)
    store = SnapshotTable(spark, scratch_path(spark, "index"))
    store.write(index)
    stored = store.read()
    store.write(cardindex.upsert(stored, cardindex.stale_cards(live, stored, MODEL, WIDTH)))
    return live, store


def index_upsert(spark, sf_dir):
    return _updated(spark, sf_dir)[1].read()


def index_prune(spark, sf_dir):
    live, store = _updated(spark, sf_dir)
    return cardindex.prune(store.read(), live)


QUERIES = {
    f.__name__: f
    for f in (
        catalog_tables, column_logical_bytes, sample_cells, format_cell, distinctive_values, schema_cards, embed_text,
        content_hash, index_diff, index_upsert, index_prune, index_change, footer_refresh,
    )
} | {"footer_inventory": footer_sizes, "partition_summary": partitioned_events}


# ---- the same in SQL, from a plain list of the tables' columns ----

COLUMNS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}
FIELDS = {name: [tuple(c.split(" ")) for c in columns.split(", ")] for name, columns in COLUMNS.items()}
WIDTHS = {"INT": 4, "BIGINT": 8, "DOUBLE": 8, "TIMESTAMP_NTZ": 8}


def _id(name: str) -> str:
    return f"{PROJECT}.{DATASET}.{name}"


def _plain_type(kind: str) -> tuple[str, str]:
    return (kind[:-2], "REPEATED") if kind.endswith("[]") else (kind, "NULLABLE")


def _bytes_sql(column: str, kind: str) -> str:
    if kind == "STRING":
        return f"coalesce(sum(strlen({column})), 0)"
    if kind == "FLOAT[]":
        return f"coalesce(sum(len({column})) * 4, 0)"
    return f"count({column}) * {WIDTHS[kind]}"


def _cell_sql(column: str, kind: str) -> str:
    text = {
        "STRING": column,
        "TIMESTAMP_NTZ": f"CASE WHEN date_part('us', {column}) % 1000000 = 0 THEN strftime({column}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') END",
    }.get(kind, f"CAST({column} AS VARCHAR)")
    line = rf"regexp_replace(replace(replace({text}, chr(10), ' '), '|', '\|'), '^\s+|\s+$', '', 'g')"
    return f"coalesce(CASE WHEN length({line}) > 60 THEN substr({line}, 1, 60) || '…' ELSE {line} END, 'NULL')"


def _cells_sql() -> str:
    parts = []
    for name, fields in FIELDS.items():
        scalars = [(c, k) for c, k in fields if not k.endswith("[]")]
        order = ", ".join(f"{c} NULLS LAST" for c in (*TABLES[name], *[c for c, _ in scalars]))
        top = f"(SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM (SELECT * FROM {name} ORDER BY {order} LIMIT 5))"
        for ordinal, (column, kind) in enumerate(scalars, start=1):
            parts.append(
                f"SELECT '{_id(name)}' AS table_id, {ordinal} AS ordinal, '{column}' AS column_name, '{kind}' AS type, "
                f"CAST(rn AS INTEGER) AS row_no, {_cell_sql(column, kind)} AS cell FROM {top}"
            )
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


CELLS = _cells_sql()
COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT '{_id(n)}' AS table_id, '{n}' AS tab, '{DESCRIPTIONS.get(n, '')}' AS description, count(*) AS num_rows FROM {n}"
    for n in FIELDS
) + ")"
# Columns as rows, found again by their place in the list.
COLUMN_ROWS = "cols AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{_id(n)}', {i}, '{c}', '{_plain_type(k)[0]}', '{_plain_type(k)[1]}')"
    for n, fields in FIELDS.items()
    for i, (c, k) in enumerate(fields, start=1)
) + ") v(table_id, ordinal, path, type, mode))"

DISTINCTIVE = r"""vals AS (
  SELECT table_id, ordinal, column_name, string_agg(DISTINCT cell, ', ' ORDER BY cell) FILTER (cell <> 'NULL') AS found
  FROM cells WHERE type = 'STRING'
    AND NOT regexp_matches(lower(column_name), 'address|city|county|state|site|cbsa|zip|postal|street|location|latitude|longitude')
  GROUP BY ALL
  HAVING count(DISTINCT cell) FILTER (cell <> 'NULL') BETWEEN 1 AND count(*) - 1
    AND max(length(cell)) FILTER (cell <> 'NULL') <= 40
    AND NOT bool_and(regexp_full_match(cell, '[0-9.+:/ -]+')) FILTER (cell <> 'NULL')),
distinctive AS (
  SELECT * FROM (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY ordinal) AS position, column_name, found FROM vals)
  WHERE position <= 8)"""

CARD_TEXTS = f"""{CELLS}, {COUNTS}, {COLUMN_ROWS}, {DISTINCTIVE},
col_text AS (
  SELECT table_id,
    string_agg('- `' || path || '` (' || type || CASE mode WHEN 'REPEATED' THEN ', REPEATED' ELSE '' END || ')', chr(10) ORDER BY ordinal) AS bullets,
    string_agg(path, ', ' ORDER BY ordinal) AS names
  FROM cols GROUP BY 1),
grid_rows AS (
  SELECT table_id, row_no, string_agg(cell, ' | ' ORDER BY ordinal) AS line,
    string_agg(column_name, ' | ' ORDER BY ordinal) AS head, string_agg('---', ' | ') AS rule
  FROM cells GROUP BY 1, 2),
grid AS (
  SELECT table_id, chr(10) || chr(10) || '## Sample rows (' || count(*) || ')' || chr(10) || min(head) || chr(10) || min(rule)
    || chr(10) || string_agg(line, chr(10) ORDER BY row_no) AS grid_text
  FROM grid_rows GROUP BY 1),
value_text AS (
  SELECT table_id, chr(10) || 'Representative values:' || chr(10)
    || string_agg('- ' || column_name || ': ' || found, chr(10) ORDER BY position) AS value_lines
  FROM distinctive GROUP BY 1),
facts AS (
  SELECT c.*, bullets, names, grid_text, value_lines,
    CASE WHEN description <> '' THEN 'Description: ' || description || chr(10) ELSE '' END
      || 'Approximate rows: ' || format('{{:,}}', num_rows) || chr(10) AS about
  FROM counts c JOIN col_text USING (table_id) LEFT JOIN grid USING (table_id) LEFT JOIN value_text USING (table_id)),
texts AS (
  SELECT table_id, replace(table_id, '/', '_') AS doc_id,
    '# Table: `' || table_id || '`' || chr(10) || about || chr(10) || '## Columns' || chr(10) || bullets
      || coalesce(grid_text, '') AS card,
    'Warehouse table: ' || table_id || chr(10) || 'Table name: ' || replace(tab, '_', ' ') || chr(10)
      || 'Dataset: {DATASET.replace("_", " ")}' || chr(10) || about || 'Columns: ' || names
      || coalesce(value_lines, '') AS embed_text
  FROM facts)"""

_STALE = """stale AS (
  SELECT * FROM cards c WHERE NOT EXISTS (
    SELECT 1 FROM old_index o WHERE o.doc_id = c.doc_id AND o.content_hash = c.content_hash
      AND o.embedding_model = 'hashed-terms' AND o.embedding_dimensions = 1536)),
new_index AS (
  SELECT * FROM stale UNION ALL SELECT * FROM old_index WHERE doc_id NOT IN (SELECT doc_id FROM stale))"""

ORACLE = {
    "catalog_tables": f"WITH {COUNTS} SELECT table_id, '{DATASET}' AS dataset, tab AS \"table\", 'TABLE' AS table_type, "
    "description, num_rows FROM counts",
    "column_logical_bytes": " UNION ALL ".join(
        f"SELECT '{_id(n)}' AS table_id, count(*) AS rows, {i} AS ordinal, '{c}' AS column_name, "
        f"'{_plain_type(k)[0]}' AS type, '{_plain_type(k)[1]}' AS mode, CAST({_bytes_sql(c, k)} AS BIGINT) AS logical_bytes FROM {n}"
        for n, fields in FIELDS.items()
        for i, (c, k) in enumerate(fields, start=1)
    ),
    "index_change": f"WITH {INDEX_SQL} SELECT doc_id, content_hash, embedding_model, embedding_dimensions FROM cards",
    "footer_refresh": """WITH t AS (SELECT CAST(count(DISTINCT event_type) AS INTEGER) AS n, count(*) AS num_rows,
  count(*) FILTER (event_type <> 'click' OR value > 100) AS later_rows FROM events)
SELECT 0 AS step, n AS files_read, 0 AS files_kept, 0 AS files_dropped, num_rows FROM t
UNION ALL SELECT 1, 0, n, 0, num_rows FROM t UNION ALL SELECT 2, 1, n - 1, 1, later_rows FROM t""",
    "footer_inventory": " UNION ALL ".join(
        f"SELECT '{_id(n)}' AS table_id, '{c}' AS column_name, count(*) AS num_rows, true AS stored FROM {n}"
        for n, fields in FIELDS.items()
        for c, _ in fields
    ),
    "partition_summary": f"SELECT '{_id('events_by_day')}' AS table_id, 'DAY on `event_day`' AS partition_summary, "
    "count(DISTINCT CAST(ts AS DATE)) AS partitions, count(*) AS num_rows FROM events",
    "sample_cells": f"WITH {CELLS} SELECT table_id, ordinal, column_name, row_no, cell FROM cells",
    "format_cell": f"SELECT page_id, {_cell_sql('html', 'STRING')} AS cell FROM pages",
    "distinctive_values": f"WITH {CELLS}, {DISTINCTIVE} SELECT table_id, CAST(position AS INTEGER) AS position, column_name, "
    "found AS \"values\" FROM distinctive",
    "schema_cards": f"WITH {CARD_TEXTS} SELECT table_id, card FROM texts",
    "embed_text": f"WITH {CARD_TEXTS} SELECT table_id, embed_text FROM texts",
    "content_hash": f"WITH {CARD_TEXTS} SELECT doc_id, sha256(card || chr(0) || embed_text) AS content_hash FROM texts",
    "index_diff": f"""WITH {INDEX_SQL}
SELECT coalesce(c.doc_id, o.doc_id) AS doc_id,
  CASE WHEN c.doc_id IS NULL THEN 'removed' WHEN o.doc_id IS NULL THEN 'new'
    WHEN o.embedding_model = 'hashed-terms' AND o.content_hash = c.content_hash THEN 'unchanged' ELSE 'changed' END AS change
FROM cards c FULL JOIN old_index o ON c.doc_id = o.doc_id""",
    "index_upsert": f"WITH {INDEX_SQL}, {_STALE} SELECT * FROM new_index",
    "index_prune": f"WITH {INDEX_SQL}, {_STALE} SELECT * FROM new_index WHERE doc_id IN (SELECT doc_id FROM cards)",
}
