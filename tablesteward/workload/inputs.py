"""Inputs of the registered queries: the given tables and what is derived from them.

Each derived table is also written as SQL for the check engine, in its own
words; both keep every row of the tables they come from.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteward.sources.tables import TableRef, folder_tables

PROJECT, DATASET = "warehouse", "retail_mart"

# The given tables: what a sample is ordered by, and a description for some.
TABLES = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}
DESCRIPTIONS = {
    "orders": "Customer orders with status, price and date.",
    "lineitem": "Items of each order with quantity, price and shipping date.",
    "supplier": "Suppliers and their account balance.",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_refs(sf_dir: str) -> list[TableRef]:
    refs = folder_tables(sf_dir, list(TABLES), DATASET, PROJECT)
    return [replace(r, sample_order=TABLES[r.table], description=DESCRIPTIONS.get(r.table, "")) for r in refs]


def text_literal(text: str) -> str:
    """``text`` as a SQL literal, line breaks written as chr(10)."""
    quoted = text.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{part}'" for part in quoted) + ")"


# SQL texts by shape: the text, the statement inside it, and the expected
# verdict. {u}, {k} and {t} stand for values of the event a text comes from.
_PLAIN = "SELECT event_type, avg(value) AS v FROM events WHERE user_id = {u} GROUP BY event_type"
QUERY_SHAPES = [
    (_PLAIN, _PLAIN, "ok"),
    ("Here it is:\n```sql\n" + _PLAIN + "\n```\nDone; enjoy.", _PLAIN, "ok"),
    ("```GoogleSQL\n" + _PLAIN, _PLAIN, "ok"),
    ("  " + _PLAIN + " ;\n;", _PLAIN, "ok"),
    ("SELECT {k}; DELETE FROM events", None, "multiple_statements"),
    ("SELECT user_id FROM events WHERE note = 'a;b {t}'",) * 2 + ("ok",),
    ("SELECT user_id FROM events -- first; then {t}",) * 2 + ("ok",),
    ("CREATE TABLE t_{u} AS SELECT {k}",) * 2 + ("not_read_only",),
    ("update events SET value = {k} WHERE user_id = {u}",) * 2 + ("not_read_only",),
    ("WITH t AS (SELECT user_id, value FROM events) SELECT user_id FROM t WHERE value > {k}",) * 2 + ("ok",),
    ("WITH t AS (SELECT {k}) DELETE FROM events",) * 2 + ("not_read_only",),
    ('SELECT user_id FROM events WHERE note = "DROP {t}" # create {k}',) * 2 + ("ok",),
    ("SELECT created_at, updated_by FROM events WHERE user_id = {u}",) * 2 + ("ok",),
    ("/* {t}; */ (SELECT {u}) UNION ALL (SELECT `a;b` FROM events)",) * 2 + ("ok",),
    (" \n;", None, "empty"),
    ("EXPORT DATA OPTIONS(uri='''x;{k}''') AS SELECT {u}",) * 2 + ("not_read_only",),
    (
        "SELECT l.l_extendedprice * l.l_discount AS cut FROM lineitem AS l JOIN orders o ON l.l_orderkey = o.o_orderkey "
        "WHERE o.o_custkey = {u}",
    ) * 2 + ("ok",),
    (
        "WITH big AS (SELECT o_custkey, o_totalprice FROM `warehouse.retail_mart.orders` WHERE o_totalprice > {k}) "
        "SELECT c.c_name FROM customer c JOIN big b ON b.o_custkey = c.c_custkey",
    ) * 2 + ("ok",),
    ("SELECT * FROM retail_mart.documents WHERE lang = '{t}'",) * 2 + ("ok",),
    ("SELECT count(*) AS n FROM pages -- {u}",) * 2 + ("ok",),
    ("SELECT n_name FROM nation WHERE n_nationkey <> {k} UNION ALL SELECT r_name FROM region ORDER BY n_name",) * 2 + ("ok",),
    (
        "SELECT p.html FROM pages p WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id AND n_chars > {k})",
    ) * 2 + ("ok",),
    ("SELECT e.embedding, d.* FROM embeddings AS e, documents AS d WHERE e.vec_id = d.doc_id + {k}",) * 2 + ("ok",),
    ("WITH events AS (SELECT ts FROM events WHERE event_type = '{t}') SELECT max(ts) AS value FROM events ORDER BY value",) * 2 + ("ok",),
]
SHAPE_COUNT = len(QUERY_SHAPES)

# Columns of the given tables that the statement of each accepted shape names, for the check engine.
_EVENTS = [("events", "event_type"), ("events", "value"), ("events", "user_id")]
_DOCUMENTS = [("documents", c) for c in ("doc_id", "text", "lang", "source", "n_chars")]
SHAPE_COLUMNS = {
    **{shape: _EVENTS for shape in range(4)},
    **{shape: [("events", "user_id")] for shape in (5, 6, 11, 12)},
    9: [("events", "user_id"), ("events", "value")],
    16: [("lineitem", c) for c in ("l_extendedprice", "l_discount", "l_orderkey")] + [("orders", "o_orderkey"), ("orders", "o_custkey")],
    17: [("orders", "o_custkey"), ("orders", "o_totalprice"), ("customer", "c_name"), ("customer", "c_custkey")],
    18: _DOCUMENTS,
    20: [("nation", "n_name"), ("nation", "n_nationkey"), ("region", "r_name")],
    21: [("pages", "html"), ("pages", "page_id"), ("documents", "doc_id"), ("documents", "n_chars")],
    22: [("embeddings", "embedding"), ("embeddings", "vec_id"), *_DOCUMENTS],
    23: [("events", "ts"), ("events", "event_type")],
}


def _k(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, shape, sql``: one text per event, its shape from the id."""
    events = table(spark, sf_dir, "events")
    shape = F.pmod("event_id", F.lit(SHAPE_COUNT)).cast("int")
    template = F.element_at(F.array(*[F.lit(text) for text, _, _ in QUERY_SHAPES]), shape + 1)
    filled = template
    for mark, value in (("{u}", F.col("user_id").cast("string")), ("{k}", _k().cast("string")), ("{t}", F.col("event_type"))):
        filled = F.replace(filled, F.lit(mark), value)
    return events.select(F.col("event_id").alias("query_id"), shape.alias("shape"), filled.alias("sql"))


def _filled_sql(template: str) -> str:
    return (
        f"replace(replace(replace({template}, '{{u}}', CAST(user_id AS VARCHAR)), "
        "'{k}', json_extract_string(props, '$.k')), '{t}', event_type)"
    )


def _list_sql(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else text_literal(v) for v in values) + "]"


QUERY_LOG_SQL = f"""query_log AS (
  SELECT event_id AS query_id, CAST(event_id % {SHAPE_COUNT} AS INTEGER) AS shape,
    {_filled_sql(f"({_list_sql([t for t, _, _ in QUERY_SHAPES])})[event_id % {SHAPE_COUNT} + 1]")} AS sql,
    {_filled_sql(f"({_list_sql([i for _, i, _ in QUERY_SHAPES])})[event_id % {SHAPE_COUNT} + 1]")} AS inner_sql,
    ({_list_sql([v for _, _, v in QUERY_SHAPES])})[event_id % {SHAPE_COUNT} + 1] AS verdict
  FROM events)"""


QUERY_COLUMNS_SQL = (
    "query_columns AS (SELECT event_id AS query_id, table_id, column_name FROM events JOIN (VALUES "
    + ", ".join(
        f"({shape}, '{PROJECT}.{DATASET}.{t}', '{c}')" for shape, used in SHAPE_COLUMNS.items() for t, c in used
    )
    + f") m(shape, table_id, column_name) ON m.shape = event_id % {SHAPE_COUNT})"
)


def shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events of the ``events`` table: one session per user and day."""
    k, kind = _k(), F.col("event_type")
    number = k.cast("string")

    def state(**values):
        flat = [item for key, value in values.items() for item in (F.lit(key.replace("temp_", "temp:")), value)]
        return F.create_map(*flat)

    nothing = F.lit(None).cast("string")
    texts = (
        F.when(kind == "click", F.array(F.lit("clicked"), F.lit(""), F.col("props")))
        .when(kind == "purchase", F.array(F.concat(F.lit("bought item "), number), F.repeat(F.lit("x"), k)))
        .when(kind == "error", F.array(F.concat(F.lit("error "), number)))
        .when(kind == "signup", F.array(F.lit("welcome"), nothing))
        .otherwise(F.array().cast("array<string>"))
    )
    delta = (
        F.when(kind == "click", state(last_click=number))
        .when(kind == "view", state(__view__=number, cart=number))
        .when(kind == "purchase", state(cart=nothing))
        .when(kind == "error", state(temp_error=number, last_error=number))
        .otherwise(state(last_click=nothing))
    )
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        F.lit("shop").alias("app_name"),
        user.alias("user_id"),
        F.concat(user, F.lit("-"), F.date_format(F.to_date("ts"), "yyyyMMdd")).alias("session_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        "ts",
        F.lit(0).alias("arrival"),
        F.when(kind.isin("click", "view"), F.lit("user")).otherwise(F.lit("assistant")).alias("author"),
        (k % 10 == 3).alias("partial"),
        ((kind == "signup") & (k % 7 == 0)).alias("compaction"),
        texts.alias("texts"),
        delta.alias("state_delta"),
    )


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events of the ``conversations`` table, a minute per turn."""
    conversation = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    minute = F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))
    return table(spark, sf_dir, "conversations").select(
        F.lit("chat").alias("app_name"),
        conversation.alias("user_id"),
        conversation.alias("session_id"),
        F.concat_ws("-", conversation, F.col("turn").cast("string")).alias("event_id"),
        (F.lit("2024-02-01 00:00:00").cast("timestamp_ntz") + minute).alias("ts"),
        F.lit(0).alias("arrival"),
        F.col("role").alias("author"),
        F.lit(False).alias("partial"),
        (F.col("role") == "system").alias("compaction"),
        F.split("text", "\n").alias("texts"),
        F.create_map(F.lit("topic"), F.col("text")).alias("state_delta"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop_events(spark, sf_dir).unionByName(chat_events(spark, sf_dir))


def resent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All session events, and errors sent again with another text."""
    events = session_events(spark, sf_dir)
    again = events.where(F.get("texts", F.lit(0)).startswith("error ") & (F.col("app_name") == "shop")).withColumns(
        {"arrival": F.lit(1), "texts": F.array(F.concat(F.lit("resent "), F.get("texts", F.lit(0))))}
    )
    return events.unionByName(again)


def restated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All session events, errors sent again with another text and another state."""
    again = resent_events(spark, sf_dir).where("arrival = 1")
    told = F.concat(F.lit("again "), F.element_at("state_delta", "last_error"))
    changed = again.withColumn("state_delta", F.create_map(F.lit("last_error"), told))
    return session_events(spark, sf_dir).unionByName(changed)


SESSION_EVENTS_SQL = """shop AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'u' || user_id AS who FROM events),
session_events AS (
  SELECT 'shop' AS app_name, who AS user_id, who || '-' || strftime(ts, '%Y%m%d') AS session_id,
    'e' || event_id AS event_id, ts, 0 AS arrival,
    CASE WHEN event_type IN ('click', 'view') THEN 'user' ELSE 'assistant' END AS author,
    k % 10 = 3 AS partial, event_type = 'signup' AND k % 7 = 0 AS compaction,
    CASE event_type WHEN 'click' THEN ['clicked', '', props]
      WHEN 'purchase' THEN ['bought item ' || k, repeat('x', k)]
      WHEN 'error' THEN ['error ' || k] WHEN 'signup' THEN ['welcome', NULL]
      ELSE CAST([] AS VARCHAR[]) END AS texts,
    event_type AS kind, CAST(k AS VARCHAR) AS mark
  FROM shop
  UNION ALL
  SELECT 'chat', 'c' || conv_id, 'c' || conv_id, 'c' || conv_id || '-' || turn,
    TIMESTAMP '2024-02-01 00:00:00' + to_minutes(turn), 0, role, false, role = 'system',
    string_split(text, chr(10)), 'chat', text
  FROM conversations)"""


def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callback records of the ``events`` table with some empty fields."""
    kinds = {"click": "llm_request", "view": "llm_response", "purchase": "tool_completed", "error": "llm_error"}
    kind = F.lit("user_message")
    for event_type, name in kinds.items():
        kind = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(kind)
    is_response, failed = F.col("event_type") == "view", F.col("event_type") == "error"
    fields = F.create_map(
        F.lit("invocation"), F.concat(F.lit("i"), F.col("event_id").cast("string")),
        F.lit("branch"), F.lit(""),
        F.lit("tokens_in"), F.when(is_response, _k().cast("string")),
        F.lit("tokens_out"), F.when(is_response, F.col("user_id").cast("string")),
        F.lit("error"), F.when(failed, F.concat(F.lit("timeout "), _k().cast("string"))),
    )
    return table(spark, sf_dir, "events").select(
        "ts",
        kind.alias("kind"),
        F.concat(F.lit("agent_"), F.pmod("user_id", F.lit(7)).cast("string")).alias("agent"),
        fields.alias("fields"),
        (_k() % 4 == 1).alias("partial"),
    )


def invocation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of invocations from ``conversations``: one step per turn."""
    number = F.col("turn").cast("string")
    assistant = F.col("role") == "assistant"
    call = F.struct(
        F.concat(F.lit("call_"), number).alias("id"),
        F.when(F.col("text").contains("\n"), F.lit("run_query")).otherwise(F.lit("look_up")).alias("name"),
        F.col("text").alias("args"),
    )
    response = F.struct(
        F.concat(F.lit("call_"), number).alias("id"), F.lit("run_query").alias("name"), F.sha2("text", 256).alias("response")
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("invocation_id"),
        F.col("turn").alias("seq"),
        F.col("role").alias("author"),
        "text",
        F.when(assistant, call).alias("call"),
        F.when(F.col("role") == "system", response).alias("response"),
        assistant.alias("final"),
    )


def index_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cards made of ``documents``, and an older index of them and of ``pages``.

    Against the cards the index misses one source, holds German entries of
    another model, hashes of shortened text for long documents, and pages that
    are no longer live.
    """
    from tablesteward.operators.cards import with_identity

    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")

    def cards(df: DataFrame, prefix: str, key: str, card):
        named = df.withColumns(
            {
                "table_id": F.concat(F.lit(prefix), F.col(key).cast("string")),
                "card": card,
                "embed_text": card,
                "embedding_dimensions": F.lit(1536),
            }
        )
        return with_identity(named)

    columns = ["doc_id", "content_hash", "embedding_model", "embedding_dimensions"]
    live = cards(documents.withColumnRenamed("doc_id", "key"), "documents/", "key", F.col("text"))
    live = live.withColumn("embedding_model", F.lit("hashed-terms"))
    older_text = F.when(F.col("n_chars") > 2000, F.substring("text", 1, 1000)).otherwise(F.col("text"))
    older = cards(
        documents.where("source != 'src0'").withColumnRenamed("doc_id", "key"), "documents/", "key", older_text
    ).withColumn("embedding_model", F.when(F.col("lang") == "de", F.lit("other-model")).otherwise(F.lit("hashed-terms")))
    gone = cards(pages, "pages/", "page_id", F.col("html")).withColumn("embedding_model", F.lit("hashed-terms"))
    return live.select(*columns), older.select(*columns).unionByName(gone.select(*columns))


def _hash_sql(text: str) -> str:
    return f"sha256({text} || chr(0) || {text})"


INDEX_SQL = f"""cards AS (
  SELECT 'documents_' || doc_id AS doc_id, {_hash_sql("text")} AS content_hash, 'hashed-terms' AS embedding_model,
    1536 AS embedding_dimensions FROM documents),
old_index AS (
  SELECT 'documents_' || doc_id AS doc_id,
    CASE WHEN n_chars > 2000 THEN {_hash_sql("substr(text, 1, 1000)")} ELSE {_hash_sql("text")} END AS content_hash,
    CASE WHEN lang = 'de' THEN 'other-model' ELSE 'hashed-terms' END AS embedding_model, 1536 AS embedding_dimensions
  FROM documents WHERE source <> 'src0'
  UNION ALL
  SELECT 'pages_' || page_id, {_hash_sql("html")}, 'hashed-terms', 1536 FROM pages)"""
