"""Registered queries: SQL audit, scan cost, governed runs, JSON-safe results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteward.functions import jsonsafe, sqltext
from tablesteward.functions.text import format_bytes as bytes_text
from tablesteward.operators import audit, profile, references, scancost
from tablesteward.plans.governed import Warehouse, governed_sql
from tablesteward.session import materialize
from tablesteward.workload import inputs
from tablesteward.workload.inputs import DATASET, PROJECT, QUERY_COLUMNS_SQL, QUERY_LOG_SQL, table, table_refs

# A ceiling that the texts reading long columns exceed at every scale given.
COST_LIMIT = 1_000_000


def sql_unfence(spark, sf_dir):
    return inputs.query_log(spark, sf_dir).select("query_id", sqltext.unfence(F.col("sql")).alias("unfenced"))


def sql_mask(spark, sf_dir):
    """Masked texts of the query log and of all pages."""
    log = inputs.query_log(spark, sf_dir).select(F.lit("query").alias("origin"), F.col("query_id").alias("id"), F.col("sql").alias("body"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    return log.unionByName(pages).select("origin", "id", sqltext.mask(F.col("body")).alias("masked"))


def sql_sanitize(spark, sf_dir):
    return sqltext.with_cleaned_sql(inputs.query_log(spark, sf_dir), "sql").select("query_id", "cleaned", "error_code")


def sql_verdict(spark, sf_dir):
    return sqltext.with_verdict(inputs.query_log(spark, sf_dir), "sql").select("query_id", "verdict")


def _column_sizes(spark, sf_dir):
    return materialize(profile.column_logical_bytes(spark, table_refs(sf_dir)), "column-sizes")


def _costs(spark, sf_dir):
    return references.log_costs(inputs.query_log(spark, sf_dir), "query_id", "sql", _column_sizes(spark, sf_dir))


def query_references(spark, sf_dir):
    """Columns of the given tables that each accepted text of the log names."""
    return references.log_columns(inputs.query_log(spark, sf_dir), "query_id", "sql", _column_sizes(spark, sf_dir))


def sql_audit_report(spark, sf_dir):
    """Verdicts of the log, texts above the cost limit apart."""
    return audit.audit_report(inputs.query_log(spark, sf_dir), "sql", _costs(spark, sf_dir), COST_LIMIT)


def cost_verdict(spark, sf_dir):
    return scancost.cost_verdict(_costs(spark, sf_dir), COST_LIMIT)


def scan_cost_report(spark, sf_dir):
    return scancost.cost_report(_costs(spark, sf_dir), COST_LIMIT)


def format_bytes(spark, sf_dir):
    """Prices in sixteenths taken as byte counts, through all units."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    size = cents * F.element_at(F.array(*[F.lit(1024**p // 64 + 1) for p in range(5)]), F.pmod("l_orderkey", F.lit(5)).cast("int") + 1)
    sized = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", size.alias("size"))
    return sized.withColumn("size_text", bytes_text(F.col("size")))


def _name(table_name: str) -> str:
    return f"`{PROJECT}.{DATASET}.{table_name}`"


TOPK = f"""SELECT
  n.n_name AS nation,
  ROUND(AVG(l.l_extendedprice), 4) AS avg_price
FROM {_name("lineitem")} AS l
JOIN {_name("supplier")} AS s ON l.l_suppkey = s.s_suppkey
JOIN {_name("nation")} AS n ON s.s_nationkey = n.n_nationkey
WHERE l.l_shipdate BETWEEN '1998-05-01' AND '1998-05-31'
GROUP BY 1
ORDER BY avg_price DESC, nation
LIMIT 10"""

UNION = f"""(SELECT c_mktsegment AS kind, count(*) AS n FROM {_name("customer")} GROUP BY 1)
UNION ALL
(SELECT o_orderpriority AS kind, count(*) AS n FROM {_name("orders")} GROUP BY 1)"""

CTE = f"""WITH yearly AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS spent
  FROM {_name("orders")} GROUP BY o_custkey, year(o_orderdate)
)
SELECT y, count(*) AS customers, CAST(MAX(spent) AS DOUBLE) AS most FROM yearly GROUP BY y"""

JOIN = f"""SELECT c.c_mktsegment, r.r_name, count(*) AS orders, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent
FROM {_name("orders")} o
JOIN {_name("customer")} c ON o.o_custkey = c.c_custkey
JOIN {_name("nation")} n ON c.c_nationkey = n.n_nationkey
JOIN {_name("region")} r ON n.n_regionkey = r.r_regionkey
WHERE EXISTS (SELECT 1 FROM {_name("lineitem")} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
GROUP BY c.c_mktsegment, r.r_name"""

ROLLUP = f"""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
  CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM {_name("lineitem")} GROUP BY ROLLUP (l_returnflag, l_linestatus)"""


def _run(spark, sf_dir, text):
    """An accepted run of ``text`` as the answer of a model would carry it."""
    outcome = governed_sql(Warehouse.open(spark, table_refs(sf_dir)), f"```sql\n{text};\n```")
    if outcome.result is None:
        raise RuntimeError(f"{outcome.error_code}: {outcome.error}")
    return outcome


def governed_topk(spark, sf_dir):
    return _run(spark, sf_dir, TOPK).result


def governed_cte(spark, sf_dir):
    return _run(spark, sf_dir, CTE).result


def governed_union_all(spark, sf_dir):
    return _run(spark, sf_dir, UNION).result


def governed_join(spark, sf_dir):
    return _run(spark, sf_dir, JOIN).result


def governed_rollup(spark, sf_dir):
    return _run(spark, sf_dir, ROLLUP).result


def result_envelope(spark, sf_dir):
    """Envelope of the join; its priced bytes depend on the files, so only their presence is shown."""
    envelope = _run(spark, sf_dir, JOIN).envelope(spark)
    return envelope.select(
        "status", F.array_join("columns", ",").alias("columns"), "row_count", (F.col("bytes_billed") > 0).alias("priced"), "error"
    )


# Texts that have to be refused, each with its code, and two that are fine;
# {u}, {k} and {t} stand for values of the event a text comes from.
REFUSED = [
    ("SELECT `reflect`('java.lang.System', 'getProperty', 'user.{t}') AS leak", "escape_hatch"),
    (r"SELECT r'\', java_method('java.lang.System', 'getProperty', 'user.home') , 'x{k}'", "escape_hatch"),
    ("SELECT event_id FROM events WHERE event_id IN (SELECT `try_reflect`('a', '{u}'))", "escape_hatch"),
    ("SELECT TRANSFORM(event_id) USING 'cat {u}' AS (copy) FROM events", "escape_hatch"),
    ("SELECT event_id FROM parquet.`/warehouse/{u}/events.parquet`", "unknown_source"),
    ("WITH hidden AS (SELECT * FROM json.`/warehouse/{t}`) SELECT * FROM hidden", "unknown_source"),
    ("SELECT (SELECT max(c) FROM csv.`/warehouse`) AS most FROM events WHERE user_id = {u}", "unknown_source"),
    ("WITH gone AS (SELECT {k} AS x) DELETE FROM events", "not_read_only"),
    ("SELECT event_id FROM events; DROP TABLE events_{u}", "multiple_statements"),
    ("SELECT count(*) AS n FROM `warehouse.retail_mart.events` WHERE value > (SELECT avg(value) + {k} FROM events)", None),
    ("WITH t AS (SELECT user_id FROM retail_mart.events) SELECT user_id FROM t WHERE user_id = {u}", None),
    ("SELECT user_id FROM later WHERE user_id = {u} AND EXISTS (WITH later AS (SELECT 1 AS x) SELECT x FROM later)", "unknown_source"),
]


def refused_log(spark, sf_dir):
    """``event_id, shape, sql``: one of these texts per event, with values of the event."""
    shape = F.pmod("event_id", F.lit(len(REFUSED))).cast("int")
    filled = F.get(F.array(*[F.lit(text) for text, _ in REFUSED]), shape)
    k = F.get_json_object("props", "$.k")
    for mark, value in (("{u}", F.col("user_id").cast("string")), ("{k}", k), ("{t}", F.col("event_type"))):
        filled = F.replace(filled, F.lit(mark), value)
    return table(spark, sf_dir, "events").select("event_id", shape.alias("shape"), filled.alias("sql"))


def governed_refusals(spark, sf_dir):
    """A log of texts, most of them hostile, audited text by text against the catalog."""
    log = refused_log(spark, sf_dir)
    codes = references.log_refusals(log, "event_id", "sql", _column_sizes(spark, sf_dir), sqltext.ESCAPE_HATCHES)
    return codes.select("event_id", F.pmod("event_id", F.lit(len(REFUSED))).cast("int").alias("shape"), "code")


def json_safe_scalars(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    ratio = F.when(k == 50, F.lit(float("nan"))).when(k == 51, F.lit(float("inf"))).when(k == 52, F.lit(float("-inf")))
    values = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.to_date("ts").alias("day"),
        F.col("value").cast("decimal(12,2)").alias("amount"),
        ratio.otherwise(F.col("value")).alias("ratio"),
        F.encode("event_type", "UTF-8").alias("payload"),
        (F.col("ts") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("elapsed"),
        (F.col("user_id") % 2 == 0).alias("even"),
    )
    return jsonsafe.json_safe(values)


def json_safe_nested(spark, sf_dir):
    """Nested conversions, flattened again so that both engines can show them."""
    discount = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    values = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.array(F.col("l_tax").cast("decimal(6,2)"), F.lit(None).cast("decimal(6,2)")).alias("taxes"),
        F.create_map(F.col("l_linenumber"), discount).alias("by_line"),
        F.struct(F.col("l_shipdate").alias("shipped"), F.array(F.encode("l_returnflag", "UTF-8")).alias("flags")).alias("detail"),
    )
    safe = jsonsafe.json_safe(values)
    return safe.select(
        "l_orderkey",
        F.col("taxes")[0].alias("tax"),
        F.size("taxes").alias("n_taxes"),
        F.map_keys("by_line")[0].alias("line"),
        F.map_values("by_line")[0].alias("discount"),
        F.col("detail.shipped").alias("shipped"),
        F.col("detail.flags")[0].alias("flag"),
    )


def rows_as_json(spark, sf_dir):
    """Customers as positional JSON lists, negative balances as null."""
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return jsonsafe.rows_as_json(table(spark, sf_dir, "customer").withColumn("c_acctbal", balance))


QUERIES = {
    f.__name__: f
    for f in (
        sql_unfence, sql_mask, sql_sanitize, sql_verdict, sql_audit_report, query_references, cost_verdict, scan_cost_report, format_bytes,
        governed_topk, governed_cte, governed_union_all, governed_join, governed_rollup, result_envelope, governed_refusals,
        json_safe_scalars, json_safe_nested, rows_as_json,
    )
}


# RE2 has no possessive repeats and does not need them.
_MASK = sqltext.MASKED_SPANS.replace("*+", "*").replace("'", "''")


def _unit_sql(value: str) -> str:
    steps = " ".join(
        f"WHEN abs({value}) < 1024.0 ** {p + 1} THEN printf('%.2f {u}', {value} / 1024.0 ** {p})"
        for p, u in ((1, "KB"), (2, "MB"), (3, "GB"))
    )
    return (
        f"CASE WHEN abs({value}) < 1024 THEN CAST({value} AS BIGINT) || ' B' {steps} "
        f"ELSE printf('%.2f TB', {value} / 1024.0 ** 4) END"
    )


def _plain_names(text: str) -> str:
    return text.replace(f"`{PROJECT}.{DATASET}.", "").replace("`", "")


def _sizes_sql() -> str:
    from tablesteward.workload.catalog import ORACLE as catalog

    return f"sizes AS (SELECT table_id, column_name, logical_bytes FROM ({catalog['column_logical_bytes']}))"


_COSTS = f"""{QUERY_COLUMNS_SQL}, {_sizes_sql()},
costs AS (SELECT query_id, CAST(coalesce(sum(logical_bytes), 0) AS BIGINT) AS estimated_bytes
  FROM (SELECT DISTINCT * FROM query_columns) LEFT JOIN sizes USING (table_id, column_name) GROUP BY 1)"""
_LIMIT_TEXT = "976.56 KB"
_PAGE_MASK = f"regexp_replace(body, '{_MASK}', ' ', 'g')"

ORACLE = {
    "sql_unfence": f"""WITH {QUERY_LOG_SQL} SELECT query_id, CASE shape WHEN 1 THEN inner_sql || chr(10)
  WHEN 2 THEN inner_sql ELSE sql END AS unfenced FROM query_log""",
    "sql_mask": f"""WITH {QUERY_LOG_SQL}, bodies AS (
  SELECT 'query' AS origin, query_id AS id, sql AS body FROM query_log UNION ALL SELECT 'page', page_id, html FROM pages)
SELECT origin, id, {_PAGE_MASK} AS masked FROM bodies""",
    "sql_sanitize": f"""WITH {QUERY_LOG_SQL} SELECT query_id,
  CASE WHEN verdict IN ('empty', 'multiple_statements') THEN NULL ELSE inner_sql END AS cleaned,
  CASE WHEN verdict IN ('empty', 'multiple_statements') THEN verdict END AS error_code FROM query_log""",
    "sql_verdict": f"WITH {QUERY_LOG_SQL} SELECT query_id, verdict FROM query_log",
    "sql_audit_report": f"""WITH {QUERY_LOG_SQL}, {_COSTS}
SELECT CASE WHEN verdict = 'ok' AND estimated_bytes > {COST_LIMIT} THEN 'over_budget' ELSE verdict END AS verdict,
  count(*) AS queries, count(DISTINCT sql) AS distinct_texts
FROM query_log LEFT JOIN costs USING (query_id) GROUP BY 1""",
    "query_references": f"WITH {QUERY_COLUMNS_SQL} SELECT DISTINCT query_id, table_id, column_name AS \"column\" FROM query_columns",
    "cost_verdict": f"""WITH {_COSTS} SELECT query_id, estimated_bytes,
  CASE WHEN estimated_bytes > {COST_LIMIT} THEN 'error' ELSE 'success' END AS status,
  CAST({COST_LIMIT} AS BIGINT) AS max_bytes_billed,
  CASE WHEN estimated_bytes > {COST_LIMIT} THEN 'query would scan ' || {_unit_sql('estimated_bytes')} ||
    ', above the limit of {_LIMIT_TEXT}; {scancost.ADVICE}' END AS error FROM costs""",
    "scan_cost_report": f"""WITH {_COSTS}, t AS (
  SELECT CASE WHEN estimated_bytes > {COST_LIMIT} THEN 'error' ELSE 'success' END AS status, count(*) AS queries,
    CAST(sum(estimated_bytes) AS BIGINT) AS total_bytes, max(estimated_bytes) AS largest_bytes FROM costs GROUP BY 1)
SELECT *, {_unit_sql('total_bytes')} AS total_text FROM t""",
    "format_bytes": f"""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)
  * ([{', '.join(str(1024**p // 64 + 1) for p in range(5))}])[l_orderkey % 5 + 1] AS size FROM lineitem)
SELECT *, {_unit_sql('size')} AS size_text FROM s""",
    "governed_refusals": f"""SELECT event_id, CAST(event_id % {len(REFUSED)} AS INTEGER) AS shape,
  CASE event_id % {len(REFUSED)} {" ".join(f"WHEN {i} THEN '{code}'" for i, (_, code) in enumerate(REFUSED) if code)} END AS code
FROM events""",
    "governed_topk": _plain_names(TOPK),
    "governed_cte": _plain_names(CTE),
    "governed_union_all": _plain_names(UNION),
    "governed_join": _plain_names(JOIN),
    "governed_rollup": _plain_names(ROLLUP),
    "result_envelope": f"""SELECT 'success' AS status, 'c_mktsegment,r_name,orders,spent' AS columns, count(*) AS row_count,
  true AS priced, CAST(NULL AS VARCHAR) AS error FROM ({_plain_names(JOIN)})""",
    "json_safe_scalars": """SELECT event_id,
  CASE WHEN date_part('us', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
  strftime(ts, '%Y-%m-%d') AS day, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS amount,
  CASE WHEN json_extract_string(props, '$.k') IN ('50', '51', '52') THEN NULL ELSE value END AS ratio,
  base64(encode(event_type)) AS payload,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0 AS elapsed, user_id % 2 = 0 AS even FROM events""",
    "json_safe_nested": """SELECT l_orderkey, CAST(CAST(l_tax AS DECIMAL(6,2)) AS DOUBLE) AS tax, 2 AS n_taxes,
  CAST(l_linenumber AS VARCHAR) AS line, nullif(l_discount, 0) AS discount,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS shipped, base64(encode(l_returnflag)) AS flag FROM lineitem""",
    "rows_as_json": """SELECT '[' || c_custkey || ',"' || c_name || '",' || c_nationkey || ',' ||
  CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS VARCHAR) ELSE 'null' END || ',"' || c_mktsegment || '"]' AS row FROM customer""",
}
