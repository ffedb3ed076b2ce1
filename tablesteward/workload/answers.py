"""Registered queries: comparison metrics, calendar, evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesteward.functions import arithmetic, fiscal
from tablesteward.operators import compare, evaluation
from tablesteward.workload import inputs
from tablesteward.workload.governance import TOPK, _plain_names, governed_topk
from tablesteward.workload.inputs import table


def _money(column: str):
    """Exact cents, so that sums do not depend on the order of rows."""
    return F.col(column).cast("decimal(18,2)")


def percentage_change(spark, sf_dir):
    """Spending of each customer in 1998 against 1997; none in 1997 is an error."""
    year = F.year("o_orderdate")

    def spent(in_year: int):
        return F.sum(F.when(year == in_year, _money("o_totalprice")).otherwise(F.lit(0))).cast("double")

    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(spent(1997).alias("old_value"), spent(1998).alias("new_value"))
    changed = compare.percentage_change(totals, "old_value", "new_value", digits=None)
    return changed.withColumns({n: F.round(n, 6) for n in ("absolute_difference", "percentage_change")})


def proportion(spark, sf_dir):
    """Share of every customer in all spending."""
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).cast("double").alias("part"))
    total = table(spark, sf_dir, "orders").agg(F.sum(_money("o_totalprice")).cast("double")).scalar()
    shared = compare.proportion(totals, "part", total, digits=None)
    return shared.withColumn("percentage", F.round("percentage", 6))


def derive_column(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    made = arithmetic.derive(items, "net", "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) // 10", "net_status")
    made = arithmetic.derive(made, "per_tax", "l_quantity / (l_tax * 100) ** 2", "per_tax_status")
    made = arithmetic.derive(made, "score", "max([sqrt(l_quantity), log10(l_extendedprice), pi]) - min(l_tax, l_discount) + l_linenumber % 3")
    return made.select(
        "l_orderkey", "l_linenumber", "net", "net_status", F.round("per_tax", 6).alias("per_tax"), "per_tax_status",
        F.round("score", 6).alias("score"),
    )


def period_change(spark, sf_dir):
    by_year = compare.period_change(
        table(spark, sf_dir, "orders"), ["o_orderpriority"], F.year("o_orderdate"), _money("o_totalprice"), digits=None
    )
    return by_year.select(
        "o_orderpriority", "period", F.col("total").cast("double").alias("total"), "status",
        F.round("percentage_change", 6).alias("percentage_change"), "direction",
    )


def calendar_columns(spark, sf_dir):
    return fiscal.with_calendar(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


def fiscal_year_rollup(spark, sf_dir):
    dated = fiscal.with_calendar(table(spark, sf_dir, "orders"), "o_orderdate")
    return dated.groupBy("fiscal_year").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(_money("o_totalprice")).cast("double").alias("spent")
    )


def invocation_fold(spark, sf_dir):
    folded = evaluation.invocation_fold(inputs.invocation_steps(spark, sf_dir))

    def joined(calls: str, value: str):
        return F.array_join(F.transform(calls, lambda c: F.concat(c["id"], F.lit(":"), c["name"], F.lit(":"), c[value])), "\n")

    return folded.select(
        "invocation_id", "question", "final_text", joined("tool_uses", "args").alias("calls"),
        joined("tool_responses", "response").alias("responses"),
    )


def evalset_upsert(spark, sf_dir):
    """A set of all conversations, those with a system turn recorded again."""
    steps = table(spark, sf_dir, "conversations")
    case = F.concat(F.lit("case_"), F.col("conv_id").cast("string"))
    stored = steps.groupBy("conv_id").agg(F.lit("first").alias("recording")).select(
        case.alias("eval_id"), F.lit(0).alias("generation"), F.col("conv_id").alias("position"), "recording"
    )
    again = steps.where("role = 'system'").groupBy("conv_id").agg(F.lit("second").alias("recording")).select(
        case.alias("eval_id"), F.col("conv_id").alias("position"), "recording"
    )
    return evaluation.upsert_cases(stored, again)


def trajectory_score(spark, sf_dir):
    """Calls of every invocation against the same with long texts cut and some missing."""
    calls = inputs.invocation_steps(spark, sf_dir).where("call IS NOT NULL").select(
        "invocation_id", F.col("seq").alias("position"), "call.name", "call.args", F.length("text").alias("chars")
    )
    made = calls.where("chars % 7 != 0").withColumn("args", F.when(F.col("chars") > 300, F.upper("args")).otherwise(F.col("args")))
    scored = evaluation.trajectory_score(calls, made)
    return scored.withColumn("score", F.round("score", 6))


def golden_rank_check(spark, sf_dir):
    """The governed top list against one computed from sums and counts, and a spoilt copy."""
    from pyspark.sql import Window as W

    def ranked(df, name, value):
        order = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(value), name))
        return df.select(order.alias("rank"), F.col(name).alias("name"), F.col(value).alias("value"))

    month = F.col("l_shipdate").between("1998-05-01", "1998-05-31")
    by_supplier = table(spark, sf_dir, "lineitem").where(month).groupBy("l_suppkey").agg(
        F.sum("l_extendedprice").alias("spent"), F.count(F.lit(1)).alias("n")
    )
    by_nation = (
        by_supplier.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg((F.sum("spent") / F.sum("n")).alias("mean"))
    )
    top = by_nation.orderBy(F.desc("mean"), "n_name").limit(10)
    golden, answer = ranked(top, "n_name", "mean"), ranked(governed_topk(spark, sf_dir), "nation", "avg_price")
    spoilt = answer.withColumn("value", F.when(F.col("rank") == 10, F.col("value") + 1e9).otherwise(F.col("value")))
    return (
        evaluation.golden_rank_check(answer, golden).withColumn("answer", F.lit("as given"))
        .unionByName(evaluation.golden_rank_check(spoilt, golden).withColumn("answer", F.lit("last place wrong")))
    )


QUERIES = {
    f.__name__: f
    for f in (
        percentage_change, proportion, derive_column, period_change, calendar_columns, fiscal_year_rollup,
        invocation_fold, evalset_upsert, trajectory_score, golden_rank_check,
    )
}


_LOCAL = "timezone('America/Sao_Paulo', timezone('UTC', {ts}))"
_FISCAL = f"CAST(year({_LOCAL}) - CASE WHEN month({_LOCAL}) < 4 THEN 1 ELSE 0 END AS INTEGER)"
_STEPS = """steps AS (
  SELECT 'c' || conv_id AS invocation_id, conv_id, turn, role, text, 'call_' || turn AS call_id,
    CASE WHEN contains(text, chr(10)) THEN 'run_query' ELSE 'look_up' END AS name, text AS args
  FROM conversations)"""
_MONEY = "CAST(o_totalprice AS DECIMAL(18,2))"

ORACLE = {
    "percentage_change": f"""WITH t AS (SELECT o_custkey,
    CAST(sum(CASE WHEN year(o_orderdate) = 1997 THEN {_MONEY} ELSE 0 END) AS DOUBLE) AS old_value,
    CAST(sum(CASE WHEN year(o_orderdate) = 1998 THEN {_MONEY} ELSE 0 END) AS DOUBLE) AS new_value FROM orders GROUP BY 1)
SELECT *, CASE WHEN old_value = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN old_value <> 0 THEN round(new_value - old_value, 6) END AS absolute_difference,
  CASE WHEN old_value <> 0 THEN round((new_value - old_value) / old_value * 100, 6) END AS percentage_change,
  CASE WHEN old_value = 0 THEN NULL WHEN new_value > old_value THEN 'up' WHEN new_value < old_value THEN 'down' ELSE 'unchanged' END AS direction
FROM t""",
    "proportion": f"""WITH t AS (SELECT o_custkey, sum({_MONEY}) AS part FROM orders GROUP BY 1),
s AS (SELECT o_custkey, CAST(part AS DOUBLE) AS part, CAST(sum(part) OVER () AS DOUBLE) AS total FROM t)
SELECT o_custkey, part, 'success' AS status, round(part / total * 100, 6) AS percentage FROM s""",
    "derive_column": """SELECT l_orderkey, l_linenumber,
  floor(round_even(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) / 10) AS net, 'success' AS net_status,
  CASE WHEN l_tax <> 0 THEN round(l_quantity / pow(l_tax * 100, 2), 6) END AS per_tax,
  CASE WHEN l_tax = 0 THEN 'error' ELSE 'success' END AS per_tax_status,
  round(greatest(sqrt(l_quantity), log10(l_extendedprice), pi()) - least(l_tax, l_discount) + l_linenumber % 3, 6) AS score
FROM lineitem""",
    "period_change": f"""WITH t AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS period,
    CAST(sum({_MONEY}) AS DOUBLE) AS total FROM orders GROUP BY 1, 2),
p AS (SELECT *, lag(total) OVER (PARTITION BY o_orderpriority ORDER BY period) AS previous FROM t)
SELECT o_orderpriority, period, total, CASE WHEN previous IS NOT NULL THEN 'success' END AS status,
  round((total - previous) / previous * 100, 6) AS percentage_change,
  CASE WHEN total > previous THEN 'up' WHEN total < previous THEN 'down' WHEN total = previous THEN 'unchanged' END AS direction
FROM p""",
    "calendar_columns": f"""SELECT event_id, strftime({_LOCAL.format(ts='ts')}, '%Y-%m-%d %H:%M:%S') AS local_time,
  strftime({_LOCAL.format(ts='ts')}, '%d/%m/%Y') AS local_date, strftime({_LOCAL.format(ts='ts')}, '%B/%Y') AS month_label,
  {_FISCAL.format(ts='ts')} AS fiscal_year, {_FISCAL.format(ts='ts')} - 1 AS previous_fiscal_year FROM events""",
    "fiscal_year_rollup": f"""SELECT {_FISCAL.format(ts='o_orderdate')} AS fiscal_year, count(*) AS orders,
  CAST(sum({_MONEY}) AS DOUBLE) AS spent FROM orders GROUP BY 1""",
    "invocation_fold": f"""WITH {_STEPS} SELECT invocation_id,
  arg_min(text, turn) FILTER (role = 'user') AS question,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS final_text,
  coalesce(string_agg(call_id || ':' || name || ':' || args, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS calls,
  coalesce(string_agg(call_id || ':run_query:' || sha256(text), chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS responses
FROM steps GROUP BY 1""",
    "evalset_upsert": """SELECT 'case_' || conv_id AS eval_id, CAST(max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS INTEGER) AS generation,
  conv_id AS position, CASE WHEN bool_or(role = 'system') THEN 'second' ELSE 'first' END AS recording
FROM conversations GROUP BY conv_id""",
    "trajectory_score": f"""WITH {_STEPS}, c AS (SELECT invocation_id, CAST(length(text) % 7 <> 0
    AND (length(text) <= 300 OR upper(args) = args) AS INTEGER) AS hit FROM steps WHERE role = 'assistant')
SELECT invocation_id, count(*) AS calls, round(avg(hit), 6) AS score, CAST(min(hit) AS DOUBLE) AS exact FROM c GROUP BY 1""",
    "golden_rank_check": f"""WITH n AS (SELECT count(*) = 10 AS complete FROM ({_plain_names(TOPK)}))
SELECT 'as given' AS answer, complete, true AS descending, true AS first_matches, true AS last_matches, CAST(1 AS DOUBLE) AS score, true AS passed FROM n
UNION ALL SELECT 'last place wrong', complete, false, true, false, 0.5, false FROM n""",
}
