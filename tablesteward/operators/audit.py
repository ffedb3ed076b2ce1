"""Summary of a log of SQL texts by the first check each one fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteward.functions.sqltext import with_verdict
from tablesteward.operators.scancost import MAX_BYTES


def audit_report(
    query_log: DataFrame, text: str = "sql", costs: DataFrame | None = None, cost_limit: int = MAX_BYTES
) -> DataFrame:
    """``verdict, queries, distinct_texts`` over the whole log.

    Checks run in the order clean-up, read-only, cost; the last only with
    ``costs(query_id, estimated_bytes)``.
    """
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest")
    # The texts themselves stay behind: only ids and digests are shuffled.
    audited = with_verdict(query_log, text).select(*(["query_id"] if costs is not None else []), "verdict", digest)
    if costs is not None:
        dear = costs.where(F.col("estimated_bytes") > cost_limit).select("query_id", F.lit(True).alias("dear"))
        over = (F.col("verdict") == "ok") & F.col("dear").isNotNull()
        audited = audited.join(dear, "query_id", "left").select(
            F.when(over, F.lit("over_budget")).otherwise(F.col("verdict")).alias("verdict"), "digest"
        )
    # Repeats of one text are combined before the distinct count shuffles.
    texts = audited.groupBy("verdict", "digest").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("verdict").agg(F.sum("n").alias("queries"), F.count(F.lit(1)).alias("distinct_texts"))
