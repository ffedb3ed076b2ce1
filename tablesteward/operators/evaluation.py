"""Recorded invocations, evaluation sets, and checks against golden answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def _in_order(value: str, kept: Column | None = None) -> Column:
    """The non-null values of a group by step number."""
    source = F.col(value) if kept is None else F.when(kept, F.col(value))
    pairs = F.collect_list(F.when(source.isNotNull(), F.struct(F.col("seq"), source.alias("item"))))
    return F.transform(F.sort_array(pairs), lambda s: s["item"])


def invocation_fold(steps: DataFrame) -> DataFrame:
    """One record per invocation of ``steps(invocation_id, seq, author, text, call, response, final)``.

    ``final_text`` joins the final texts without separator.
    """
    asked = F.when(F.col("author") == "user", F.col("text"))
    return steps.groupBy("invocation_id").agg(
        F.min_by(asked, F.when(asked.isNotNull(), F.col("seq"))).alias("question"),
        F.array_join(_in_order("text", F.col("final")), "").alias("final_text"),
        _in_order("call").alias("tool_uses"),
        _in_order("response").alias("tool_responses"),
    )


def upsert_cases(cases: DataFrame, recorded: DataFrame) -> DataFrame:
    """``cases`` with those of ``recorded`` replaced or added, new ones last.

    Order is ``generation`` then ``position``; the recorded cases get the next
    generation, so no row needs a number of its own across tasks.
    """
    kept = cases.join(recorded.select("eval_id"), "eval_id", "left_anti")
    following = F.coalesce(cases.agg(F.max("generation")).scalar(), F.lit(0)) + 1
    return kept.unionByName(recorded.withColumn("generation", following.cast("int")), allowMissingColumns=True)


def trajectory_score(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Share of calls per invocation equal by position, name and arguments.

    Missing and surplus calls count as wrong; ``exact`` is 1.0 for a full match.
    """
    pair = expected.select("invocation_id", "position", F.struct("name", "args").alias("wanted")).join(
        actual.select("invocation_id", "position", F.struct("name", "args").alias("made")),
        ["invocation_id", "position"],
        "full_outer",
    )
    hit = F.coalesce(F.col("wanted") == F.col("made"), F.lit(False)).cast("int")
    return pair.groupBy("invocation_id").agg(
        F.count(F.lit(1)).alias("calls"), F.avg(hit).alias("score"), F.min(hit).cast("double").alias("exact")
    )


def golden_rank_check(ranking: DataFrame, golden: DataFrame, size: int = 10, tolerance: float = 0.01) -> DataFrame:
    """One row of checks of a ranking ``rank, name, value`` against a golden one.

    Both are top lists of ``size`` rows: complete, descending, and first and
    last place equal by name and, within ``tolerance``, by value.
    """
    falling = F.coalesce(F.lag("value").over(W.partitionBy(F.lit(1)).orderBy("rank")) >= F.col("value"), F.lit(True))
    top = ranking.where(F.col("rank") <= size).withColumn("falling", falling)
    wanted = golden.where(F.col("rank") <= size).select(
        "rank", F.col("name").alias("golden_name"), F.col("value").alias("golden_value")
    )
    close = F.abs(F.col("value") - F.col("golden_value")) <= tolerance
    same = F.coalesce((F.col("name") == F.col("golden_name")) & close, F.lit(False))
    checks = top.join(wanted, "rank", "full_outer").agg(
        (F.count("name") == size).alias("complete"),
        F.coalesce(F.bool_and("falling"), F.lit(False)).alias("descending"),
        F.coalesce(F.bool_or(same & (F.col("rank") == 1)), F.lit(False)).alias("first_matches"),
        F.coalesce(F.bool_or(same & (F.col("rank") == size)), F.lit(False)).alias("last_matches"),
    )
    names = ["complete", "descending", "first_matches", "last_matches"]
    passed = sum((F.col(n).cast("double") for n in names[1:]), F.col(names[0]).cast("double")) / len(names)
    return checks.withColumn("score", passed).withColumn("passed", F.col("score") >= 1.0)
