"""Evaluation sets in their JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTENT = "struct<parts: array<struct<text: string>>, role: string>"
# Arguments and responses stay JSON text: their fields differ from call to call.
_CASE = f"""struct<
  eval_id: string,
  conversation: array<struct<
    invocation_id: string, user_content: {_CONTENT}, final_response: {_CONTENT},
    intermediate_data: struct<
      tool_uses: array<struct<id: string, name: string, args: string>>,
      tool_responses: array<struct<id: string, name: string, response: string>>>,
    creation_timestamp: double>>,
  session_input: struct<app_name: string, user_id: string>,
  creation_timestamp: double>"""
# ``generation`` and ``position`` are there only in sets written here.
SET_SCHEMA = (
    f"eval_set_id string, name string, description string, eval_cases array<{_CASE}>, generation int, position int"
)

# Columns of a set or case that every row of the case repeats.
CASE_FACTS = ("user_id", "set_name", "set_description", "case_timestamp")


def _text(content: str):
    return F.array_join(F.transform(F.col(content)["parts"], lambda part: part["text"]), "")


def read_evalset(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per invocation of every case of the set files under ``path``.

    A case without invocations is one row whose ``turn`` is null.

    A file is one JSON document, or with ``lines`` a case per line as written
    by ``write_evalset``, which many tasks can read.
    """
    sets = spark.read.schema(SET_SCHEMA).option("multiLine", not lines).json(path)
    cases = sets.select("eval_set_id", "name", "description", "generation", "position", F.posexplode("eval_cases").alias("place", "case"))
    turns = cases.select(
        "eval_set_id",
        F.col("case.eval_id").alias("eval_id"),
        F.coalesce("generation", F.lit(0)).alias("generation"),
        F.coalesce("position", "place").alias("position"),
        F.col("case.session_input.app_name").alias("app_name"),
        F.col("case.session_input.user_id").alias("user_id"),
        F.col("name").alias("set_name"),
        F.col("description").alias("set_description"),
        F.col("case.creation_timestamp").alias("case_timestamp"),
        F.posexplode_outer("case.conversation").alias("turn", "invocation"),
    )
    return turns.select(
        "eval_set_id",
        "eval_id",
        "generation",
        "position",
        "turn",
        "app_name",
        "user_id",
        "set_name",
        "set_description",
        "case_timestamp",
        F.col("invocation.invocation_id").alias("invocation_id"),
        _text("invocation.user_content").alias("question"),
        _text("invocation.final_response").alias("final_text"),
        F.col("invocation.intermediate_data.tool_uses").alias("tool_uses"),
        F.col("invocation.intermediate_data.tool_responses").alias("tool_responses"),
        F.col("invocation.creation_timestamp").alias("creation_timestamp"),
    )


def write_evalset(cases: DataFrame, path: str) -> None:
    """Write the rows of ``read_evalset`` as a new folder with a case per line.

    An existing folder is an error, so a set that is read, changed and written
    is never lost half way.
    """

    def content(text: str, role: str):
        return F.struct(F.array(F.struct(F.col(text).alias("text"))).alias("parts"), F.lit(role).alias("role"))

    invocation = F.struct(
        "turn",
        "invocation_id",
        content("question", "user").alias("user_content"),
        content("final_text", "model").alias("final_response"),
        F.struct("tool_uses", "tool_responses").alias("intermediate_data"),
        "creation_timestamp",
    )
    of_case = ["eval_set_id", "eval_id", "generation", "position", "app_name", *CASE_FACTS]
    grouped = cases.groupBy(*of_case).agg(
        F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), invocation))).alias("turns")
    )
    conversation = F.transform(
        "turns",
        lambda t: F.struct(
            t["invocation_id"].alias("invocation_id"),
            t["user_content"].alias("user_content"),
            t["final_response"].alias("final_response"),
            t["intermediate_data"].alias("intermediate_data"),
            t["creation_timestamp"].alias("creation_timestamp"),
        ),
    )
    case = F.struct(
        "eval_id",
        conversation.alias("conversation"),
        F.struct("app_name", "user_id").alias("session_input"),
        F.col("case_timestamp").alias("creation_timestamp"),
    )
    lines = grouped.orderBy("generation", "position").select(
        "eval_set_id", F.col("set_name").alias("name"), F.col("set_description").alias("description"),
        F.array(case).alias("eval_cases"), "generation", "position",
    )
    lines.write.json(path)
