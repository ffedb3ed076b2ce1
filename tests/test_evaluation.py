"""Invocations, evaluation sets and golden rankings."""

import json

from pyspark.sql import functions as F

from tablesteward.operators import compare, evaluation
from tablesteward.sources.evalset import read_evalset, write_evalset

STEPS = (
    "invocation_id string, seq bigint, author string, text string, call struct<id:string,name:string,args:string>, "
    "response struct<id:string,name:string,response:string>, final boolean"
)


def test_invocation_fold(spark):
    rows = [
        ("i", 3, "model", "the ", None, None, True), ("i", 0, "user", "how many?", None, None, False), ("i", 1, "model", None, ("c1", "ask", "{}"), None, False),
        ("i", 2, "tool", None, None, ("c1", "ask", "7"), False), ("i", 4, "model", "answer", None, None, True), ("j", 0, "model", None, None, None, True),
    ]
    found = {r["invocation_id"]: r for r in evaluation.invocation_fold(spark.createDataFrame(rows, STEPS)).collect()}
    record = found["i"].asDict(recursive=True)
    assert record == {
        "invocation_id": "i", "question": "how many?", "final_text": "the answer",
        "tool_uses": [{"id": "c1", "name": "ask", "args": "{}"}], "tool_responses": [{"id": "c1", "name": "ask", "response": "7"}],
    }
    assert (found["j"]["question"], found["j"]["final_text"], found["j"]["tool_uses"]) == (None, "", [])


def test_long_invocation_is_one_record(spark):
    rows = spark.range(2500).selectExpr(
        "'i' AS invocation_id", "id AS seq", "'model' AS author", "CAST(id AS STRING) AS text",
        "CAST(NULL AS STRUCT<id:STRING,name:STRING,args:STRING>) AS call", "CAST(NULL AS STRUCT<id:STRING,name:STRING,response:STRING>) AS response", "true AS final",
    )
    records = evaluation.invocation_fold(rows).collect()
    assert [r["final_text"] for r in records] == ["".join(str(i) for i in range(2500))]


def test_case_upsert(spark):
    schema = "eval_id string, generation int, position int, note string"
    cases = spark.createDataFrame([("a", 0, 0, "old"), ("b", 0, 1, "old"), ("c", 0, 2, "old")], schema)
    fresh = spark.createDataFrame([("b", 0, "new"), ("d", 1, "new")], "eval_id string, position int, note string")
    ordered = evaluation.upsert_cases(cases, fresh).orderBy("generation", "position").collect()
    assert [(r["eval_id"], r["note"]) for r in ordered] == [("a", "old"), ("c", "old"), ("b", "new"), ("d", "new")]
    assert evaluation.upsert_cases(cases.limit(0), fresh).count() == 2


def test_trajectory(spark):
    schema = "invocation_id string, position int, name string, args string"
    wanted = spark.createDataFrame([("i", 0, "f", "1"), ("i", 1, "f", "2"), ("j", 0, "f", "1"), ("k", 0, "f", "1")], schema)
    made = spark.createDataFrame([("i", 0, "f", "1"), ("i", 1, "g", "2"), ("j", 0, "f", "1"), ("l", 0, "f", "1")], schema)
    scores = {r["invocation_id"]: (r["calls"], r["score"], r["exact"]) for r in evaluation.trajectory_score(wanted, made).collect()}
    assert scores == {"i": (2, 0.5, 0.0), "j": (1, 1.0, 1.0), "k": (1, 0.0, 0.0), "l": (1, 0.0, 0.0)}


def test_golden_ranking(spark):
    def ranking(values, names="abcdefghij"):
        return spark.createDataFrame([(i + 1, n, float(v)) for i, (n, v) in enumerate(zip(names, values))], "rank int, name string, value double")

    golden = ranking(range(20, 10, -1))

    def check(answer):
        return list(evaluation.golden_rank_check(answer, golden).first())

    assert check(golden) == [True, True, True, True, 1.0, True]
    assert check(ranking([20.005, *range(19, 10, -1)]))[-1] is True
    assert check(ranking(range(20, 11, -1)))[:4] == [False, True, True, False]
    assert check(ranking([20, 21, *range(18, 10, -1)]))[:4] == [True, False, True, True]
    assert check(ranking(range(20, 10, -1), "xbcdefghij"))[2] is False
    assert check(golden.limit(0))[-1] is False


def test_evalset_file(spark, tmp_path):
    text = "How many orders did each nation place last week?"
    case = {
        "eval_id": "s1", "session_input": {"app_name": "app", "user_id": "someone", "state": {}},
        "conversation": [
            {
                "invocation_id": f"e-{n}", "creation_timestamp": 1.5,
                "user_content": {"parts": [{"text": text}], "role": "user"}, "final_response": {"parts": [{"text": "A, "}, {"text": "B"}], "role": "model"},
                "intermediate_data": {
                    "tool_uses": [{"id": "c", "name": "ask", "args": {"request": text}}],
                    "tool_responses": [{"id": "c", "name": "ask", "response": {"result": [1, 2]}}],
                },
            } for n in range(2)
        ],
    }
    (tmp_path / "set.json").write_text(json.dumps(
        {
            "eval_set_id": "set", "name": "A set", "description": "of two sites",
            "eval_cases": [case, case | {"eval_id": "s2"}, case | {"eval_id": "s3", "conversation": [], "creation_timestamp": 2.5}],
        }, indent=2,
    ))
    rows = read_evalset(spark, str(tmp_path / "set.json"))
    found = rows.orderBy("position", "turn").collect()
    assert [(r["eval_id"], r["position"], r["turn"]) for r in found] == [("s1", 0, 0), ("s1", 0, 1), ("s2", 1, 0), ("s2", 1, 1), ("s3", 2, None)]
    assert (found[0]["question"], found[0]["final_text"]) == (text, "A, B")
    assert json.loads(found[0]["tool_uses"][0]["args"]) == {"request": text}
    write_evalset(rows, str(tmp_path / "written"))
    again = read_evalset(spark, str(tmp_path / "written"), lines=True)
    assert again.orderBy("position", "turn").collect() == found
    last = found[-1]
    assert (last["user_id"], last["set_name"], last["set_description"], last["case_timestamp"]) == ("someone", "A set", "of two sites", 2.5)
    changed = evaluation.upsert_cases(again, rows.where("eval_id = 's2'"))
    write_evalset(changed, str(tmp_path / "changed"))
    assert read_evalset(spark, str(tmp_path / "changed"), lines=True).select("eval_id").distinct().count() == 3


def test_period_change_and_share(spark):
    rows = [("x", 2024, 10), ("x", 2025, 15), ("x", 2026, 15), ("y", 2025, 0), ("y", 2026, 4)]
    df = spark.createDataFrame(rows, "shop string, year int, sold int")
    changed = compare.period_change(df, ["shop"], F.col("year"), F.col("sold")).orderBy("shop", "period").collect()
    assert [(r["status"], r["percentage_change"], r["direction"]) for r in changed] == [
        (None, None, None), ("success", 50.0, "up"), ("success", 0.0, "unchanged"), (None, None, None), ("error", None, None),
    ]
    shares = compare.proportion(df.where("year = 2026"), "sold").orderBy("shop").collect()
    assert [r["percentage"] for r in shares] == [78.95, 21.05]
