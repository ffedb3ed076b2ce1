"""JSON layout against Python's own."""

import json
import random

from pyspark.sql import functions as F

from tablesteward.functions import jsontext, text


def made(draw, depth=0):
    kind = draw.randrange(8 if depth < 4 else 5)
    if kind == 0:
        return draw.choice([None, True, False, 0, -3, 1.5, 1e300, 12345678901234567890])
    if kind < 5:
        return "".join(draw.choice(['a', '"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "é", "😀", "\\u0041", "//"]) for _ in range(draw.randrange(9)))
    if kind < 6:
        return [made(draw, depth + 1) for _ in range(draw.randrange(5))]
    return {str(made(draw, 9)): made(draw, depth + 1) for _ in range(draw.randrange(5))}


def test_as_python_lays_out(spark):
    draw = random.Random(11)
    values = [made(draw) for _ in range(600)] + [{}, [], [[]], [{}], {"a": {}}, "", list(range(2000)), [[[[1]] * 40] * 10] * 3]
    compact = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values]
    rows = spark.createDataFrame(list(enumerate(compact)), "i int, v string")
    got = rows.select("i", jsontext.json_line(F.col("v")), jsontext.json_lines(F.col("v")), jsontext.json_value_text(F.col("v"))).orderBy("i").collect()
    for value, (_, line, lines, shown) in zip(values, got, strict=True):
        one = json.dumps(value, ensure_ascii=False)
        many = json.dumps(value, ensure_ascii=False, indent=2)
        assert (line, lines, shown) == (one, many, many if len(one) > 80 else one)
    assert spark.range(1).select(jsontext.json_value_text(F.lit(None).cast("string"))).first()[0] is None


def test_in_key_value_text(spark):
    value = {"sql": "SELECT 1", "rows": list(range(40))}
    entries = F.create_map(F.lit("result"), jsontext.json_value_text(F.lit(json.dumps(value))), F.lit("n"), F.lit("3"))
    shown = spark.range(1).select(text.kv_render(entries)).first()[0]
    lines = json.dumps(value, indent=2).split("\n")
    assert shown == "result:\n  " + "\n  ".join(lines) + "\nn: 3"


def test_entries_are_computed_once(spark):
    from pyspark.sql import functions as F

    from tablesteward.functions.text import kv_render

    rows = spark.createDataFrame([("a\nb",), (None,)], "x string")
    shown = rows.select(kv_render(F.create_map(F.lit("k"), F.reverse("x"))).alias("r"))
    assert [r["r"] for r in shown.collect()][0] == "k:\n  b\n  a"
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
