"""Column expressions against plain Python."""

import datetime as dt
import json
import math
import random
from decimal import Decimal
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.functions import arithmetic, fiscal, jsonsafe, statekeys, text, vectors
from tablesteward.operators.trace import paced_release
from tablesteward.session import setting


def test_byte_size_borders(evaluate):
    """One below, at and above each unit's border; the last unit grows without end."""
    steps = [1024**p + d for p in range(1, 7) for d in (-1, 0, 1)]
    units = ["B", "KB", "MB", "GB", "TB"]

    def want(n):
        power = min(4, max(p for p in range(7) if n >= 1024**p or p == 0))
        return f"{n} B" if power == 0 else f"{n / 1024**power:.2f} {units[power]}"

    assert evaluate(steps + [-n for n in steps], "bigint", text.format_bytes(F.col("x"))) == [want(n) for n in steps] + [
        "-" + want(n) for n in steps
    ]


def test_byte_sizes_round_like_python(evaluate):
    draw = random.Random(1)
    sizes = [draw.randrange(1024**4) >> draw.randrange(0, 30) for _ in range(2000)]

    def want(n):
        value, units = float(n), ["B", "KB", "MB", "GB", "TB"]
        while value >= 1024 and len(units) > 1:
            value, units = value / 1024, units[1:]
        return f"{n} B" if units[0] == "B" else f"{value:.2f} {units[0]}"

    assert evaluate(sizes, "bigint", text.format_bytes(F.col("x"))) == [want(n) for n in sizes]


def test_number_text(evaluate):
    draw = random.Random(2)
    values = [0.0, 1.0, -2.5, 1e7, 123456789.25, 1e15, 1e16, 1.5e300, 1e-4, 1e-5, 0.00123, -3.25e-7, 12345678901234.5]
    values += [round(draw.uniform(-1e9, 1e9), draw.randrange(0, 6)) for _ in range(500)]
    assert evaluate(values, "double", text.number_text(F.col("x"))) == [repr(v) for v in values]


def test_cells(spark):
    values = {
        "a": (True, "boolean", "True"), "b": (12, "int", "12"), "c": (1e8, "double", "100000000.0"),
        "d": (float("nan"), "double", "None"), "e": (None, "string", "NULL"), "f": (" x|y\nz ", "string", "x\\|y z"),
        "g": ("é" * 61, "string", "é" * 60 + "…"), "h": (b"ab", "binary", "YWI="), "i": (Decimal("2.50"), "decimal(6,2)", "2.5"),
        "j": (dt.datetime(2026, 5, 1, 7, 0, 0, 1200), "timestamp_ntz", "2026-05-01T07:00:00.001200"),
        "k": (dt.datetime(2026, 5, 1, 7), "timestamp_ntz", "2026-05-01T07:00:00"), "l": (dt.date(2026, 5, 31), "date", "2026-05-31"),
        "m": (dt.datetime(2026, 5, 1, 7, tzinfo=dt.timezone.utc), "timestamp", "2026-05-01T07:00:00+00:00"),
        "n": (dt.timedelta(minutes=2), "interval day to second", "120.0"),
    }
    df = spark.createDataFrame([tuple(v for v, _, _ in values.values())], ", ".join(f"{n} {k}" for n, (_, k, _) in values.items()))
    from tablesteward.operators.profile import field_type

    raw = df.selectExpr(*[f"{text.raw_text_sql(f.name, f.dataType)} AS {f.name}" for f in df.schema.fields])
    shown = [text.format_cell(text.shown_text(F.col(f.name), F.lit(field_type(f)[0]))).alias(f.name) for f in df.schema.fields]
    assert raw.select(*shown).first().asDict() == {n: want for n, (_, _, want) in values.items()}


def test_marked_truncation(evaluate):
    texts = ["  short ", "a" * 12, "abcdefgh  jklm ", "", "é" * 11]

    def want(t):
        t = t.strip()
        return t if len(t) <= 10 else f"{t[:10].rstrip()}… (+{len(t) - 10} chars)"

    assert evaluate(texts, "string", text.truncate_marked(F.col("x"), 10)) == [want(t) for t in texts]


def test_message_texts(evaluate):
    parts = [["a", "", None, "b"], [], ["", None], [" x " * 40], None]
    assert evaluate(parts, "array<string>", text.question_text(F.col("x"))) == ["a\nb", "", "", (" x " * 40).strip(), ""]
    assert evaluate(parts, "array<string>", text.message_preview(F.col("x"))) == ["a b", None, None, (" x " * 40)[:80] + "…", None]


def test_content_and_arguments(spark):
    kind = "array<struct<text:string,call:string,response:string,code:string>>"
    parts = [("hi there", None, None, None), ("", "f", None, None), (None, None, "g", None), (None, None, None, "1"), (None,) * 4]
    df = spark.createDataFrame([(parts, {"q": "SELECT 1\nFROM t", "n": "3"}), ([], {})], f"p {kind}, a map<string,string>")
    rows = df.select(text.content_summary(F.col("p")).alias("p"), text.kv_render(F.col("a")).alias("a")).collect()
    assert rows[0]["p"] == "text: 'hi there'\nfunction_call: f\nfunction_response: g\ncode_execution_result\nother_part"
    assert rows[0]["a"] == "q:\n  SELECT 1\n  FROM t\nn: 3"
    assert (rows[1]["p"], rows[1]["a"]) == ("None", "{}")


def test_json_safe_values(spark):
    schema = (
        "flag boolean, n bigint, x double, d decimal(8,2), day date, at timestamp_ntz, z timestamp, gap interval day to second, raw binary, "
        "m map<int,double>, xs array<decimal(4,1)>, s struct<a:double,b:array<date>>, plain array<string>"
    )
    moment = dt.datetime(1998, 12, 31, 23, 59, 59, 70)
    full = (
        False, -40, 6.125, Decimal("-71.05"), dt.date(1995, 2, 28), moment, dt.datetime(2001, 8, 9, 10, 11, tzinfo=dt.timezone.utc),
        dt.timedelta(hours=3, seconds=7, microseconds=250_000), bytes(range(5)), {9: float("-inf"), 8: -2.75}, [None, Decimal("30.9")],
        (float("nan"), [dt.date(1999, 9, 9), None]), ["", "two words"],
    )
    df = spark.createDataFrame([full, (None,) * 13], schema)
    first, empty = (r.asDict(recursive=True) for r in jsonsafe.json_safe(df).collect())
    assert first == {
        "flag": False, "n": -40, "x": 6.125, "d": -71.05, "day": "1995-02-28", "at": "1998-12-31T23:59:59.000070", "z": "2001-08-09T10:11:00+00:00",
        "gap": 10807.25, "raw": "AAECAwQ=", "m": {"9": None, "8": -2.75}, "xs": [None, 30.9], "s": {"a": None, "b": ["1999-09-09", None]},
        "plain": ["", "two words"],
    }
    assert set(empty.values()) == {None}
    listed = [json.loads(r["row"]) for r in jsonsafe.rows_as_json(df).collect()]
    assert listed == [list(first.values()), [None] * 13]


def test_json_safe_floats(evaluate):
    draw = random.Random(6)
    values = [draw.uniform(-1, 1) * 10.0 ** draw.randrange(-300, 300) for _ in range(200)] + [math.nan, math.inf, -math.inf, -0.0]
    safe = evaluate(values, "double", jsonsafe.json_safe_value(F.col("x"), T.DoubleType()))
    assert safe == [v if math.isfinite(v) else None for v in values]


def test_change_and_share(spark):
    df = spark.createDataFrame([(200.0, 250.0), (200.0, 150.0), (5.0, 5.0), (0.0, 9.0), (None, 9.0)], "a double, b double")
    change = [tuple(r) for r in df.select(*[c.alias(n) for n, c in arithmetic.change_columns(F.col("a"), F.col("b")).items()]).collect()]
    assert change == [
        ("success", 50.0, 25.0, "up"), ("success", -50.0, -25.0, "down"), ("success", 0.0, 0.0, "unchanged"),
        ("error", None, None, None), (None, None, None, None),
    ]
    share = [tuple(r) for r in df.select(*[c.alias(n) for n, c in arithmetic.share_columns(F.col("b"), F.col("a")).items()]).collect()]
    assert share == [("success", 125.0), ("success", 75.0), ("success", 100.0), ("error", None), (None, None)]


# Each expression next to the same as a plain Python function.
DERIVED = {
    "x * (1 - y / 8)": lambda x, y: x * (1 - y / 8),
    "(y - x) / y": lambda x, y: (y - x) / y,
    "x // y + x % y": lambda x, y: x // y + x % y,
    "-y ** 2 + +x": lambda x, y: -(y**2) + x,
    "pow(y, 3) - sqrt(abs(x))": lambda x, y: y**3 - math.sqrt(abs(x)),
    "sum([x, y, y, 0.5]) / len([x, y])": lambda x, y: (x + y + y + 0.5) / 2,
    "max(x, y, 1) - min([x, y])": lambda x, y: max(x, y, 1) - min(x, y),
    "floor(x / 3) * ceil(y / 3)": lambda x, y: math.floor(x / 3) * math.ceil(y / 3),
    "log(abs(x) + 3) + log(abs(y) + 3, 4)": lambda x, y: math.log(abs(x) + 3) + math.log(abs(y) + 3, 4),
    "log10(abs(y) + 2) / e - pi": lambda x, y: math.log10(abs(y) + 2) / math.e - math.pi,
    "round(x / 7, 2) + round(y)": lambda x, y: round(x / 7, 2) + round(y),
}


@pytest.mark.parametrize("expression", list(DERIVED))
def test_derived_columns(spark, expression):
    rows = [(11.0, 3.0), (-11.0, 3.0), (11.0, -3.0), (6.25, 0.75), (1.5, 0.125), (0.0, 5.0), (5.0, 0.0)]
    out = arithmetic.derive(spark.createDataFrame(rows, "x double, y double"), "out", expression, "status").collect()
    for row in out:
        try:
            want = float(DERIVED[expression](row["x"], row["y"]))
        except ZeroDivisionError:
            assert (row["out"], row["status"]) == (None, "error")
            continue
        assert row["out"] == pytest.approx(want, rel=1e-12) and row["status"] == "success"


def test_derive_errors(spark):
    df = spark.createDataFrame([(0.0, -1.0), (None, 1.0)], "a double, b double")
    for bad in ("open('x')", "a.real", "__import__('os')", "c + 1", "a if b else 1", "True", "'text'"):
        with pytest.raises((ValueError, SyntaxError)):
            arithmetic.derive(df, "y", bad)
    rows = arithmetic.derive(df, "y", "sqrt(b) + log(b) + 1 / a", "status").collect()
    assert [(r["y"], r["status"]) for r in rows] == [(None, "error"), (None, None)]


def test_calendar(spark):
    moments = [dt.datetime(2026, 4, 1, 2), dt.datetime(2026, 4, 1, 3), dt.datetime(2025, 12, 31, 23, 59), dt.datetime(2018, 2, 17, 12)]
    df = spark.createDataFrame([(m,) for m in moments], "at timestamp_ntz")
    zoned = df.select(F.col("at").cast("timestamp").alias("at"))
    for frame in (df, zoned):
        for row, moment in zip(fiscal.with_calendar(frame, "at").collect(), moments):
            local = moment.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(fiscal.ZONE))
            year = local.year if local.month >= 4 else local.year - 1
            assert list(row)[1:] == [
                local.strftime("%Y-%m-%d %H:%M:%S"), local.strftime("%d/%m/%Y"), local.strftime("%B/%Y"), year, year - 1,
            ]


def test_no_session_zone_takes_part(spark):
    """Midnights that a zone skipped (its clocks went forward) stay as they are."""
    moment = dt.datetime(2018, 11, 4, 0, 30)
    df = spark.createDataFrame([(moment,)], "at timestamp_ntz")
    with setting(spark, "spark.sql.session.timeZone", "America/Sao_Paulo"):
        assert jsonsafe.json_safe(df).first()[0] == "2018-11-04T00:30:00"
        row = fiscal.with_calendar(df, "at", "UTC").first()
        assert list(row)[1:4] == ["2018-11-04 00:30:00", "04/11/2018", "November/2018"]
        calls = df.selectExpr("1 AS caller", "1 AS call_id", "at").union(df.selectExpr("1", "2", "at + INTERVAL '1' MINUTE"))
        released = paced_release(calls, "caller", "at", "call_id", 90.0).orderBy("call_id").collect()
    start = int(moment.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert [r["release_micros"] - start for r in released] == [0, 90_000_000]


def test_state_keys(evaluate):
    keys = ["plain", "__meta__", "____", "_____", "_Z_x_Z_", "_Z__Z_", "__x", "x__"]
    encoded = evaluate(keys, "string", statekeys.encode_key(F.col("x")))
    assert encoded == ["plain", "_Z_meta_Z_", "____", "_Z___Z_", "_Z_x_Z_", "_Z__Z_", "__x", "x__"]
    decoded = evaluate(encoded, "string", statekeys.decode_key(F.col("x")))
    # A key that looks escaped already does not come back as it was.
    assert decoded == ["plain", "__meta__", "____", "_____", "__x__", "_Z__Z_", "__x", "x__"]


def test_normalised_vectors(evaluate):
    got = evaluate([[3.0, 4.0], [0.0, 0.0], [0.6, 0.8]], "array<float>", vectors.l2_normalize(F.col("x")))
    assert np.allclose(got, [[0.6, 0.8], [0.0, 0.0], [0.6, 0.8]])
    again = evaluate(got, "array<double>", vectors.l2_normalize(F.col("x")))
    assert np.allclose(got, again)
    assert evaluate([None, [], [1.0], [1.0, 2.0]], "array<double>", vectors.vector_status(F.col("x"), 2)) == [
        "missing", "missing", "wrong_size", "ok",
    ]


def test_embedding(spark):
    df = spark.createDataFrame([(0, "Sales sales of a shop"), (1, None), (2, "é ü")], "i int, body string").repartition(2)
    rows = vectors.embed_column(df, "body", "v", vectors.hashed_term_embedder(16), dimensions=16).orderBy("i").collect()
    assert np.isclose(np.linalg.norm(rows[0]["v"]), 1.0) and rows[1]["v"] is None and sum(rows[2]["v"]) == 0.0
    with pytest.raises(Exception, match="expected"):
        vectors.embed_column(df, "body", "v", vectors.hashed_term_embedder(8), dimensions=16).collect()


def test_embed_input(evaluate):
    got = evaluate(["abc", "x" * 40_000], "string", vectors.embed_input(F.col("x"), "go: "))
    assert got[0] == "go: abc" and len(got[1]) == 30_768
