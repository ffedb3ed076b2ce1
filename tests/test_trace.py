"""Call spacing over segments against a plain loop, and trace rows."""

import datetime as dt
import random

import pytest

from tablesteward.operators import trace
from tablesteward.operators.segments import SEGMENT, ordered_segments

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def calls():
    """1,200 calls, many at the same moment; one caller makes half of them."""
    draw = random.Random(6)
    return [
        (n, 0 if n % 2 else draw.randrange(1, 30), START + dt.timedelta(milliseconds=100 * draw.randrange(4000))) for n in range(1200)
    ]


def frame(spark, calls):
    return spark.createDataFrame(calls, "call_id bigint, caller bigint, ts timestamp_ntz")


def micros(moment):
    return (moment - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def by_caller(calls):
    ordered = {}
    for call_id, caller, ts in sorted(calls, key=lambda c: (c[2], c[0])):
        ordered.setdefault(caller, []).append((call_id, micros(ts)))
    return ordered


def test_hot_caller_is_split(spark, calls):
    rows = ordered_segments(frame(spark, calls), ["caller"], ["ts", "call_id"], 8)
    sizes = [r["count"] for r in rows.groupBy(SEGMENT).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 400 and sum(sizes) == 1200
    assert rows.where("caller = 0").select(SEGMENT).distinct().count() >= 3


@pytest.mark.parametrize("interval", [0.5, 2.0])
def test_paced_release(spark, calls, interval):
    want, step = {}, int(interval * 1e6)
    for listed in by_caller(calls).values():
        free = None
        for call_id, at in listed:
            release = at if free is None else max(at, free)
            want[call_id], free = (release, release - at), release + step
    rows = trace.paced_release(frame(spark, calls), "caller", "ts", "call_id", interval).collect()
    assert {r["call_id"]: (r["release_micros"], r["wait_micros"]) for r in rows} == want


def test_call_gaps(spark, calls):
    want = {}
    for listed in by_caller(calls).values():
        for (_, before), (call_id, at) in zip(listed, listed[1:]):
            if at - before < 1_000_000:
                want[call_id] = (at - before, 1_000_000 - at + before)
    rows = trace.call_gaps(frame(spark, calls), "caller", "ts", "call_id").collect()
    assert {r["call_id"]: (r["gap_micros"], r["wait_micros"]) for r in rows} == want


def test_trace_rows(spark):
    schema = "ts timestamp_ntz, kind string, agent string, fields map<string,string>, partial boolean"
    rows = [
        (START, "llm_response", "a", {"tokens_in": "5", "tokens_out": "2", "branch": "", "x": None}, False),
        (START, "llm_response", "a", {"tokens_in": "7"}, True), (START, "tool_error", "a", {"error": "E: no"}, True),
    ]
    records = spark.createDataFrame(rows, schema)
    kept = trace.trace_rows(records)
    assert [r["fields"] for r in kept.collect()] == [{"tokens_in": "5", "tokens_out": "2"}, {"error": "E: no"}]
    assert trace.trace_rows(records, keep_partial=True).count() == 3
    assert {tuple(r) for r in trace.trace_rollup(kept).collect()} == {("a", "llm_response", 1, 0, 5, 2, 2), ("a", "tool_error", 1, 1, 0, 0, 1)}
