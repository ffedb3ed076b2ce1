"""As-of and interval joins against plain Python, with a key that holds most rows."""

import datetime as dt
import random

from tablesteward.operators import timejoins

START = dt.datetime(2024, 1, 1)


def moments(draw, count, minutes, nulls=0.03):
    rows = []
    for i in range(count):
        key = "hot" if draw.random() < 0.6 else draw.choice(["a", "b", "c", None])
        rows.append((key, None if draw.random() < nulls else START + dt.timedelta(minutes=draw.randrange(minutes)), i))
    return rows


def test_asof(spark):
    draw = random.Random(1)
    left, right = moments(draw, 700, 400), moments(draw, 300, 400)
    right = [r for r in right if r[0] != "c"]
    frames = spark.createDataFrame(left, "k string, at timestamp_ntz, id int"), spark.createDataFrame(right, "k string, seen timestamp_ntz, n int")
    want = set()
    for key, at, i in left:
        before = [(seen, n) for k, seen, n in right if k == key and seen is not None and at is not None and seen <= at]
        want.add((key, at, i, max(before)[1] if before else None))
    for segments in (1, 13, 60):
        got = timejoins.asof_join(*frames, ["k"], "at", "seen", "n", segments=segments)
        assert {(r.k, r.at, r.id, r.matched.n if r.matched else None) for r in got.collect()} == want and got.count() == len(left)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    empty = timejoins.asof_join(frames[0], frames[1].where("false"), ["k"], "at", "seen", "n")
    assert empty.where("matched IS NULL").count() == len(left)


def test_intervals_of_any_length(spark):
    draw = random.Random(2)
    spans = [(k, at, None if at is None else at + dt.timedelta(minutes=draw.choice([-5, 0, 3, 30, 4000, 400_000])), i) for k, at, i in moments(draw, 150, 5000)]
    points = moments(draw, 400, 9000)
    got = timejoins.interval_join(
        spark.createDataFrame(spans, "k string, low timestamp_ntz, high timestamp_ntz, id int"),
        spark.createDataFrame(points, "k string, at timestamp_ntz, n int"), ["k"], "low", "high", "at", width_seconds=600,
    )
    want = sorted((i, n) for k, low, high, i in spans for kk, at, n in points if k is not None and k == kk and low and at and low <= at <= high)
    assert sorted((r.span.id, r.point.n) for r in got.collect()) == want and len(want) > 1000
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
