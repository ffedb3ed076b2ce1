"""Requests to embedders that are slow, fail for a while, or fail for some texts."""

import threading
import time

import numpy as np
import pytest

from tablesteward.operators import embedding


def test_window_and_order():
    begun, most, under_way, lock = [], [0], [0], threading.Lock()

    def call(n):
        with lock:
            begun.append(n)
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        time.sleep(0.02 if n % 5 else 0.08)
        with lock:
            under_way[0] -= 1
        return n

    results = embedding.in_order(((lambda n=n: call(n)) for n in range(40)), 8)
    assert next(results) == 0
    assert len(begun) <= 9  # nothing runs far ahead of what was taken
    assert list(results) == list(range(1, 40)) and 1 < most[0] <= 8


def test_retries_and_bad_texts():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise TimeoutError("busy")
        if "bad" in texts:
            raise ValueError("bad text")
        return [[3.0, 4.0]] * len(texts)

    assert embedding.requested(embed, ["a", "b"], 2, 3, 0.0) == [([0.6, 0.8], None)] * 2 and calls == [2, 2, 2]
    found = embedding.requested(embed, ["a", "bad", "c", "d", "e"], 2, 2, 0.0)
    assert [e for _, e in found] == [None, "ValueError: bad text", None, None, None]
    assert all(v == [0.6, 0.8] for v, e in found if e is None)
    assert embedding.requested(lambda texts: [[1.0]] * 3, ["a"], 1, 2, 0.0)[0][1].startswith("ValueError: embedder returned (3, 1)")
    assert embedding.requested(embed, [], 2, 1, 0.0) == []


@pytest.mark.parametrize("texts", [1, 7, 1000])
def test_rows_keep_order_and_number(spark, texts):
    def embed(inputs):
        time.sleep(0.001 * (hash(inputs[0]) % 5))
        if any("fail" in t for t in inputs):
            raise ConnectionError("no")
        return np.array([[float(len(t)), 0.0] for t in inputs])

    rows = [(i, None if i % 11 == 0 else f"{'fail' if i % 13 == 0 else 'text'} {i}", "old", "mine") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, body string, vector string, __asked string").coalesce(1)
    made = embedding.embed_with_requests(df, "body", "vector", embed, "in: ", 2, texts=texts, tries=1)
    assert made.columns == ["id", "body", "__asked", "vector", "embed_error"]
    got = made.collect()
    assert [r.id for r in got] == list(range(200)) and {r["__asked"] for r in got} == {"mine"}
    for r in got:
        if r.body is None:
            assert (r.vector, r.embed_error) == (None, None)
        elif "fail" in r.body:
            assert (r.vector, r.embed_error) == (None, "ConnectionError: no")
        else:
            assert (r.vector, r.embed_error) == ([1.0, 0.0], None)
    assert embedding.embed_with_requests(df.where("false"), "body", "v", embed, dimensions=2).count() == 0
