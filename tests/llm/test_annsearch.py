"""Nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tablesteward.llm import annsearch
from tablesteward.llm.batches import table


def plain_nearest(ids, vectors, k):
    out = {}
    for at in range(0, len(ids)):
        if ids[at] % 20 == 0:
            scores = vectors @ vectors[at]
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[at]]
            out[int(ids[at])] = [(int(ids[j]), float(scores[j])) for j in order[:k]]
    return out


@pytest.mark.parametrize("copies", [1, 40])
def test_recall_and_exact_scores(spark, copies):
    rows = table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    if copies > 1:  # one vector that many rows share
        vectors[::3] = vectors[0]
    frame = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in annsearch.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    want = plain_nearest(ids, vectors, 20)
    assert set(got) == set(want)
    hits = 0
    for query, best in want.items():
        answer = [got[query][k] for k in range(1, 21)]
        assert answer == sorted(answer, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in answer} & {i for i, _ in best})
    assert hits >= 0.9 * 20 * len(want)


def test_unusable_vectors_and_few_rows(spark):
    rng = random.Random(6)
    good = [(i, [rng.random() for _ in range(4)], 1) for i in range(0, 60, 10)]
    bad = [(100, None, 1), (120, [], 1), (140, [0.0] * 4, 1), (160, [1.0, None, 1.0, 1.0], 1), (180, [float("nan")] * 4, 1),
           (200, [float("inf"), 0.0, 0.0, 0.0], 1), (220, [1.0, 2.0], 1), (-20, [1.0, 2.0], 1), (None, [1.0] * 4, 1)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, id int")
    got = annsearch.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and len(got) == 15
    assert annsearch.nearest(frame.where("false"), F.lit(True)).count() == 0
