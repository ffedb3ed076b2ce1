"""Clusters against plain Python in whole numbers."""

import hashlib
import math
import random

import numpy as np
from conftest import SMALL
from tablesteward.llm import centroids


def brute_force(rows, width, scale, k, rounds, seed):
    kept = []
    for id_, vector in rows:
        if vector is None or len(vector) != width or any(x is None or not math.isfinite(x) for x in vector):
            continue
        numbers = [math.floor(scale * x) for x in vector]
        if all(abs(scale * x) < centroids.MOST_NUMBER for x in vector):
            kept.append((id_, numbers))

    def key(row):
        return hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    places = [numbers for _, numbers in sorted(kept, key=key)[:k]]

    def nearest(numbers):
        away = [sum((a - b) ** 2 for a, b in zip(numbers, c, strict=True)) for c in places]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        own = [nearest(numbers)[0] for _, numbers in kept]
        for c in range(len(places)):
            inside = [numbers for (_, numbers), o in zip(kept, own, strict=True) if o == c]
            if inside:
                places[c] = [sum(column) // len(inside) for column in zip(*inside, strict=True)]
    own = [nearest(numbers) for _, numbers in kept]
    per = [sum(d for c, d in own if c == i) for i in range(len(places))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    return sorted(
        (-1 if i is None else i, c, d, per[c], sum(per), digests[c]) for (i, _), (c, d) in zip(kept, own, strict=True)
    )


def rows_of(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_ties_repeats_and_unusable_vectors(spark):
    rng = random.Random(4)
    rows = [(None, [0.0, 0.0]), (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0])]
    rows += [(7, [1e30, 0.0]), (8, [-0.001, 0.0]), (9, [1.0, 2.0, 3.0])]
    rows += [(rng.randint(10, 60), [rng.randint(-8, 8) / 4, rng.randint(-8, 8) / 4]) for _ in range(300)]
    rows += [rows[-1]] * 20
    for k, rounds in ((1, 3), (3, 1), (8, 10), (5, 0)):
        frame = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, cluster string, size int")
        got, _ = centroids.clustered(frame.repartition(6), width=2, scale=4, centroids=k, rounds=rounds, seed=3)
        single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        assert rows_of(got) == brute_force(single, 2, 4, k, rounds, 3)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert rows_of(centroids.op13_bisectors(spark, SMALL)) == brute_force(rows, 64, 1024, 8, 10, 3)


def test_few_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, [1.0] * 64), (1, [1.0] * 64), (2, [-2.0] * 64)], "vec_id long, embedding array<double>")
    got, places = centroids.clustered(frame)
    assert len(places) == 3 and {r.distance for r in got.collect()} == {0}
    got, places = centroids.clustered(frame.where("false"))
    assert got.count() == 0 and len(places) == 0 and got.columns[-1] == "centroid_sha256"


def test_bisectors_at_the_limit():
    far = centroids.MOST_NUMBER - 1
    points = np.array([[far] * 256, [-far] * 256, [far] * 128 + [-far] * 128], dtype=np.int64)
    own = centroids.Bisectors(points[:2]).nearest(points)
    assert own.tolist() == [0, 1, 0]
    assert centroids.Bisectors(points[:2]).distances(points, own).tolist() == [0, 0, 128 * (2 * far) ** 2]
