"""Approximate retrieval against the exact one, and codes kept beside an index."""

import numpy as np
from pyspark.sql import functions as F

from tablesteward.operators import hyperplanes, retrieval

WIDTH = 24


def unit_rows(rng, count, centers):
    points = centers[rng.integers(0, len(centers), count)] + 0.35 * rng.standard_normal((count, WIDTH))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def frame(spark, points, key="doc_id", first=0):
    return spark.createDataFrame([(first + i, p.tolist()) for i, p in enumerate(points)], f"{key} long, vector array<double>")


def test_costs_by_plain_python():
    settings = hyperplanes.Hyperplanes(WIDTH, bands=2, bits=3)
    margins = settings.margins(np.random.default_rng(0).standard_normal((5, WIDTH)), settings.planes())
    codes, costs = settings.codes(margins), settings.costs(margins)
    for row in range(5):
        for band in range(2):
            sides = [int(m > 0) for m in margins[row, band]]
            assert codes[row, band] == sum(s << j for j, s in enumerate(sides))
            for code in range(8):
                want = sum(margins[row, band, j] ** 2 for j in range(3) if (code >> j & 1) != sides[j])
                assert abs(costs[row, band, code] - want) < 1e-12


def test_recall_and_buckets_of_any_size(spark):
    rng = np.random.default_rng(3)
    points = unit_rows(rng, 1500, rng.standard_normal((30, WIDTH)))
    points[:400] = points[0]  # one bucket of each band holds a quarter of all rows
    index, asked = frame(spark, points), frame(spark, unit_rows(rng, 200, points[::50]), "q_id", 10_000)
    settings = hyperplanes.Hyperplanes(WIDTH, bands=6, bits=5)
    codes = hyperplanes.vector_codes(index, "doc_id", settings).cache()
    tuned = hyperplanes.calibrated(index, settings, asked, sample=100)
    assert 1 <= tuned.probes < 32
    exact = retrieval.nearest(asked, index).select("q_id", "doc_id")
    for block_rows in (64, 4096):
        found = hyperplanes.nearest_approximate(asked, index, codes, tuned, block_rows=block_rows)
        assert found.groupBy("q_id").count().where("count = 5").count() == 200
        assert exact.join(found, ["q_id", "doc_id"]).count() >= 0.9 * exact.count()
    every = hyperplanes.Hyperplanes(WIDTH, bands=6, bits=5, probes=32)
    assert sorted(hyperplanes.nearest_approximate(asked, index, codes, every).collect()) == sorted(retrieval.nearest(asked, index).collect())


def test_few_hits_are_searched_exactly(spark):
    rng = np.random.default_rng(4)
    points = unit_rows(rng, 40, rng.standard_normal((40, WIDTH)))
    index = frame(spark, points)
    settings = hyperplanes.Hyperplanes(WIDTH, bands=1, bits=12, probes=1)
    codes = hyperplanes.vector_codes(index, "doc_id", settings)
    asked = index.withColumnRenamed("doc_id", "q_id")
    found = hyperplanes.nearest_approximate(asked, index, codes, settings, exclude_self=True)
    assert found.count() == 200
    plan = hyperplanes.nearest_approximate(asked, index, codes, settings)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_codes_follow_the_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    points = unit_rows(rng, 60, rng.standard_normal((5, WIDTH)))
    table = hyperplanes.CodeTable(spark, str(tmp_path / "codes"), hyperplanes.Hyperplanes(WIDTH))
    index = frame(spark, points)
    assert (table.refresh(index), table.refresh(index), table.store.current()) == (60, 0, 0)
    turned = index.where("doc_id >= 10").withColumn(
        "vector", F.when(F.col("doc_id") < 13, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))
    )
    odd = spark.createDataFrame([(100, None), (101, [1.0]), (102, [float("nan")] * WIDTH)], "doc_id long, vector array<double>")
    assert table.refresh(turned.unionByName(odd)) == 3
    fresh = hyperplanes.vector_codes(turned, "doc_id", table.settings)
    assert sorted(table.read().collect()) == sorted(fresh.collect()) and table.read().count() == 50


def test_contexts_by_codes(spark):
    index = spark.createDataFrame([(f"d{i}", [float(i == j) for j in range(8)], f"card {i}") for i in range(8)], "doc_id string, embedding array<double>, card string")
    settings = hyperplanes.Hyperplanes(8, bands=2, bits=2, probes=4)
    codes = hyperplanes.vector_codes(index.select("doc_id", F.col("embedding").alias("vector")), "doc_id", settings)

    def embedder(texts):
        return [[float(int(t[-1]) == j) for j in range(8)] for t in texts]

    asked = spark.createDataFrame([("which 3",), ("",)], "question string")
    given = {"k": 1, "dimensions": 8}
    by_codes = retrieval.retrieve_contexts(asked, index, embedder, search=hyperplanes.searcher(codes, settings), **given)
    assert sorted(by_codes.collect()) == sorted(retrieval.retrieve_contexts(asked, index, embedder, **given).collect())


def test_usual_width_wins(spark):
    index = spark.createDataFrame([(0, [1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "q_id long, vector array<double>")
    assert [r.doc_id for r in retrieval.nearest(asked, index, 1).collect()] == [1]
