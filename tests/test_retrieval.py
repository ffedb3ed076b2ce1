"""Blocked nearest neighbours against brute force, and contexts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesteward.functions.vectors import hashed_term_embedder
from tablesteward.operators import retrieval
from tablesteward.operators.retrieval import CARD_RULE, CONTEXT_HEADER, nearest, retrieve_contexts


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors():
    generator = np.random.default_rng(4)
    index = unit(generator.normal(size=(300, 8)))
    index[50:150] = index[50]  # a third of the index are copies of one vector
    questions = unit(generator.normal(size=(40, 8)))
    questions[:10] = index[50]
    return questions, index


def brute(questions, index, k, ceiling=np.inf):
    found = set()
    for q, question in enumerate(questions):
        distance = np.round(1.0 - index @ question, 6) + 0.0
        for rank, d in enumerate(np.lexsort((np.arange(len(index)), distance))[:k], start=1):
            if distance[d] <= ceiling:
                found.add((q, int(d), rank, float(distance[d])))
    return found


@pytest.mark.parametrize("block_rows, ceiling", [(4096, None), (37, None), (37, 0.4), (5, None)])
def test_nearest_equals_brute_force(spark, vectors, block_rows, ceiling):
    questions, index = vectors
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(questions)], "q_id bigint, vector array<double>")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index)], "doc_id bigint, vector array<double>")
    rows = nearest(q, d, 5, ceiling, block_rows).collect()
    got = {(r["q_id"], r["doc_id"], r["rank"], r["distance"]) for r in rows}
    assert got == brute(questions, index, 5, np.inf if ceiling is None else ceiling)


def test_blocks_are_sized_by_their_bytes():
    """Vectors are sent to a number of blocks that stays the same while blocks of that many fit a task."""
    counts = [retrieval.block_count(rows, retrieval.SIDE_BLOCKS, 64) for rows in (1, 4096, 100_000, 700_000)]
    assert counts == [1, 1, 8, 8]
    assert retrieval.block_count(700_000, retrieval.SIDE_BLOCKS, 1536) == -(-700_000 // 4096)
    assert retrieval.block_count(100, 8, 64, rows_per_block=37) == 3


@pytest.mark.parametrize("exclude_self", [False, True])
def test_index_blocks_are_read_in_parts(spark, vectors, monkeypatch, exclude_self):
    """Ties between the parts, and a question's own row in any of them."""
    monkeypatch.setattr(retrieval, "INDEX_ROWS", 7)
    monkeypatch.setattr(retrieval, "QUESTION_ROWS", 16)
    _, index = vectors
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index)], "doc_id bigint, vector array<double>")
    rows = nearest(d.withColumnRenamed("doc_id", "q_id"), d, 5, 0.3, exclude_self=exclude_self).collect()
    pairs = brute(index, index, 6, 0.3)
    if exclude_self:
        others = sorted((q, place, i, distance) for q, i, place, distance in pairs if q != i)
        place = {q: [o for o in others if o[0] == q][:5] for q in range(len(index))}
        pairs = {(q, i, n, distance) for q, held in place.items() for n, (_, _, i, distance) in enumerate(held, start=1)}
    else:
        pairs = {p for p in pairs if p[2] <= 5}
    assert {(r["q_id"], r["doc_id"], r["rank"], r["distance"]) for r in rows} == pairs


def test_no_row_pairs_in_the_plan(spark, vectors):
    questions, index = vectors
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(questions)], "q_id bigint, vector array<double>")
    plan = nearest(q, q.withColumnRenamed("q_id", "doc_id"), exclude_self=True)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_contexts(spark):
    embedder = hashed_term_embedder(256)
    texts = [("a", "supplier account balance"), ("b", "customer orders price"), ("c", "air ozone level"), ("d", "supplier parts")]
    index = spark.createDataFrame(texts, "doc_id string, embed_text string").withColumn(
        "card", F.when(F.col("doc_id") != "d", F.concat(F.lit("card "), "doc_id"))
    )
    from tablesteward.functions.vectors import embed_column

    index = embed_column(index, "embed_text", "embedding", embedder, dimensions=256)
    asked = ["supplier account", "supplier account", "orders price", "", "unrelated words"]
    questions = spark.createDataFrame(list(enumerate(asked)), "i int, question string")
    options = {"dimensions": 256, "instruction": ""}
    found = {r["i"]: r["context"] for r in retrieve_contexts(questions, index, embedder, 2, **options).collect()}
    # The second hit for suppliers has no card and is dropped after the limit.
    assert found[0] == found[1] == CONTEXT_HEADER + "card a"
    assert found[2] == CONTEXT_HEADER + "card b" + CARD_RULE + "card a" and found[3] == ""
    near = {r["i"]: r["context"] for r in retrieve_contexts(questions, index, embedder, 2, 0.5, **options).collect()}
    assert near[2] == CONTEXT_HEADER + "card b" and near[4] == ""


def test_unusable_vectors_take_no_part(spark):
    from tablesteward.operators.retrieval import nearest, unusable_vectors

    good = [(i, [1.0, float(i)]) for i in range(4)]
    bad = [(10, None), (11, []), (12, [1.0]), (13, [float("nan"), 1.0]), (14, [float("inf"), 0.0])]
    index = spark.createDataFrame(good + bad, "doc_id long, vector array<double>")
    pairs = nearest(index.withColumnRenamed("doc_id", "q_id"), index, k=9).collect()
    assert {r["q_id"] for r in pairs} == {r["doc_id"] for r in pairs} == {0, 1, 2, 3}
    found = {r["doc_id"]: r["status"] for r in unusable_vectors(index, "doc_id", 2).collect()}
    assert found == {10: "missing", 11: "missing", 12: "wrong_size", 13: "not_finite", 14: "not_finite"}
