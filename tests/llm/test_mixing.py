"""Targets, copies and reruns of the mix."""

import random
from collections import Counter

from tablesteward.llm import mixing

KIND = "doc_id long, text string, source string, size string"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > most * sizes[n]]
        if not over:
            return out | {n: left * weight[n] / total for n in open_}
        for n in over:
            out[n] = most * sizes[n]
            left -= most * sizes[n]
            open_.discard(n)
    return out


def test_targets_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["é", "b", "a", "a", "a", None]), "x") for i in range(3000)]
    rows += [(5000, None, "c", "x"), (None, "a b", "d", "x"), (7, "q " * 9, "a", "x"), (7, "q " * 9, "a", "x")]
    docs = spark.createDataFrame(rows, KIND)
    got = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    want, by_size = plain_targets(sizes), {}
    for r in got:
        assert 0 <= r.copies <= 3
        by_size.setdefault(r.source_size, [r.target, 0])[1] += r.size * r.copies
    for name, size in sizes.items():
        target, taken = by_size[size]
        assert abs(target - want[name]) < 1e-6 and abs(taken - target) <= 60
    repeated = mixing.repeated_documents(docs)
    assert repeated.count() == sum(r.copies for r in got) and repeated.columns == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], KIND)
    assert mixing.mixed(docs).count() == 0 and mixing.repeated_documents(docs).count() == 0


def test_copies_are_not_broadcast(spark):
    """Copies grow with the documents; a broadcast of them would fit small tables only."""
    rows = [(i, f"w{i} " * (i % 5 + 1), "ab"[i % 2], "x") for i in range(40)]
    for docs in (spark.createDataFrame(rows, KIND), spark.createDataFrame(rows + rows[:7], KIND)):
        stored = mixing.materialize(docs, "test-mix")
        repeated = mixing.repeated_documents(stored)
        repeated.collect()
        plan = repeated._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        # the texts are shuffled for one join; a second one reads the same shuffle again
        assert plan.count("SortMergeJoin") - 1 == plan.count("ReusedExchange")
