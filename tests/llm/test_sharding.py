"""Shards: near equal bytes, gapless slots, whole small groups."""

import random
import zlib
from collections import defaultdict

from tablesteward.llm import sharding

KIND = "doc_id long, text string, shard string, place int"


def test_laws(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "é" * rng.randint(0, 200), "x", 1) for i in range(600)] + [(1000 + i, "same text " * 5, "x", 1) for i in range(900)]
    rows += [(5, None, "x", 1), (None, "a", "x", 1), (6, "twice", "x", 1), (6, "twice", "x", 1)]
    docs = spark.createDataFrame(rows, KIND)
    monkeypatch.setattr(sharding, "RANGE_SAMPLE", 3)
    got = sharding.sharded(docs).collect()
    size, slots, shards_of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shards_of[r.text_crc32].add(r.shard)
    total = sum(len((t or "").encode()) + 1 for _, t, _, _ in rows)
    assert sum(size.values()) == total and set(size) == set(range(8))
    assert max(size.values()) - min(size.values()) <= 0.1 * total / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    same = zlib.crc32(b"same text " * 5)
    assert len(shards_of.pop(same)) > 1
    counts = defaultdict(int)
    for _, t, _, _ in rows:
        counts[zlib.crc32((t or "").encode())] += len((t or "").encode()) + 1
    assert all(len(found) == 1 for key, found in shards_of.items() if counts[key] <= 0.01 * total / 8)
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_empty(spark):
    assert sharding.sharded(spark.createDataFrame([], KIND)).count() == 0
