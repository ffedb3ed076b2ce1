"""SimHash fingerprints and components against all pairs."""

import random

import numpy as np
import xxhash
from tablesteward.llm import simhash
from tablesteward.llm.components import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                up[max(top(i), top(j), key=lambda k: ids[k])] = min(top(i), top(j), key=lambda k: ids[k])
    return [ids[top(i)] for i in range(len(ids))]


def test_components_of_texts(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(80)) for _ in range(10)]
    texts = [None, "", " \n", "one", "One", "two words"]
    for text in base:
        for _ in range(6):
            words = text.split()
            words[rng.randrange(80)] = "zz"
            texts.append(" ".join(words))
    rows = [(i, text, i) for i, text in enumerate(texts)] + [(7, texts[7], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(text) for _, text, _ in rows]
    want = plain_components([r[0] for r in rows], prints)
    told = sorted((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in got)
    assert told == sorted(zip([r[0] for r in rows], prints, want, strict=True))
    kept = simhash.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_links_of_dense_groups(spark):
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 1 << 62))
    near = {center ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}
    values = sorted(near | {int(v) for v in rng.integers(-(1 << 63), 1 << 63, 600)})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for segments in (4, 8):
        labels = connected_components(simhash.linked(frame, segments=segments), "a", "b")
        assert labels.where(f"label = {min(near)}").count() == labels.count() == len(near)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0
