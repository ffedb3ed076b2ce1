"""Alignment against whole texts through both libraries and plain sets of byte ends."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from conftest import SMALL
from tablesteward.llm import alignment
from tablesteward.llm.batches import token_bytes_of_letters
from tokenizers import Tokenizer

FIRST, SECOND = alignment.vocabularies()
PARTS = [*"abcdeIé漢😀\U0001f9ff 's.,!0\n\t\x1c\x85 \x00́", "  ", " the", " quick", "▁", "<0x0A>", "<|endoftext|>", "<s>", " don't", "ﬁ", "Ａ"]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def tokens(libraries, text):
    """Ids and byte ends of both sides, None where they do not give the text back."""
    a, b = libraries
    want = (" " + text).encode()
    sides = []
    for ids, data_of in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: token_bytes_of_letters(a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        data = [data_of(i) for i in ids]
        if b"".join(data) != want:
            return None
        ends, total = [], 0
        for d in data:
            total += len(d)
            ends.append(total)
        sides.append((ids, ends))
    return sides


def brute_force(libraries, texts):
    found, counts = [], Counter()
    for text in texts:
        sides = tokens(libraries, text) if text else None
        links, groups = [], []
        if sides:
            (a, a_ends), (b, b_ends) = sides
            common = sorted(set(a_ends) & set(b_ends))
            links = [(a[a_ends.index(e)], b[b_ends.index(e)]) for e in common]
            start = 0
            for end in common:
                inside = [",".join(str(i) for i, e in zip(ids, ends, strict=True) if start < e <= end) for ids, ends in sides]
                groups.append("|".join(inside))
                start = end
        counts.update(links)
        found.append((sides, groups, links))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for sides, groups, links in found:
        told = ";".join(groups)
        out.append(
            (
                len(sides[0][0]) if sides else 0, len(sides[1][0]) if sides else 0, len(groups), len(links),
                sum(counts[link] == highest[link[1]] for link in links), sum(counts[link] for link in links),
                hashlib.sha256(told.encode()).hexdigest() if told else "", told,
            )
        )
    return out


def rows_of(df):
    return sorted(
        ((-1 if r[0] is None else r[0]), *r[1:])
        for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()
    )


def test_brute_force(spark, libraries):
    rng = random.Random(5)
    texts = [None, "", " ", "\n", "a▁b", "x▁ y", "the the the", "漢字 é", "a" * 3000 + " b", "\U0001f9ff" * 300]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += texts[10:20]
    rows = [(i // 2, t, "x", i, 7) for i, t in enumerate(texts)]  # ids twice, columns named like inner ones
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, block int, n_a int").repartition(5)
    want = sorted((row[0], *found) for row, found in zip(rows, brute_force(libraries, texts), strict=True))
    got = rows_of(alignment.aligned(docs, FIRST, SECOND, keep_groups=True))
    assert got == want


def test_small_table(spark, libraries):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    rows = sorted(docs.collect())
    want = [(r.doc_id, *found) for r, found in zip(rows, brute_force(libraries, [r.text for r in rows]), strict=True)]
    assert rows_of(alignment.aligned(docs, FIRST, SECOND, keep_groups=True)) == want


def test_long_text_and_empty_table(spark):
    long = "word é " * 150_000
    docs = spark.createDataFrame([(None, long), (1, "z" * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.aligned(docs, FIRST, SECOND).collect()}
    assert got[None].n_a >= 300_000 and got[None].n_links == got[None].n_groups and got[1].n_b > 1000 and got[1].groups is None
    assert alignment.aligned(docs.where("false"), FIRST, SECOND).count() == 0


def test_bytes_refine_coarse_spans():
    data = open(FIRST, "rb").read()
    own = alignment.LetterSide(data)
    text = " é\U0001f9ff漢x"
    ids, coarse = next(own.spans([text]))
    import numpy as np

    ends = own.ends(np.array(ids), coarse)
    assert ends.tolist() == np.cumsum(own.lengths[ids]).tolist() and coarse.tolist() != ends.tolist()
