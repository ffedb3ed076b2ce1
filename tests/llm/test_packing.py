"""Packed windows against the library's ids, piece by piece."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from tablesteward.llm import packing
from tokenizers import Tokenizer

PARTS = [*"abcIéÀΣİ漢😀 's.,!0\n\t\x1c\x85 ́", "  ", " the", " quick", "<|endoftext|>", "<|startoftext|>", " don't", "ﬁ", "Å", "क़", "ΐ!"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.vocabulary())


def check(pieces, docs, library, window):
    """Whether pieces hold each document's ids once and windows are gapless; returns the padding."""
    want = sorted((-1 if i is None else i, *library.encode(t or "", add_special_tokens=False).ids, 1) for i, t in docs)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), dtype="<u4").tolist()
        assert len(ids) == p.length > 0
        by_doc[-1 if p.doc_id is None else p.doc_id, p.doc_tokens].append((p.start, ids))
        by_window[p.sequence_id].append((p.offset, p.length))
    got = []
    for (doc, tokens), parts in by_doc.items():
        copies = sum(len(ids) for _, ids in parts) // tokens
        ends = defaultdict(list)  # rows of one id are told apart by where their pieces end
        for start, ids in sorted(parts):
            before = ends[start].pop() if start else []
            assert len(before) == start
            ends[start + len(ids)].append(before + ids)
        assert len(ends[tokens]) == copies
        got += [(doc, *ids) for ids in ends[tokens]]
    assert sorted(got) == want
    padding = 0
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(at for parts in by_window.values() for _, at in parts)


def test_ids_of_words(library):
    import pyarrow as pa

    rng = random.Random(7)
    texts = [None, "", " ", "a", "x" * 100_000, *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(2000))]
    got = packing.Words(open(packing.vocabulary(), "rb").read()).encoded(pa.array(texts), 1)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_known_characters_need_merges_only(library):
    import pyarrow as pa

    class Merges:
        """The library without its way from a text to ids."""

        def encode(self, *args, **settings):
            raise AssertionError("a text of known characters went through the whole library")

    texts = ["It's 24 o'clock: don't 'quote' (a_b)...\nWE'RE ''s '", "L'été, où ÇA?", "Слово, ΣΊΣΥΦΟΣ; 漢字。かな", "x²½ Ⓐ“q” – Ⅷ"]
    words = packing.Words(open(packing.vocabulary(), "rb").read())
    words.library = Merges()
    for text, ids in zip(texts, words.encoded(pa.array(texts), 1), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_ids_of_characters_beside_others(library):
    import pyarrow as pa

    rng = random.Random(9)
    marks = [chr(i) for i in range(0x300, 0x370)]
    some = [chr(i) for i in (*range(1, 0x600), *range(0x1100, 0x1200), *range(0x1E00, 0x2500), *range(0x3000, 0x3100), *range(0xAC00, 0xAC40))]
    often = [*"aeJHTwyIK'’.<| \n\t", "'s", "'LL", "'re", "<|endoftext|>", "<|EndOfText|>", "😀", "𝐀", "\U00016d67"] * 60
    texts = [c + "'s" + c + "a" + c + "! '" + c for c in some + marks]
    texts += ["".join(rng.choice(some + marks * 3 + often) for _ in range(rng.randint(1, 25))) for _ in range(5000)]
    got = packing.Words(open(packing.vocabulary(), "rb").read()).encoded(pa.array(texts), 1)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text


def test_ids_are_forgotten_between_blocks(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "BLOCK_WORDS", 2, raising=False)
    words = packing.Words(open(packing.vocabulary(), "rb").read())
    for texts in (["one two", "e\u0301te\u0301 three."], ["three two", None, "four, e\u0301te\u0301"], [], [""]):
        got = words.encoded(pa.array(texts, pa.string()), 1)
        assert [ids.tolist() for ids in got] == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_small_windows(spark, library):
    rng = random.Random(8)
    rows = [(None, None, 1), (1, "", 2), (2, "a b c", 3), (3, "word " * 500, 4)]
    rows += [(100 + i, " ".join(rng.choice(["ab", "the", "quick", "x"]) for _ in range(rng.randint(0, 60))), 5) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, window int").repartition(40)
    pieces = packing.packed(docs, packing.vocabulary(), window=32, open_windows=3, least_gap=4).collect()
    padding, tokens = check(pieces, [(r[0], r[1]) for r in rows], library, 32)
    assert padding < 0.1 * tokens


def test_repeated_rows(spark, library):
    rows = [(1, "one two three four five six seven eight nine ten " * 3)] * 7
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), packing.vocabulary(), window=16).collect()
    assert check(pieces, rows, library, 16)[0] == 0


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    padding, tokens = check(packing.packed(docs, packing.vocabulary()).collect(), rows, library, packing.WINDOW)
    assert padding < 0.005 * tokens and tokens > 10_000
    crcs = {(r.doc_id, r.start, r.length): r.ids_crc32 for r in packing.op12_packing(spark, SMALL).collect()}
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for (doc, start, length), crc in crcs.items():
        assert crc == zlib.crc32(np.array(ids[doc][start : start + length], dtype="<u4").tobytes())


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), packing.vocabulary()).count() == 0
