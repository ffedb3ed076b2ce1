"""The transducer against the tokenizers library, whole and in pieces."""

import random

import pytest
from tablesteward.llm import bpe
from tokenizers import Tokenizer

LETTERS = [*"abcdeABC 's'tre\n\t\r  .,!'-=<>|0123½²Ⅷéüñ \x1c\x1f\x85漢字😀́", "'ll", "'ve", "  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


@pytest.fixture(scope="module")
def merges():
    return bpe.merge_list(bpe.vocabulary())


def test_whole_texts(library, merges):
    rng, machine, back = random.Random(1), bpe.Transducer(merges), bpe.TextMachine(merges)
    for _ in range(3000):
        text = "".join(rng.choice([*LETTERS, "<|endoftext|>"]) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert machine.encode(text) == want
        assert back.decode(want) == library.decode(want, skip_special_tokens=False)


def test_pieces_and_long_units(library, merges):
    rng, machine = random.Random(2), bpe.Transducer(merges)
    for _ in range(300):
        text = "".join(rng.choice(LETTERS) * rng.choice([1, 1, 1, 700, 3000]) for _ in range(rng.randint(0, 10)))
        size = rng.choice([3, 17, 100, 1000])
        got = [t for ids in machine.plain(text[i : i + size] for i in range(0, len(text), size)) for t in ids]
        assert got == library.encode(text, add_special_tokens=False).ids


def test_stable_tokens_do_not_depend_on_what_follows(merges):
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice(b"aabbcde -=. \n") for _ in range(rng.randint(1, 600)))
        sure, covered = merges.stable(data)
        for _ in range(4):
            after = bytes(rng.choice(b"aabbcde -=. \n") for _ in range(200))
            assert merges.merged(data + after)[: len(sure)] == sure and covered <= len(data)


def test_frames(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a<|endoftext|>b", 3), (3, "x" * 200000 + " é", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    path = bpe.vocabulary()
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    assert [r.decoded_text for r in got] == ["", "", rows[2][1], rows[3][1]] and 50256 in got[2].token_ids
    assert bpe.encode(docs.where("false"), path).count() == 0


def test_partial_characters(merges):
    machine = bpe.TextMachine(merges)
    ids = [merges.byte_ids[b] for b in "é漢".encode()]
    assert machine.decode(ids) == "é漢" and machine.decode(ids[:-1]) == "é�"
    assert [machine.feed([i]) for i in ids] == ["", "é", "", "", "漢"]


def test_words_of_a_slice_are_at_hand_after_learning(monkeypatch):
    machine = bpe.Transducer(bpe.merge_list(bpe.vocabulary()))
    machine.known_words.limit = machine.known_units.limit = 64
    slices = [[f"begin {' '.join(f'w{chr(97 + i % 26)}o{k} plain{chr(97 + i % 26)}.' for i in range(n))}" for k in range(5)] for n in (26, 9, 20)]
    whole = [[machine.encode(text) for text in texts] for texts in slices]
    for texts, ids in zip(slices, whole, strict=True):
        machine.learn(texts)
        with monkeypatch.context() as patched:
            patched.setattr(machine, "word", None)  # not asked for one word
            assert [machine.encode(text) for text in texts] == ids
    assert machine.merges.merged_many([b" wordless", b"x", b"...!"]) == [bpe.packed(machine.merges.merged(u)) for u in (b" wordless", b"x", b"...!")]


def test_runs_of_ids_are_decoded_together():
    merges = bpe.merge_list(bpe.vocabulary())
    machine, coder = bpe.TextMachine(merges), bpe.Transducer(merges)
    texts = ["né 漢字", "", "a" * 7, "😀 x"]
    ids = [coder.encode(text) for text in texts]
    ids.append(ids[0][2:-1])  # begins or ends inside a character
    flat = bpe.pa.array([i for run in ids for i in run], bpe.pa.int32())
    assert machine.decode_many(flat, [len(run) for run in ids]) == [machine.decode(run) for run in ids]
    assert machine.decode_many(flat, [len(run) for run in ids])[:4] == texts
    with pytest.raises((KeyError, IndexError)):
        machine.decode([10**6])
