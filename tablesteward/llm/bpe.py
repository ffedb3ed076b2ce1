"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

**How far tokens depend on what follows.** Merges are applied rule by rule, the
earliest first. Take two texts with a common beginning and let the common tokens
end at some place. A rule ``u v`` can only shorten that common part by its last
token ``u``: where ``u`` merges with a following ``v`` in one text and not in the
other. The next rule ``u' v'`` that shortens it comes later and needs a ``v'`` that
begins with what ``u`` has become on the right of the new border. So the loss is
at most the heaviest chain of rules, each weighing the bytes of its left part;
``sufficient_lookahead`` computes it by one pass over the merge list. A token that
ends at least that many bytes before the end of what was read is stable, and the
tokens after it are those of the rest alone.

**Transducer.** Text comes in pieces of any size. Pieces between blanks are
independent (a blank followed by a non-blank starts a new unit), so whole units
are emitted as soon as the next one starts; a unit longer than the lookahead is
emitted while it is still being read. What is held back is bounded by the
lookahead and the longest token, whatever the length of a text or of a unit.
Encodings of short words and units are remembered in two generations of bounded
size: a full table becomes the old one, and what is still used moves on. The
new units of a slice of texts are merged together, all of one length at a time,
before the slice is read.

**Decoder.** A byte-to-text state machine: tokens are turned into bytes, complete
characters are emitted, an unfinished one (three bytes at most) is the state.

Defined results: a null text is an empty one (no ids, empty text); added tokens
of the vocabulary (``<|endoftext|>``) in a text become their own id, as in the
library; ids outside the vocabulary are an error; repeated rows are coded alike;
an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.llm.batches import ShippedFile, byte_letters, byte_slices, sha256_hex, shipped_bytes, table

# The units of byte-level BPE, and the runs among them that can be of any length.
UNITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SYMBOL_RUN = r"[^\s\p{L}\p{N}]+"
APOSTROPHE_CHARS = 3

# Above every merge's place in the list.
NEVER = 1 << 30

# Units and words of a generation whose encodings a worker remembers, and the longest of them.
REMEMBERED_UNITS = 1 << 16
REMEMBERED_WORDS = 1 << 17
REMEMBERED_CHARS = 48

# Bytes of texts whose new units are merged together; a worker's memory is a small
# multiple of this and of the tables above.
LEARN_BYTES = 3 << 20

# Units up to this many bytes are merged many at a time.
SHORT_BYTES = 40

# Characters read, and ids decoded, at once.
PIECE = 1 << 16

# Ids are packed as 32-bit numbers.
ID = np.dtype("<i4")


class MergeList:
    """The vocabulary and merges of a byte-level BPE file."""

    def __init__(self, told: dict):
        model = told["model"]
        letter_bytes = {letter: byte for byte, letter in byte_letters().items()}

        def as_bytes(token: str) -> bytes:
            return bytes(letter_bytes[letter] for letter in token)

        self.token_bytes = {i: as_bytes(token) for token, i in model["vocab"].items()}
        ids = {token: i for i, token in self.token_bytes.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.added = {a["content"]: a["id"] for a in told.get("added_tokens", [])}
        self.token_bytes |= {i: content.encode() for content, i in self.added.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = [(ids[as_bytes(a)], ids[as_bytes(b)], ids[as_bytes(a) + as_bytes(b)]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(self.merges)}
        made_at = {made: rank for rank, (_, _, made) in reversed(list(enumerate(self.merges)))}
        for rank, (a, b, _) in enumerate(self.merges):
            if made_at.get(a, -1) >= rank or made_at.get(b, -1) >= rank:
                raise ValueError(f"merge {rank} comes before the merges of its parts")
        self.made_at = made_at
        self.longest = max(map(len, self.token_bytes.values()))
        self.table = pa.array(map(self.token_bytes.get, range(max(self.token_bytes) + 1)), pa.large_binary())
        keys = np.array([a << 32 | b for a, b, _ in self.merges], dtype=np.int64)
        self.key_order = np.argsort(keys)
        self.sorted_keys = keys[self.key_order]
        self.made = np.array([made for _, _, made in self.merges], dtype=ID)
        self.byte_ranks = self.rank_of(*(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))).reshape(256, 256)
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Bytes after a token's end beyond which nothing can change it."""
        parts = {made: (a, b) for a, b, made in reversed(self.merges)}
        # for each left part, its rules so far and the heaviest chain that ends with one of them
        chains: dict[int, tuple[list[int], list[int]]] = {}
        heaviest = 0
        for rank, (left, right, _) in enumerate(self.merges):
            before, spine, until = 0, right, rank
            while True:  # the right part and its beginnings
                ranks, weights = chains.get(spine, ((), ()))
                if place := bisect_right(ranks, until):
                    before = max(before, weights[place - 1])
                if spine not in parts:
                    break
                until = min(rank, self.made_at[spine])
                spine = parts[spine][0]
            weight = len(self.token_bytes[left]) + before
            ranks, weights = chains.setdefault(left, ([], []))
            ranks.append(rank)
            weights.append(max(weight, weights[-1] if weights else 0))
            heaviest = max(heaviest, weight)
        return heaviest

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a byte string."""
        ids = [self.byte_ids[b] for b in data]
        return self.merged_short(ids) if len(ids) <= SHORT_BYTES else self.merged_long(ids)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the list, or ``NEVER``."""
        if not len(self.sorted_keys):
            return np.full(len(left), NEVER, dtype=ID)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == keys, self.key_order[at], NEVER).astype(ID)

    def merged_many(self, units: list[bytes]) -> list[bytes]:
        """The packed tokens of many short byte strings, those of one length together."""
        out: list[bytes] = [b""] * len(units)
        lengths = np.array([len(unit) for unit in units], dtype=np.int64)
        byte_ids = np.array(self.byte_ids, dtype=ID)
        for length in np.unique(lengths):
            of = np.flatnonzero(lengths == length)
            letters = np.frombuffer(b"".join([units[i] for i in of]), dtype=np.uint8).reshape(len(of), length)
            tokens, counts = self.merged_rows(byte_ids[letters], self.byte_ranks[letters[:, :-1], letters[:, 1:]])
            for i, row, count in zip(of.tolist(), tokens, counts.tolist(), strict=True):
                out[i] = row[:count].tobytes()
        return out

    def merged_rows(self, tokens: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of tokens and the ranks of their pairs, merged one pair a step, each row its earliest rule and leftmost
        place; and what is left of each."""
        rows, width = tokens.shape
        counts = np.full(rows, width)
        if width < 2 or not len(self.merges):
            return tokens, counts
        live, work = np.arange(rows), tokens
        while True:
            at, own = ranks.argmin(axis=1), np.arange(len(live))
            best = ranks[own, at]
            on, size = best < NEVER, work.shape[1]
            if not on.all():
                done = live[~on]
                tokens[done, :size], counts[done] = work[~on], size
                live, work, ranks, at, best = live[on], work[on], ranks[on], at[on], best[on]
                if not len(live):
                    return tokens, counts
                own = own[: len(live)]
            # what is right of the pair moves one place to the left, so all rows still live are of one length
            places = np.arange(size - 1, dtype=np.int32)
            moved = places >= at.astype(np.int32)[:, None]
            kept = work[:, :-1].copy()
            np.copyto(kept, work[:, 1:], where=moved)
            kept[own, at] = self.made[best]
            work = kept
            if size == 2:
                tokens[live, :1], counts[live] = work, 1
                return tokens, counts
            kept = ranks[:, :-1].copy()
            np.copyto(kept, ranks[:, 1:], where=moved[:, :-1])
            ranks = kept
            right, left = np.flatnonzero(at < size - 2), np.flatnonzero(at)
            ranks[right, at[right]] = self.rank_of(work[right, at[right]], work[right, at[right] + 1])
            ranks[left, at[left] - 1] = self.rank_of(work[left, at[left] - 1], work[left, at[left]])

    def merged_short(self, ids: list[int]) -> list[int]:
        rank, merges = self.ranks.get, self.merges
        pairs = [rank(pair, NEVER) for pair in zip(ids, ids[1:], strict=False)]
        while pairs and (best := min(pairs)) < NEVER:
            at = pairs.index(best)
            ids[at : at + 2] = [merges[best][2]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank((ids[at], ids[at + 1]), NEVER)
            if at:
                pairs[at - 1] = rank((ids[at - 1], ids[at]), NEVER)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between neighbours."""
        count, rank = len(ids), self.ranks.get
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(found, i) for i in range(count - 1) if (found := rank((ids[i], ids[i + 1]), NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            place, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= count or rank((ids[i], ids[j])) != place:
                continue
            ids[i], ids[j] = self.merges[place][2], -1
            after[i] = k = after[j]
            if k < count:
                before[k] = i
                if (found := rank((ids[i], ids[k]), NEVER)) < NEVER:
                    heapq.heappush(heap, (found, i))
            if (h := before[i]) >= 0 and (found := rank((ids[h], ids[i]), NEVER)) < NEVER:
                heapq.heappush(heap, (found, h))
        return [i for i in ids if i >= 0]

    def stable(self, data: bytes) -> tuple[list[int], int]:
        """The tokens that nothing after ``data`` can change, and the bytes they cover."""
        sure, out, covered = len(data) - self.lookahead, [], 0
        for token in self.merged(data):
            end = covered + len(self.token_bytes[token])
            if end > sure:
                break
            out.append(token)
            covered = end
        return out, covered


@functools.lru_cache(maxsize=4)
def merge_list(path: str) -> MergeList:
    with open(path, encoding="utf-8") as file:
        return MergeList(json.load(file))


@functools.lru_cache(maxsize=2)
def loaded(digest: str, data: bytes) -> MergeList:
    return MergeList(json.loads(data))


class Remembered:
    """A table of bounded size: the young generation, and the one before it."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes | None:
        found = self.young.get(text)
        if found is None and (found := self.old.get(text)) is not None:
            self.put(text, found)
        return found

    def put(self, text: str, ids: bytes) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[text] = ids

    def take_in(self, wanted: set[str], made: dict[str, bytes]) -> None:
        """Put new texts into the young generation, which then holds all ``wanted`` ones that are known."""
        if len(self.young) + len(made) > self.limit:
            kept = {text: ids for text in wanted if (ids := self.young.get(text)) is not None}
            self.old, self.young = self.young, kept
        self.young.update(made)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype=ID).tobytes()


class Transducer:
    """Text in, in pieces; ids out as soon as they are stable."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.units = regex.compile(UNITS)
        self.symbols = regex.compile(SYMBOL_RUN)
        self.added = regex.compile("|".join(map(regex.escape, sorted(merges.added, key=len, reverse=True)))) if merges.added else None
        # a unit is only cut where it is longer than both of these
        self.window = 4 * (merges.lookahead + merges.longest)
        self.known_units, self.known_words = Remembered(REMEMBERED_UNITS), Remembered(REMEMBERED_WORDS)

    def learn(self, texts: Iterable[str]) -> None:
        """Remember the words of some texts, their new units merged together."""
        words: set[str] = set()
        for text in texts:
            words.update(text.split(" "))
        young, old = self.known_words.young, self.known_words.old
        absent = [w for w in words if w not in young and 0 < len(w) < REMEMBERED_CHARS and not w[0].isspace()]
        made = {word: ids for word in absent if (ids := old.get(word)) is not None}
        fresh = [word for word in absent if word not in made]
        # a word of ASCII letters is one unit with its blank
        whole = [word for word in fresh if word.isascii() and word.isalpha()]
        parted = [word for word in fresh if not (word.isascii() and word.isalpha())]
        del absent, fresh
        # a unit that begins with a blank begins a word
        units = self.units.findall("".join([f" {word}" for word in parted]))
        starts = [at for at, unit in enumerate(units) if unit[0] == " "]
        if len(starts) != len(parted):
            raise AssertionError("words are cut elsewhere than at their blanks")
        distinct = set(units)
        known = self.known_units
        found = {
            unit: known.young.get(unit) or known.old.get(unit) or (young.get(unit[1:]) or old.get(unit[1:]) if unit[0] == " " else None)
            for unit in distinct
        }
        new = [unit for unit, ids in found.items() if ids is None and len(unit) <= SHORT_BYTES and len(unit.encode()) <= SHORT_BYTES]
        merged = self.merges.merged_many([f" {word}".encode() for word in whole] + [unit.encode() for unit in new])
        made.update(zip(whole, merged, strict=False))
        found.update(zip(new, merged[len(whole) :], strict=True))
        for unit in [unit for unit, ids in found.items() if ids is None]:
            found[unit] = self.unit(unit)
        known.take_in(distinct, {unit: ids for unit, ids in found.items() if unit not in known.young})
        ids = [*map(found.get, units)]
        for word, (start, end) in zip(parted, pairwise([*starts, len(units)]), strict=True):
            made[word] = b"".join(ids[start:end])
        self.known_words.take_in(words, made)

    def unit(self, text: str) -> bytes:
        found = self.known_units.get(text)
        if found is None:
            data = text.encode()
            if len(data) > self.window:
                return packed(list(self.long_unit(data)))
            found = packed(self.merges.merged(data))
            if len(text) <= REMEMBERED_CHARS:
                self.known_units.put(text, found)
        return found

    def long_unit(self, data: bytes) -> Iterator[int]:
        """A unit longer than the window, window by window."""
        start = 0
        while len(data) - start > self.window:
            tokens, covered = self.merges.stable(data[start : start + self.window])
            yield from tokens
            start += covered
        yield from self.merges.merged(data[start:])

    def split(self, text: str) -> bytes:
        """The ids of whole units."""
        return b"".join([self.unit(unit) for unit in self.units.findall(text)])

    def word(self, text: str) -> bytes:
        """The ids of a blank and a word, which begins with a non-blank and holds no single blank."""
        found = self.known_words.get(text)
        if found is None:
            found = self.split(" " + text)
            if len(text) < REMEMBERED_CHARS:
                self.known_words.put(text, found)
        return found

    def words(self, text: str) -> bytes:
        """The ids of a text of whole units, by words where single blanks part them."""
        first, *rest = text.split(" ")
        found = [*map(self.known_words.young.get, rest)]
        try:
            return self.split(first) + b"".join(found)
        except TypeError:  # a word that is not in the young table
            for at, ids in enumerate(found):
                if ids is None:
                    word = rest[at]
                    if not word or word[0].isspace():
                        return self.uneven(first, rest)
                    found[at] = self.word(word)
        return self.split(first) + b"".join(found)

    def uneven(self, first: str, rest: list[str]) -> bytes:
        """The same where a run of blanks goes with the words on both sides."""
        out: list[bytes] = []
        pending, even = first, False
        for word in rest:
            if word and not word[0].isspace():
                out.append(self.word(pending) if even else self.split(pending))
                pending, even = word, True
            else:
                pending, even = f" {pending} {word}" if even else f"{pending} {word}", False
        out.append(self.word(pending) if even else self.split(pending))
        return b"".join(out)

    def plain(self, pieces: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of text without added tokens."""
        for ids in self.emitted(pieces):
            yield np.frombuffer(ids, dtype=ID)

    def emitted(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """The same, packed."""
        held = ""
        run, run_bytes, run_last = None, b"", ""  # a unit that is being emitted before its end
        for piece in pieces:
            if run is not None:
                more = run.match(piece)
                grown = more[0] if more else ""
                run_bytes += grown.encode()
                run_last = (run_last + grown)[-1]
                if len(grown) == len(piece):
                    while len(run_bytes) > self.window:
                        tokens, covered = self.merges.stable(run_bytes[: self.window])
                        yield packed(tokens)
                        run_bytes = run_bytes[covered:]
                    continue
                piece = piece[len(grown) :]
                if run is self.blanks:  # a run leaves its last blank to the next unit
                    run_bytes, piece = run_bytes[: -len(run_last.encode())], run_last + piece
                yield packed(self.merges.merged(run_bytes) if len(run_bytes) <= self.window else list(self.long_unit(run_bytes)))
                run, run_bytes = None, b""
            held += piece
            cut = self.boundary(held)
            if cut:
                yield self.words(held[:cut])
                held = held[cut:]
            if len(held) > self.window:
                units = list(self.units.finditer(held))
                whole = [unit for unit in units[:-1] if unit.end() <= len(held) - APOSTROPHE_CHARS]
                yield b"".join([self.unit(unit[0]) for unit in whole])
                held = held[whole[-1].end() :] if whole else held
                if len(whole) == len(units) - 1 and len(held) > self.window:
                    run, run_bytes, run_last, held = self.run_of(held[-1]), held.encode(), held[-1], ""
        if run is not None:
            yield packed(list(self.long_unit(run_bytes)) if len(run_bytes) > self.window else self.merges.merged(run_bytes))
        elif held:
            yield self.words(held)

    blanks = regex.compile(r"\s+")

    def run_of(self, character: str):
        """The pattern that a unit with this last character goes on with."""
        if character.isspace() and regex.fullmatch(r"\s", character):
            return self.blanks
        if regex.fullmatch(r"\p{L}", character):
            return regex.compile(r"\p{L}+")
        return regex.compile(r"\p{N}+") if regex.fullmatch(r"\p{N}", character) else self.symbols

    @staticmethod
    def boundary(text: str) -> int:
        """The last place where a single blank follows a non-blank and starts a word; 0 if none."""
        at = text.rfind(" ", 0, len(text) - 1)
        while at > 0 and (text[at + 1].isspace() or text[at - 1].isspace()):
            at = text.rfind(" ", 0, at)
        return max(at, 0)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, read piece by piece."""
        return np.frombuffer(self.encoded(text), dtype=ID).tolist()

    def encoded(self, text: str) -> bytes:
        """The same, packed."""
        if self.added is None or not (marks := list(self.added.finditer(text))):
            return self.run(text)
        out, start = [], 0
        for mark in marks:
            out += [self.run(text[start : mark.start()]), packed([self.merges.added[mark[0]]])]
            start = mark.end()
        return b"".join([*out, self.run(text[start:])])

    def run(self, text: str) -> bytes:
        return b"".join(self.emitted(text[at : at + PIECE] for at in range(0, len(text), PIECE)))


@functools.lru_cache(maxsize=2)
def transducer(digest: str, data: bytes) -> Transducer:
    """One for all tasks of a worker, so that what it remembers is kept."""
    return Transducer(loaded(digest, data))


class TextMachine:
    """Ids in, in pieces; text out as soon as its characters are complete."""

    def __init__(self, merges: MergeList):
        self.token_bytes, self.table = merges.token_bytes, merges.table
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.decoder.decode(b"".join(map(self.token_bytes.__getitem__, ids)), last)

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(pa.array(ids, pa.int32()), [len(ids)])[0]

    def decode_many(self, ids: pa.Array, counts: list[int]) -> list[str]:
        """The texts of runs of ids with so many each; their bytes are looked up together."""
        tokens = self.table.take(ids)
        if tokens.null_count:
            raise KeyError("an id that the vocabulary does not have")
        ends = np.frombuffer(tokens.buffers()[1], dtype=np.int64)[tokens.offset :]
        data = memoryview(tokens.buffers()[2] or b"")
        out, start, piece = [], 0, self.decoder.decode
        for count in counts:
            self.decoder.reset()
            cuts = [int(ends[at]) for at in (*range(start, start + count, PIECE), start + count)]
            out.append("".join([piece(data[a:b]) for a, b in pairwise(cuts)]) + piece(b"", True))
            start += count
        return out


def added_column(df: DataFrame, name: str, kind: T.DataType, start, make) -> DataFrame:
    """``df`` with a column made of another by a machine that each task starts once, a few megabytes at a time."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name]).add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = start()
        for batch in batches:
            for part in byte_slices(batch, LEARN_BYTES):
                columns = [part[f.name] for f in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, make(machine, part)], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_column: str = "text", ids_column: str = "token_ids") -> DataFrame:
    """``df`` with the ids of each text."""
    file = shipped_bytes(df.sparkSession, path)

    def make(machine: Transducer, part: pa.RecordBatch) -> pa.Array:
        texts = part[text_column].to_pylist()
        machine.learn(text for text in texts if text)
        found = [machine.encoded(text) if text else b"" for text in texts]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // ID.itemsize
        return pa.ListArray.from_arrays(ends.astype(np.int32), np.frombuffer(b"".join(found), dtype=ID))

    return added_column(df, ids_column, T.ArrayType(T.IntegerType()), lambda: transducer(file.digest, file.value), make)


def decode(df: DataFrame, path: str, ids_column: str = "token_ids", text_column: str = "decoded_text") -> DataFrame:
    """``df`` with the text of each list of ids; null ids are no ids."""
    file: ShippedFile = shipped_bytes(df.sparkSession, path)

    def make(machine: TextMachine, part: pa.RecordBatch) -> pa.Array:
        ids = part[ids_column]
        return pa.array(machine.decode_many(ids.flatten(), ids.value_lengths().fill_null(0).to_pylist()), pa.string())

    return added_column(df, text_column, T.StringType(), lambda: TextMachine(loaded(file.digest, file.value)), make)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    path = vocabulary()
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return decode(coded, path).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join("token_ids", ",")).alias("ids_sha256"),
        sha256_hex(F.col("decoded_text")).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe": op1_bpe}
