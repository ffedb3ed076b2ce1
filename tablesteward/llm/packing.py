"""Packing documents into windows of equal length by bounded-space online packing.

A partition keeps ``OPEN_WINDOWS`` open windows. Whole windows are cut off long
documents; what is left goes into the fullest open window that has room for it
(best fit). Where none has, a new window is opened while there are fewer than
that; else the fullest one is topped up with the beginning of the piece, if its
gap is worth a cut, and emitted. Windows still open at the end of a partition
are its leftovers. They are packed again in the same way, ``FAN_IN`` partitions
at a time, until one partition is left; its last windows are poured into one
another, and the tail becomes windows whose lengths are powers of two, which need
no padding. Leftovers are bounded by the open windows of a partition, so each
round reads a small part of the one before.

Windows depend on the rows of a partition and their order only, and each round
is written once, so that a lost executor repeats its own partitions alike.

Ids come from the tokenizers library, which gets each distinct part of a text
once: parts between blanks, and units within them, are independent in this
vocabulary. Units of characters that stand alone go straight to the library's
merges; what it makes of such a character, it is asked once.

Defined results: a null text is an empty one; every document ends with the end
id, so each has a piece at least; rows equal in every column are documents of
their own; a text of any length is read whole; an empty table gives no rows;
columns other than id and text are not looked at.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablesteward.llm.batches import byte_slices, shipped_bytes, table
from tablesteward.session import materialize, spread

# Production settings: tokens of a window, open windows of a partition, the
# smallest gap that a piece is cut for, partitions packed again together.
WINDOW = 2048
OPEN_WINDOWS = 64
LEAST_GAP = 16
FAN_IN = 16
END_ID = 1

# How special tokens of the vocabulary begin, and the letters after an
# apostrophe that make a unit with it.
SPECIAL_START = "<|"
APOSTROPHE_UNITS = ("s", "t", "m", "d", "re", "ve", "ll")

# What a character is in the vocabulary's units: runs of letters, runs of marks, single
# digits. OTHER is what may depend on its neighbours or is a blank to the vocabulary.
UNKNOWN, LETTER, MARK, DIGIT, OTHER = range(5)
LAST_BASIC = 0xFFFF
JAMO = range(0x1100, 0x1200)

# Distinct words cut at once, characters of distinct parts that the library gets in
# one text, and parts whose ids a worker remembers.
BLOCK_WORDS = 1 << 16
TEXT_CHARS = 1 << 16
REMEMBERED = 1 << 19
CODE = np.dtype("<u4")
ID = np.dtype("<u4")
ID_BYTES = ID.itemsize

PIECE_COLUMNS = ("start", "length", "ids", "doc_tokens", "window", "offset")


class Characters:
    """What the library makes of single characters, asked once for each.

    Known are characters that normalizing leaves alone beside any others of
    them: none combines, and each is folded to one character.
    """

    def __init__(self, library):
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.kinds = np.full(sys.maxunicode + 1, UNKNOWN, dtype=np.uint8)
        self.folded = np.arange(sys.maxunicode + 1, dtype=CODE)
        self.spelled: dict[int, str] = {}  # folded characters as the vocabulary spells their bytes

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The kind of each character."""
        kinds = self.kinds[codes]
        unknown = np.unique(codes[kinds == UNKNOWN]).tolist()
        for code in unknown:
            self.kinds[code] = self.ask(code)
        return self.kinds[codes] if unknown else kinds

    def ask(self, code: int) -> int:
        if not stands_alone(chr(code)):
            return OTHER
        folded = self.normalizer.normalize_str(chr(code))
        if len(folded) != 1 or not stands_alone(folded) or self.normalizer.normalize_str(folded) != folded:
            return OTHER
        letters, marks = (
            [piece for piece, _ in self.pre_tokenizer.pre_tokenize_str(beside + folded + beside)] for beside in ("a", "!")
        )
        if len(letters) == 1:
            kind, spelled = LETTER, letters[0][1:-1]
        elif len(marks) == 1:
            kind, spelled = MARK, marks[0][1:-1]
        elif len(letters) == len(marks) == 3:
            kind, spelled = DIGIT, letters[1]
        else:
            return OTHER
        self.folded[code], self.spelled[ord(folded)] = ord(folded), spelled
        return kind


def stands_alone(character: str) -> bool:
    """Whether a character is a letter, number, mark or symbol that is never composed with one before or after it."""
    code = ord(character)
    return (
        code <= LAST_BASIC
        and code not in JAMO
        and unicodedata.category(character)[0] in "LNPS"
        and unicodedata.combining(character) == 0
        and unicodedata.is_normalized("NFC", character)
    )


class Known(dict):
    """Numbers of parts, in the order they are met."""

    def __missing__(self, part: str) -> int:
        at = self[part] = len(self)
        return at


class Words:
    """Ids of whole texts by the ids of their distinct parts.

    A text is cut at blanks, and words of known characters into the
    vocabulary's own units, which need the library's merges only. Of other
    words, which may be composed first or hold special tokens, only a tail of
    marks is cut off; they go through the whole library. The ids of parts are
    remembered, a bounded number.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = self.library.model
        self.characters = Characters(self.library)
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.flat, self.starts = np.zeros(0, dtype=ID), np.zeros(1, dtype=np.int64)

    def encoded(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        flat, starts = self.of_words(coded.dictionary)
        tokens, counts = gathered(flat, starts, coded.indices.to_numpy(zero_copy_only=False))
        word_ends = np.cumsum(pc.list_value_length(words).to_numpy())
        ends = np.concatenate([[0], np.cumsum(counts)])[word_ends]
        sizes = np.diff(ends, prepend=0)
        nth = np.arange(len(ends))
        out = np.empty(len(tokens) + len(ends), dtype=ID)
        out[np.arange(len(tokens)) + np.repeat(nth, sizes)] = tokens
        out[ends + nth] = end_id
        return np.split(out, (ends + nth + 1)[:-1]) if len(ends) else []

    def of_words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's begin."""
        blocks = [self.of_block(words.slice(at, BLOCK_WORDS)) for at in range(0, len(words), BLOCK_WORDS)]
        flat, sizes = zip(*blocks, strict=True) if blocks else ([np.zeros(0, dtype=ID)], [np.zeros(0, dtype=np.int64)])
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def of_block(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and their number in each word."""
        if len(self.known) > REMEMBERED:
            self.forget()
        parts, are_units, word_parts = cut_words(words, self.characters)
        coded = parts.dictionary_encode()
        distinct, nth = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[nth]
        single = np.zeros(len(self.known), dtype=bool)
        single[at] = are_units
        self.learn(list(islice(self.known, before, None)), single[before:].tolist())
        flat, sizes = gathered(self.flat, self.starts, at)
        return flat, np.diff(np.concatenate([[0], np.cumsum(sizes)])[word_parts])

    def learn(self, parts: list[str], are_units: list[bool]) -> None:
        """Ids of parts not met before: units are merged one by one, others are told apart by offsets."""
        if not parts:
            return
        flat, counts, spelled = [], [], self.characters.spelled
        for part in compress(parts, are_units):
            merged = self.merges.tokenize(part if part.isascii() else part.translate(spelled))
            flat += [token.id for token in merged]
            counts.append(len(merged))
        ids, sizes = [np.array(flat, dtype=ID)], [np.array(counts, dtype=np.int64)]
        for group in grouped([part for part, is_unit in zip(parts, are_units, strict=True) if not is_unit]):
            coded = self.library.encode(" ".join(group), add_special_tokens=False)
            borders = np.cumsum([len(part) + 1 for part in group])
            first = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            ids.append(np.array(coded.ids, dtype=ID))
            sizes.append(np.bincount(np.searchsorted(borders, first, side="right"), minlength=len(group)))
        order = np.argsort(~np.array(are_units), kind="stable")
        ids, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        ids, sizes = gathered(ids, starts, np.argsort(order))
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])


def cut_words(words: pa.LargeStringArray, characters: Characters) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """Parts of words without blanks, whether each is one unit, and the number of parts before each word."""
    sizes = pc.utf8_length(words).to_numpy()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    starts, ends, size = bounds[:-1], bounds[1:], int(bounds[-1])
    codes = np.frombuffer("".join(words.to_numpy(zero_copy_only=False)).encode("utf-32-le"), dtype=CODE)
    kinds = characters.of(codes)
    folded = characters.folded[codes]
    first = np.zeros(size + 1, dtype=bool)
    first[bounds] = True

    # Units: runs of one kind, single digits, and an apostrophe with certain letters.
    cut = first.copy()
    cut[1:size] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
    at, units = apostrophe_units(folded, kinds, first, ends)
    cut[at + 1] = False
    cut[at + units] = True

    # Words with other characters are one part, but for a tail of marks after a letter.
    special = np.zeros(size, dtype=bool)
    special[:-1] = (codes[:-1] == ord(SPECIAL_START[0])) & (codes[1:] == ord(SPECIAL_START[1]))
    special_words, other_words = (
        np.diff(np.concatenate([[0], np.cumsum(found)])[bounds]) > 0 for found in (special, special | (kinds == OTHER))
    )
    in_other = np.repeat(other_words, sizes)
    cut[:size] = np.where(in_other, first[:size], cut[:size])
    with_tail = np.flatnonzero(other_words & ~special_words)
    before = np.maximum.accumulate(np.where(kinds == MARK, -1, np.arange(size)))[ends[with_tail] - 1]
    tails = before[(before >= starts[with_tail]) & (before + 1 < ends[with_tail]) & (kinds[before] == LETTER)] + 1
    cut[tails] = True

    part_starts = np.flatnonzero(cut[:size])
    part_ends = np.append(part_starts[1:], size)[: len(part_starts)]
    are_units = ~in_other[part_starts]
    are_units[np.searchsorted(part_starts, tails)] = True
    codes = np.where(np.repeat(are_units, part_ends - part_starts), folded, codes)
    return strings(codes, np.append(part_starts, size)), are_units, np.concatenate([[0], np.cumsum(cut[:size])])[bounds]


def strings(codes: np.ndarray, bounds: np.ndarray) -> pa.LargeStringArray:
    """The runs of characters between bounds."""
    widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes > LAST_BASIC)
    offsets = np.concatenate([[0], np.cumsum(widths)])[bounds]
    data = codes.tobytes().decode("utf-32-le").encode()
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def apostrophe_units(folded: np.ndarray, kinds: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an apostrophe that no mark of its word precedes begins a unit with letters, and the unit's length."""
    after_mark = np.zeros(len(kinds), dtype=bool)
    after_mark[1:] = (kinds[:-1] == MARK) & ~first[1:-1]
    at = np.flatnonzero((folded == ord("'")) & ~after_mark)
    room = ends[np.searchsorted(ends, at, side="right")] - at
    padded = np.concatenate([folded, np.zeros(2, dtype=CODE)])
    lengths = np.ones(len(at), dtype=np.int64)
    for letters in APOSTROPHE_UNITS:
        same = room > len(letters)
        for nth, letter in enumerate(letters, 1):
            same &= padded[at + nth] == ord(letter)
        lengths[same] = len(letters) + 1
    return at[lengths > 1], lengths[lengths > 1]


def grouped(parts: list[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for part in parts:
        group.append(part)
        chars += len(part) + 1
        if chars >= TEXT_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def gathered(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[i]:starts[i + 1]]`` for all i, one after the other, and their lengths."""
    sizes = starts[at + 1] - starts[at]
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(at) else 0)], sizes


@functools.lru_cache(maxsize=2)
def words_of(digest: str, data: bytes) -> Words:
    return Words(data)


class Piece(tuple):
    """``(doc, start, ids, doc_tokens)``."""

    def cut(self, length: int) -> tuple[Piece, Piece]:
        doc, start, ids, doc_tokens = self
        return Piece((doc, start, ids[:length], doc_tokens)), Piece((doc, start + length, ids[length:], doc_tokens))


Item = list  # pieces that stay together until they are cut


def tokens_of(item: Item) -> int:
    return sum(len(piece[2]) for piece in item)


def cut_item(item: Item, length: int) -> tuple[Item, Item]:
    head = []
    for at, piece in enumerate(item):
        size = len(piece[2])
        if size > length:
            if not length:
                return head, item[at:]
            first, rest = piece.cut(length)
            return [*head, first], [rest, *item[at + 1 :]]
        head.append(piece)
        length -= size
    return head, []


class Packer:
    """Items in, one at a time; full windows out."""

    def __init__(self, window: int, open_windows: int, least_gap: int):
        self.window, self.open_windows, self.least_gap = window, open_windows, least_gap
        self.rooms: list[tuple[int, int]] = []  # free tokens of each open window, smallest first
        self.open: dict[int, Item] = {}
        self.opened = 0

    def add(self, item: Item) -> Iterator[Item]:
        size = tokens_of(item)
        while size >= self.window:
            full, item = cut_item(item, self.window)
            size -= self.window
            yield full
        while size:
            at = bisect_left(self.rooms, (size, -1))
            if at < len(self.rooms):
                room, number = self.rooms.pop(at)
                self.open[number] += item
                if room == size:
                    yield self.open.pop(number)
                else:
                    insort(self.rooms, (room - size, number))
                return
            if len(self.open) < self.open_windows:
                insort(self.rooms, (self.window - size, self.opened))
                self.open[self.opened] = list(item)
                self.opened += 1
                return
            room, number = self.rooms.pop(0)
            fullest = self.open.pop(number)
            if room >= self.least_gap:
                head, item = cut_item(item, room)
                fullest += head
                size -= room
            yield fullest

    def leftovers(self) -> Iterator[Item]:
        yield from self.open.values()

    def poured(self) -> Iterator[Item]:
        """The open windows as full ones, and a tail of powers of two."""
        item, size = [], 0
        for own in self.open.values():
            item, size = item + own, size + tokens_of(own)
            if size >= self.window:
                full, item = cut_item(item, self.window)
                size -= self.window
                yield full
        while size:
            part = 1 << (size.bit_length() - 1)
            head, item = cut_item(item, part)
            size -= part
            yield head


class Rows:
    """Windows as rows of pieces, a batch at a time."""

    def __init__(self, schema: pa.Schema, prefix: int, batch_bytes: int = 4 << 20):
        self.schema, self.prefix, self.batch_bytes = schema, prefix, batch_bytes
        self.windows = 0
        self.clear()

    def clear(self) -> None:
        self.rows, self.bytes = [[] for _ in self.schema], 0

    def add(self, item: Item, partition: int, closed: bool) -> Iterator[pa.RecordBatch]:
        offset, window = 0, self.prefix + self.windows
        self.windows += 1
        for doc, start, ids, doc_tokens in item:
            row = (doc, start, len(ids), ids.tobytes(), doc_tokens, window, offset, partition, closed)
            for column, value in zip(self.rows, row, strict=True):
                column.append(value)
            offset += len(ids)
            self.bytes += len(ids) * ID_BYTES
        if self.bytes >= self.batch_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(self.rows, self.schema, strict=True)], schema=self.schema
            )
        self.clear()


def piece_schema(docs: DataFrame, id_column: str):
    kind = docs.select(F.col(id_column).alias("doc")).schema
    rest = "start long, length long, ids binary, doc_tokens long, window long, offset long, partition int, closed boolean"
    return T.StructType([*kind.fields, *T.StructType.fromDDL(rest).fields])


def first_round(docs: DataFrame, path: str, id_column: str, text_column: str, settings: tuple) -> DataFrame:
    """Pieces of full windows (``closed``) and of each partition's leftovers."""
    file = shipped_bytes(docs.sparkSession, path)
    schema = piece_schema(docs, id_column)
    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = words_of(file.digest, file.value), Packer(*settings)
        partition = TaskContext.get().partitionId()
        out = Rows(arrow, partition << 32)
        for batch in batches:
            for part in byte_slices(batch):
                for doc, ids in zip(part["doc"].to_pylist(), words.encoded(part["text"], END_ID), strict=True):
                    for full in packer.add([Piece((doc, 0, ids, len(ids)))]):
                        yield from out.add(full, partition, True)
        for left in packer.leftovers():
            yield from out.add(left, partition, False)
        yield from out.flush()

    return spread(rows).mapInArrow(run, schema)


def next_round(leftovers: DataFrame, level: int, last: bool, settings: tuple) -> DataFrame:
    """Leftover windows of ``FAN_IN`` partitions packed together; the last round leaves none open."""
    schema = leftovers.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, window, item, packer, out = None, None, [], None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if packer is None:
                return
            for full in packer.add(item):
                yield from out.add(full, partition, True)
            for left in packer.poured() if last else packer.leftovers():
                yield from out.add(left, partition, last)
            yield from out.flush()

        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("partition", "window", "doc", "start", "ids", "doc_tokens")]
            for own, of, doc, start, ids, doc_tokens in zip(*columns, strict=True):
                if own != partition:
                    yield from finish()
                    partition, window, item, packer = own, None, [], Packer(*settings)
                    out = Rows(arrow, level << 56 | own << 32)
                if of != window and item:
                    for full in packer.add(item):
                        yield from out.add(full, partition, True)
                    item = []
                window = of
                item.append(Piece((doc, start, np.frombuffer(ids, dtype=ID), doc_tokens)))
        yield from finish()

    together = leftovers.withColumn("partition", F.floor(F.col("partition") / FAN_IN).cast("int"))
    return together.repartition("partition").sortWithinPartitions("partition", "window", "offset").mapInArrow(run, schema)


def packed(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    least_gap: int = LEAST_GAP,
) -> DataFrame:
    """A row per piece: ``<id>, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers; a
    sequence's pieces in the order of ``offset`` are its ids.
    """
    settings = (window, open_windows, least_gap)
    level, rows = 0, materialize(first_round(docs, path, id_column, text_column, settings), "packing-level0")
    done = rows.where("closed")
    partitions = (rows.agg(F.max("partition")).first()[0] or 0) + 1
    while True:
        level, partitions = level + 1, -(-partitions // FAN_IN)
        rows = materialize(next_round(rows.where("not closed"), level, partitions == 1, settings), f"packing-level{level}")
        done = done.union(rows.where("closed"))
        if partitions == 1:
            break
    return done.select(F.col("doc").alias(id_column), *PIECE_COLUMNS).withColumnRenamed("window", "sequence_id")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op12_packing": op12_packing}
