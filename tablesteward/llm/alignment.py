"""Aligning the tokens of two tokenizers over the same text.

**Units.** Both tokenizers let a word take its blank along and never join across
the place before it, so a text is cut before every blank between two non-blanks
and each distinct unit of a block of documents is tokenized once, many of them
in one text for the library. Units that begin or end with blanks, or hold the
second tokenizer's own mark for a blank, are tokenized alone.

**Spans.** The libraries' spans are coarse cuts: character offsets from the
first, byte spans from the second. Both put every part of a character that spans
several tokens (multibyte characters, byte fallback) at the whole character;
there the lengths of the tokens' decoded bytes refine the cuts. Places where
tokens of both sides end cut the text into groups; the two tokens that end there
are linked.

**Counts.** A block of documents is a row of its own with its distinct links,
their counts, and the links of each unit; a document keeps the numbers of its
units. Link counts are added up over all blocks, go back to the blocks that hold
the link, and are summed for each document there. What is shuffled is distinct
links per block and unit numbers, never one row per token. The highest count of
each id of the second side (a row per vocabulary entry at most) is broadcast.

Defined results: documents that are null, empty, or that one of the tokenizers
does not give back byte for byte have no tokens (zeros, empty digest) and count
nowhere; strings of special tokens are plain text; rows equal in every column
are documents of their own; an empty table gives no rows; columns other than id
and text are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteward.llm.batches import byte_slices, shipped_bytes, table, token_bytes_of_letters
from tablesteward.session import materialize, spread

# A cut before a blank between two non-blanks.
CUT = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the second tokenizer's mark for a blank.
BLANK_MARK = "▁"

# Characters of distinct units that the libraries get in one text, and texts they
# get at once; their answers take some hundred bytes a token.
TEXT_CHARS = 1 << 16
TEXTS = 2
# Bytes of documents whose units are numbered together.
BLOCK_BYTES = 8 << 20


class Side:
    """Decoded bytes of each id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.lengths = np.array([len(e) for e in entries], dtype=np.int64)
        self.partial = np.array([not whole_characters(e) for e in entries])

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))

    def ends(self, ids: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        """Byte ends: the coarse ones, refined in runs of tokens that are no whole characters."""
        partial = self.partial[ids]
        if not partial.any():
            return coarse
        total = np.cumsum(self.lengths[ids])
        last = np.maximum.accumulate(np.where(partial, -1, np.arange(len(ids))))
        known = last >= 0
        anchor = np.where(known, coarse[last] - total[last], 0)
        return np.where(partial, anchor + total, coarse)


def whole_characters(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class LetterSide(Side):
    """A byte-level BPE vocabulary with the character offsets of its library."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        size = self.library.get_vocab_size()
        super().__init__([token_bytes_of_letters(self.library.id_to_token(i)) for i in range(size)])

    def spans(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        for text, coded in zip(texts, self.library.encode_batch(texts, add_special_tokens=False), strict=True):
            points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            byte_at = np.concatenate([[0], np.cumsum(widths)])
            offsets = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)
            yield coded.ids, byte_at[offsets[:, 1]]


class PieceSide(Side):
    """A piece vocabulary with byte fallback and the byte spans of its library, which adds the leading blank."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        super().__init__(
            [
                bytes([int(piece[3:-1], 16)]) if self.library.is_byte(i) else piece.replace(BLANK_MARK, " ").encode()
                for i, piece in enumerate(pieces)
            ]
        )

    def spans(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        for coded in self.library.encode([text[1:] for text in texts], return_type="proto", num_threads=1):
            found = [(piece.id, piece.end) for piece in coded.pieces]
            yield [i for i, _ in found], np.array([end + 1 for _, end in found], dtype=np.int64)


@functools.lru_cache(maxsize=4)
def side(kind: type[Side], digest: str, data: bytes) -> Side:
    return kind(data)


@dataclass
class Aligned:
    """Units in order: tokens of both sides, whether they can be given back, groups, links."""

    whole: np.ndarray
    a_counts: np.ndarray
    b_counts: np.ndarray
    groups: list[str]
    links: np.ndarray  # first id << 32 | second id
    link_units: np.ndarray


class Aligner:
    def __init__(self, first: Side, second: Side):
        self.first, self.second = first, second

    def units(self, units: list[str]) -> Aligned:
        """The alignment of distinct units, each tokenized with a blank before it."""
        texts, members, together, chars = [], [], [], 0
        for at, unit in enumerate(units):
            if unit != unit.strip() or not unit or BLANK_MARK in unit:
                texts.append(" " + unit)
                members.append([at])
                continue
            together.append(at)
            chars += len(unit) + 1
            if chars >= TEXT_CHARS:
                texts.append("".join(" " + units[i] for i in together))
                members.append(together)
                together, chars = [], 0
        if together:
            texts.append("".join(" " + units[i] for i in together))
            members.append(together)
        count = len(units)
        whole, counts = np.zeros(count, dtype=bool), [np.zeros(count, dtype=np.int64) for _ in range(2)]
        groups, links, link_units = [""] * count, [], []
        for start in range(0, len(texts), TEXTS):
            part = texts[start : start + TEXTS]
            coded = zip(part, members[start : start + TEXTS], self.first.spans(part), self.second.spans(part), strict=True)
            for text, of, a, b in coded:
                self.place(units, text, of, a, b, whole, counts, groups, links, link_units)
        return Aligned(
            whole, *counts, groups,
            np.concatenate([np.zeros(0, dtype=np.int64), *links]), np.concatenate([np.zeros(0, dtype=np.int64), *link_units]),
        )

    def place(self, units, text, of, a, b, whole, counts, groups, links, link_units) -> None:
        data = text.encode()
        if self.first.joined(a[0]) != data or self.second.joined(b[0]) != data:
            for at in of if len(of) > 1 else ():  # only the units at fault have no tokens
                alone = [" " + units[at]]
                spans = next(self.first.spans(alone)), next(self.second.spans(alone))
                self.place(units, alone[0], [at], *spans, whole, counts, groups, links, link_units)
            return
        ids = [np.array(found[0], dtype=np.int64) for found in (a, b)]
        ends = [own.ends(i, found[1]) for own, i, found in zip((self.first, self.second), ids, (a, b), strict=True)]
        borders = np.cumsum([len(units[at].encode()) + 1 for at in of])
        both = [np.isin(ends[0], ends[1], assume_unique=True), np.isin(ends[1], ends[0], assume_unique=True)]
        common = ends[0][both[0]]
        last_group = np.searchsorted(common, borders)
        if not np.array_equal(common[last_group], borders):
            raise ValueError("a token crosses the blank before a word")
        of = np.array(of)
        whole[of] = True
        cuts = [np.searchsorted(e, borders, side="right") for e in ends]
        for count, cut in zip(counts, cuts, strict=True):
            count[of] = np.diff(cut, prepend=0)
        told = [list(map(str, found[0])) for found in (a, b)]
        a_cuts, b_cuts = (np.flatnonzero(m) + 1 for m in both)
        pieces, i, j = [], 0, 0
        for i_end, j_end in zip(a_cuts.tolist(), b_cuts.tolist(), strict=True):
            left = told[0][i] if i_end - i == 1 else ",".join(told[0][i:i_end])
            right = told[1][j] if j_end - j == 1 else ",".join(told[1][j:j_end])
            pieces.append(f"{left}|{right}")
            i, j = i_end, j_end
        start = 0
        for at, end in zip(of.tolist(), (last_group + 1).tolist(), strict=True):
            groups[at] = ";".join(pieces[start:end])
            start = end
        links.append(ids[0][both[0]] << 32 | ids[1][both[1]])
        link_units.append(of[np.searchsorted(borders, common)])


BLOCK_COLUMNS = (
    "block long, {id} {kind}, n_a long, n_b long, n_links long, groups_sha256 string, groups string, units binary, "
    "links array<long>, link_counts array<long>, unit_links binary, unit_ends binary"
)


def blocks(docs: DataFrame, first: str, second: str, id_column: str, text_column: str, keep_groups: bool) -> DataFrame:
    """Rows of documents, and one row per block with the links of its units."""
    spark = docs.sparkSession
    a, b = shipped_bytes(spark, first), shipped_bytes(spark, second)
    rows = docs.select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType
    names = [part.split()[0] for part in BLOCK_COLUMNS.format(id="doc", kind="x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(side(LetterSide, a.digest, a.value), side(PieceSide, b.digest, b.value))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in byte_slices(batch, BLOCK_BYTES):
                yield from block_rows(aligner, number, part)
                number += 1

    def block_rows(aligner: Aligner, number: int, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        numbers = []
        for text in part["text"].to_pylist():
            units = CUT.split(text) if text else []
            numbers.append(np.array([known.setdefault(u, len(known)) for u in units], dtype=np.uint32))
        found = aligner.units(list(known))
        flat = np.concatenate([np.zeros(0, dtype=np.uint32), *numbers])
        doc_of = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
        broken = np.bincount(doc_of, ~found.whole[flat], len(numbers)) > 0
        used = flat[~broken[doc_of]]
        numbers = [n if not bad else n[:0] for n, bad in zip(numbers, broken, strict=True)]
        unit_count = len(known)
        by_unit = np.argsort(found.link_units, kind="stable")
        links, codes = np.unique(found.links[by_unit], return_inverse=True)
        per_unit = np.bincount(found.link_units, minlength=unit_count).astype(np.int64)
        unit_of = found.link_units[by_unit]
        weight = np.bincount(used, minlength=unit_count)[unit_of]
        link_counts = np.bincount(codes, weight, len(links)).astype(np.int64)

        def summed(per: np.ndarray) -> list[int]:
            return [int(per[n].sum()) for n in numbers]

        groups = [";".join([found.groups[i] for i in n.tolist()]) for n in numbers]
        size = len(numbers)
        columns = {
            "block": pa.array([number] * size, pa.int64()), "doc": part["doc"],
            "n_a": summed(found.a_counts), "n_b": summed(found.b_counts), "n_links": summed(per_unit),
            "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
            "groups": pa.array(groups if keep_groups else [None] * size, pa.string()),
            "units": pa.array([n.tobytes() for n in numbers], pa.binary()),
        }
        yield from filled(columns, size)
        yield from filled(
            {
                "block": pa.array([number], pa.int64()), "links": pa.array([links], pa.list_(pa.int64())),
                "link_counts": pa.array([link_counts], pa.list_(pa.int64())),
                "unit_links": pa.array([codes.astype(np.uint32).tobytes()], pa.binary()),
                "unit_ends": pa.array([np.cumsum(per_unit).astype(np.uint32).tobytes()], pa.binary()),
            },
            1,
        )

    def filled(columns: dict, size: int) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        made = [
            (columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)).cast(f.type)
            if f.name in columns
            else pa.nulls(size, f.type)
            for f in arrow
        ]
        yield pa.RecordBatch.from_arrays(made, schema=arrow)

    empty = spark.createDataFrame([], BLOCK_COLUMNS.format(id="doc", kind=kind.simpleString()))
    schema = empty.schema
    return spread(rows).mapInArrow(run, schema).select(*names)


def counted(kept: DataFrame) -> DataFrame:
    """``of_block, at, count, best`` for each distinct link of each block: its count over all blocks."""
    held = kept.where(F.col("links").isNotNull()).select("block", F.posexplode(F.arrays_zip("links", "link_counts")).alias("at", "it"))
    held = held.select("block", "at", F.col("it.links").alias("link"), F.col("it.link_counts").alias("n"))
    totals = held.groupBy("link").agg(F.sum("n").alias("count"))
    second = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    # one row per entry of the second vocabulary at most
    highest = totals.groupBy(second.alias("second")).agg(F.max("count").alias("highest"))
    told = totals.join(F.broadcast(highest), second == F.col("second")).select("link", "count", (F.col("count") == F.col("highest")).alias("best"))
    return held.join(told, "link").select(F.col("block").alias("of_block"), "at", "count", "best")


def aligned(
    docs: DataFrame, first: str, second: str, id_column: str = "doc_id", text_column: str = "text", keep_groups: bool = False
) -> DataFrame:
    """``<id>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups`` for each row.

    ``groups`` (``a1,a2|b1;a3|b2``: ids of both sides in order) is null unless asked for.
    """
    kept = materialize(blocks(docs, first, second, id_column, text_column, keep_groups), "alignment-blocks")
    plain = ["doc", "n_a", "n_b", "n_links", "groups_sha256", "groups"]
    kind = kept.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, n_a long, n_b long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"

    def sums(rows: pa.Table, counts: pa.Table) -> pa.Table:
        is_block = pc.is_valid(rows["unit_ends"])
        own = rows.filter(is_block)
        docs_of = rows.filter(pc.invert(is_block))
        unit_links = np.frombuffer(own["unit_links"][0].as_py(), dtype=np.uint32)
        unit_ends = np.frombuffer(own["unit_ends"][0].as_py(), dtype=np.uint32).astype(np.int64)
        per_link = [np.zeros(counts.num_rows, dtype=np.int64) for _ in range(2)]
        at = counts["at"].to_numpy()
        per_link[0][at] = counts["best"].to_numpy()
        per_link[1][at] = counts["count"].to_numpy()
        per_unit = []
        for values in per_link:
            running = np.concatenate([[0], np.cumsum(values[unit_links])])
            per_unit.append(running[unit_ends] - running[np.concatenate([[0], unit_ends[:-1]])] if len(unit_ends) else running[:0])
        out = [[], []]
        for data in docs_of["units"].to_pylist():
            units = np.frombuffer(data, dtype=np.uint32)
            for values, made in zip(per_unit, out, strict=True):
                made.append(int(values[units].sum()))
        columns = [docs_of[name] for name in plain]
        return pa.table([*columns, *(pa.array(o, pa.int64()) for o in out)], names=[*plain, "n_best", "count_sum"])

    rows = kept.select("block", *plain, "units", "unit_links", "unit_ends").groupBy("block")
    found = rows.cogroup(counted(kept).groupBy("of_block")).applyInArrow(sums, schema)
    return found.select(
        F.col("doc").alias(id_column), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum",
        "groups_sha256", "groups",
    )


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), *vocabularies()).drop("groups")


QUERIES = {"op11_alignment": op11_alignment}
