"""Language identification as inference of a mixture of languages.

Learning counts hashed byte trigrams of each language over all training
documents. A document is taken as a mixture of the languages' trigram
distributions; expectation-maximisation estimates the proportions. Sets of
languages are compared by likelihood less a penalty for each further language,
so that chance trigrams do not add one. The prediction is the language of the
largest proportion in the chosen set, the score that proportion.

The model is one column of ``GRAMS`` floats for each language; its size depends
on the number of languages alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
rows without text or language teach nothing; a null id counts as an empty text
in the split; without anything learned every text is ``und``; equal proportions
go to the language that sorts first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.llm.batches import as_bytes, byte_slices, map_columns, table

UNKNOWN = "und"
# Fixed split of the query: remainders of the id's checksum that are held out.
FOLDS, HELD_OUT = 4, 2

# Production settings: hashed trigrams, smoothing, rounds, and what a further
# language must add to the log likelihood, as a share of it.
GRAM_BITS = 15
GRAMS = 1 << GRAM_BITS
SMOOTHING = 0.5
ROUNDS = 25
LEAST_SHARE = 0.03
PENALTY = 8.0
LANGUAGES_AT_ONCE = 64

KEPT = np.full(256, 32, dtype=np.uint8)
KEPT[65:91] = KEPT[97:123] = np.arange(97, 123)
KEPT[128:] = np.arange(128, 256)
FLAT = bytes(KEPT)


def trigrams(text: bytes) -> np.ndarray:
    """Hashed trigrams of letters and single blanks."""
    flat = b" " + b" ".join(text.translate(FLAT).split()) + b" "
    letters = np.frombuffer(flat, dtype=np.uint8).astype(np.uint32)
    packed = letters[:-2] << 16 | letters[1:-1] << 8 | letters[2:]
    return (packed * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    flat = text.translate(FLAT)
    return any(97 <= byte < 123 for byte in flat[:64]) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def fold_of(identity: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")), F.lit(0)) % folds


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over ``lang, text`` rows; each task adds up before it sends."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def told(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in sums.items():
            grams = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(counts[grams])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in byte_slices(batch):
                for lang, text in zip(part["lang"].to_pylist(), as_bytes(part["text"]), strict=True):
                    if lang not in sums:
                        if len(sums) >= LANGUAGES_AT_ONCE:
                            yield from told(sums)
                        sums[lang] = np.zeros(GRAMS, dtype=np.int64)
                    sums[lang] += np.bincount(trigrams(text), minlength=GRAMS)
        yield from told(sums)

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram int, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages in order and their trigram probabilities, one column each."""
    rows = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")).dropna()
    packed = gram_counts(rows).groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams")).toArrow()
    columns = {}
    for lang, grams in zip(packed["lang"].to_pylist(), packed["grams"].combine_chunks(), strict=True):
        pairs = grams.values
        counts = np.full(GRAMS, SMOOTHING)
        counts[np.asarray(pairs.field("gram"))] += np.asarray(pairs.field("n"))
        columns[lang] = (counts / counts.sum()).astype(np.float32)
    names = sorted(columns)
    return names, np.stack([columns[n] for n in names], axis=1) if names else np.zeros((GRAMS, 0), dtype=np.float32)


def proportions(likely: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: the mixture's proportions and its log likelihood."""
    total, shares = counts.sum(), start
    for _ in range(ROUNDS):
        mixed = likely @ shares
        after = shares * (likely.T @ (counts / mixed)) / total
        if np.abs(after - shares).max() < 1e-3:
            shares = after
            break
        shares = after
    return shares, float(counts @ np.log(likely @ shares))


def inferred(text: bytes, model: np.ndarray) -> tuple[int, float]:
    """The column of the main language and its proportion in the chosen set."""
    times = np.bincount(trigrams(text), minlength=GRAMS)
    grams = np.flatnonzero(times)
    counts, likely = times[grams].astype(np.float64), model[grams].astype(np.float64)
    languages = likely.shape[1]
    shares, _ = proportions(likely, counts, np.full(languages, 1.0 / languages))
    order = np.argsort(-shares, kind="stable")
    alone = counts @ np.log(likely)
    first = int(np.argmax(alone))
    best_set, best_shares, best = [first], np.ones(1), float(alone[first])
    price = PENALTY * np.log(counts.sum() + 1.0)
    chosen = [first]
    for lang in order:
        if lang == first:
            continue
        if shares[lang] < LEAST_SHARE:
            break
        chosen = [*chosen, int(lang)]
        own, value = proportions(likely[:, chosen], counts, np.full(len(chosen), 1.0 / len(chosen)))
        value -= price * (len(chosen) - 1)
        if value > best:
            best_set, best_shares, best = chosen, own, value
    top = min(range(len(best_set)), key=lambda i: (-best_shares[i], best_set[i]))
    return best_set[top], float(min(best_shares[top], 1.0))


def predicted(docs: DataFrame, names: list[str], model: np.ndarray, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of the text; columns that had these names give way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [f for f in docs.schema.fields if f.name not in (text_column, "lang_pred", "score")]
    schema = T.StructType([*others, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batch) -> dict:
        found = []
        for text in as_bytes(batch[text_column]):
            if not names or not has_letter(text):
                found.append((UNKNOWN, 0.0))
                continue
            at, score = inferred(text, shared.value)
            found.append((names[at], score))
        own = {f.name: batch[f.name] for f in others}
        return own | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_columns(docs, run, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), FOLDS) == HELD_OUT
    names, model = learned(docs.where(~held_out))
    return predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), names, model)


QUERIES = {"op9_language_id": op9_language_id}
