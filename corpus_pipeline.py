"""A training corpus out of raw documents, in stages that are each written and read again.

Quality rules reject documents and cut frequent lines, one document of each
near-duplicate group stays, personal data is redacted, sources are mixed to
target weights, and the mix is encoded. A document that the mix takes more than
once is a row for each copy. Nulls, empty and repeated rows, ties and empty
tables are treated as the operators say; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteward.llm import bpe, mixing, pii, quality, simhash
from tablesteward.llm.batches import table
from tablesteward.session import materialize


def recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it is now, where there is such a column."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit are cut out of the others."""
    return recounted(quality.clean_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets."""
    return recounted(pii.redact_documents(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and the digests of ids and of the text that they decode to."""
    path = bpe.vocabulary()
    coded = bpe.decode(bpe.encode(docs, path).drop("text", "n_chars"), path)
    ids = F.array_join("token_ids", ",")
    return coded.select(
        "doc_id", "lang", "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("encoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
