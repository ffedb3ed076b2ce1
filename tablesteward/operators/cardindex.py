"""Keeping an index of cards up to date: what changed, upsert, prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_hashes(index: DataFrame, model: str, dimensions: int) -> DataFrame:
    """``doc_id, known_hash`` of entries made by this model at this width."""
    return index.where((F.col("embedding_model") == model) & (F.col("embedding_dimensions") == dimensions)).select(
        "doc_id", F.col("content_hash").alias("known_hash")
    )


def index_diff(cards: DataFrame, index: DataFrame, model: str, dimensions: int) -> DataFrame:
    """``doc_id, change`` for every card or index entry.

    ``new`` has no entry, ``changed`` an entry with another hash, model or
    width, ``unchanged`` needs no work, ``removed`` is no longer live.
    """
    current = (F.col("embedding_model") == model) & (F.col("embedding_dimensions") == dimensions)
    entries = index.select("doc_id", F.when(current, F.col("content_hash")).alias("known_hash"), F.lit(True).alias("entry"))
    live = cards.select("doc_id", "content_hash", F.lit(True).alias("live"))
    change = (
        F.when(F.col("live").isNull(), F.lit("removed"))
        .when(F.col("entry").isNull(), F.lit("new"))
        .when(F.col("content_hash").eqNullSafe(F.col("known_hash")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return live.join(entries, "doc_id", "full_outer").select("doc_id", change.alias("change"))


def stale_cards(cards: DataFrame, index: DataFrame, model: str, dimensions: int, force: bool = False) -> DataFrame:
    """The cards that must be embedded again; with ``force`` all of them."""
    if force:
        return cards
    known = known_hashes(index, model, dimensions)
    same = (cards["doc_id"] == known["doc_id"]) & (cards["content_hash"] == known["known_hash"])
    return cards.join(known, same, "left_anti")


def upsert(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """``index`` with whole rows replaced or added by ``doc_id``."""
    kept = index.join(fresh.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def prune(index: DataFrame, live: DataFrame) -> DataFrame:
    """Only the entries whose ``doc_id`` is among all cards of this run."""
    return index.join(live.select("doc_id"), "doc_id", "left_semi")


def pruned_count(index: DataFrame, live: DataFrame) -> DataFrame:
    """One row: how many entries ``prune`` removes."""
    return index.join(live.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("pruned"))
