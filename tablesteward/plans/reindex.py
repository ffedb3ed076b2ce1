"""The whole index job: profile tables, find changes, embed, upsert, prune."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteward.functions.vectors import DIMENSIONS, DOCUMENT_INSTRUCTION, Embedder, embed_column
from tablesteward.operators.cardindex import prune, pruned_count, stale_cards, upsert
from tablesteward.operators.cards import collect_cards
from tablesteward.operators.profile import SAMPLE_ROWS
from tablesteward.session import materialize
from tablesteward.sources.partitions import PartitionedTable
from tablesteward.sources.snapshots import SnapshotTable
from tablesteward.sources.tables import TableRef


@dataclass(frozen=True)
class ReindexReport:
    tables: int
    skipped: int
    written: int
    pruned: int
    cards: DataFrame | None


def reindex(
    spark: SparkSession,
    refs: list[TableRef],
    store: SnapshotTable | PartitionedTable,
    embedder: Embedder,
    model: str,
    dimensions: int = DIMENSIONS,
    sample: int = SAMPLE_ROWS,
    force: bool = False,
    prune_missing: bool = False,
    dry_run: bool = False,
) -> ReindexReport:
    """Bring the stored index up to date with the tables.

    Only changed cards are embedded, and of a partitioned store only their
    partitions are written. A dry run returns the cards and writes
    nothing; no tables means nothing to do. Pruning compares with all tables of
    this run, so it is off unless asked for.
    """
    if not refs:
        return ReindexReport(0, 0, 0, 0, None)
    if dry_run:
        return ReindexReport(len(refs), 0, 0, 0, collect_cards(spark, refs, sample))
    # Written once: the diff, the embedding and the prune all read the cards.
    cards = materialize(collect_cards(spark, refs, sample), "cards")
    index = store.read()
    stale = cards if index is None else stale_cards(cards, index, model, dimensions, force)
    fresh = materialize(
        embed_column(stale, "embed_text", "embedding", embedder, DOCUMENT_INSTRUCTION, dimensions).select(
            "*",
            F.lit(model).alias("embedding_model"),
            F.lit(dimensions).alias("embedding_dimensions"),
            F.current_timestamp().alias("indexed_at"),
        ),
        "fresh-cards",
    )
    written = fresh.count()
    updated, removed = (fresh, 0) if index is None else (upsert(index, fresh), 0)
    if prune_missing and index is not None:
        removed = pruned_count(index, cards).first()[0]
        updated = prune(updated, cards)
    if written or removed or index is None:
        if isinstance(store, PartitionedTable):
            gone = index.select("doc_id").join(cards.select("doc_id"), "doc_id", "left_anti") if removed else None
            store.change(fresh, gone)
        else:
            store.write(updated)
    return ReindexReport(len(refs), len(refs) - written, written, removed, cards)
