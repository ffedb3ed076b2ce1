"""The session event log: latest events, state, previews, listings, purge.

An event row has ``app_name, user_id, session_id, event_id, ts, arrival,
author, partial, compaction, texts array<string>, state_delta map<string,string>``
(state values are JSON text). ``arrival`` orders repeated sends of one event.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesteward.functions.statekeys import is_saved
from tablesteward.functions.text import message_preview
from tablesteward.session import materialize, setting

SESSION = ["app_name", "user_id", "session_id"]
# Default of spark.sql.optimizer.windowGroupLimitThreshold, and slices above it.
WINDOW_LIMIT, SLICES = 1000, 64
PARTITIONS, SPLITS = "spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum"
# Rows that a task sorts, few enough for its memory.
ROWS_PER_TASK = 250_000


def event_log(events: DataFrame) -> DataFrame:
    """Events as stored: partial ones dropped, a re-sent id replaced.

    The rank limit is applied before the shuffle too, so many copies of one
    event do not meet in one task.
    """
    newest = W.partitionBy(*SESSION, "event_id").orderBy(F.desc("arrival"), F.desc("ts"))
    return (
        events.where(~F.col("partial")).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
    )


def create_sessions(requests: DataFrame) -> DataFrame:
    """Session rows from ``app_name, user_id, session_id?, seq, state, created_at``.

    A missing id is derived from app, user and ``seq``, so a retry gives the
    same one. Null state values are dropped, as they are on every read.
    """
    made = F.sha2(F.concat_ws("\x00", "app_name", "user_id", F.col("seq").cast("string")), 256)
    known = F.when(F.coalesce("session_id", F.lit("")) != "", F.col("session_id"))
    return requests.select(
        "app_name",
        "user_id",
        F.coalesce(known, F.substring(made, 1, 32)).alias("session_id"),
        F.map_filter("state", lambda _, value: value.isNotNull()).alias("state"),
        F.col("created_at").alias("last_update_time"),
    )


def state_changes(events: DataFrame) -> DataFrame:
    """One row per saved key of each delta: ``key, value, ts, event_id, arrival``."""
    stored = events.where(~F.col("partial"))
    return stored.select(*SESSION, "ts", "event_id", "arrival", F.explode("state_delta")).where(is_saved(F.col("key")))


def latest_by_key(changes: DataFrame) -> DataFrame:
    """The last write of every session key; a null value is a tombstone.

    ``max_by`` combines within each task first and is the same in any order, so
    results of batches can be folded again with it.
    """
    at = F.struct("ts", "event_id", "arrival")
    return changes.groupBy(*SESSION, "key").agg(
        F.max_by("value", at).alias("value"),
        F.max("ts").alias("ts"),
        F.max_by("event_id", at).alias("event_id"),
        F.max_by("arrival", at).alias("arrival"),
    )


def initial_changes(sessions: DataFrame) -> DataFrame:
    """State given at creation, as the earliest writes; kept unfiltered."""
    return sessions.select(
        *SESSION, F.col("last_update_time").alias("ts"), F.lit("").alias("event_id"), F.lit(0).alias("arrival"), F.explode("state")
    )


def session_state(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Current state in long form, deleted keys left out; a re-sent event replaces the one before."""
    narrow = events.select(*SESSION, "event_id", "ts", "arrival", "partial", "state_delta")
    changes = state_changes(event_log(narrow))
    if sessions is not None:
        changes = changes.unionByName(initial_changes(sessions))
    spark, partitions = events.sparkSession, str(task_count(events.sparkSession, events.count()))
    # Re-sent events are sorted out before the shuffle too, so splits of files are small as well.
    with setting(spark, PARTITIONS, partitions), setting(spark, SPLITS, partitions):
        latest = materialize(latest_by_key(changes), "session-state")
    return live_state(latest)


def task_count(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for so many rows: the session's, or more where a task would sort too many of them."""
    return max(int(spark.conf.get(PARTITIONS)), -(-rows // ROWS_PER_TASK))


def live_state(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("value").isNotNull()).select(*SESSION, "key", "value")


def state_maps(state: DataFrame) -> DataFrame:
    """One map per session; a group is the session's own set of keys."""
    entries = F.sort_array(F.collect_list(F.struct("key", "value")))
    return state.groupBy(*SESSION).agg(F.map_from_entries(entries).alias("state"))


def events_since(events: DataFrame, after: datetime | Column) -> DataFrame:
    """Events strictly later than ``after``; the bound reaches the scan."""
    return events.where(F.col("ts") > (after if isinstance(after, Column) else F.lit(after)))


def recent_events(events: DataFrame, limit: int | None = None, after: datetime | Column | None = None) -> DataFrame:
    """The newest ``limit`` events of each session; ``back`` is 1 for the newest.

    Without a limit all events come back and no window is built. Readers order
    by ``ts, event_id``: oldest first.
    """
    scope = events if after is None else events_since(events, after)
    if not limit:
        return scope.withColumn("back", F.lit(None).cast("int"))
    order = F.desc("ts"), F.desc("event_id")
    if limit > WINDOW_LIMIT:
        # Spark limits a window before its shuffle only up to a threshold; above
        # it each session is first cut in slices, so that a hot one is shared.
        scope = scope.withColumn("__slice", F.pmod(F.xxhash64("event_id"), F.lit(SLICES)))
        place = F.row_number().over(W.partitionBy(*SESSION, "__slice").orderBy(*order))
        scope = scope.withColumn("__place", place).where(F.col("__place") <= limit).drop("__slice", "__place")
    newest = W.partitionBy(*SESSION).orderBy(*order)
    return scope.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= limit)


def session_list(events: DataFrame, app_name: str | None = None, user_id: str | None = None) -> DataFrame:
    """Sessions with their last update, newest first; of an app or one user."""
    scope = events.where(~F.col("partial"))
    if app_name is not None:
        scope = scope.where(F.col("app_name") == app_name)
    if user_id is not None:
        scope = scope.where(F.col("user_id") == user_id)
    return (
        scope.groupBy(*SESSION)
        .agg(F.max("ts").alias("last_update_time"))
        .orderBy(F.desc("last_update_time"), *SESSION)
    )


def message_facts(events: DataFrame) -> DataFrame:
    """Per event what the preview needs instead of its texts.

    The preview is null where an event is no message: it has no text, or is a
    compaction.
    """
    return events.where(~F.col("partial")).select(
        *SESSION,
        "event_id",
        "ts",
        "arrival",
        "partial",
        F.when(~F.col("compaction"), message_preview(F.col("texts"))).alias("preview"),
        F.when(F.col("author") == "user", F.lit("user")).otherwise(F.lit("agent")).alias("author"),
    )


def fold_messages(facts: DataFrame, counted: Column) -> DataFrame:
    """Last message and number of messages per session.

    Takes facts of single events (``counted`` = 1) or folded ones (their sum).
    """
    at = F.struct("ts", "event_id")
    return facts.where(F.col("preview").isNotNull()).groupBy(*SESSION).agg(
        F.max_by(F.struct("preview", "author", "event_id"), at).alias("last"),
        F.max("ts").alias("ts"),
        F.sum(counted).cast("bigint").alias("message_count"),
    ).select(*SESSION, "last.preview", "last.author", "last.event_id", "ts", "message_count")


def session_preview(events: DataFrame) -> DataFrame:
    """Preview columns of each session over its stored events.

    Texts are cut to previews before the shuffle that finds re-sent events.
    """
    return preview_columns(fold_messages(event_log(message_facts(events)), F.lit(1)))


def preview_columns(folded: DataFrame) -> DataFrame:
    return folded.select(
        *SESSION,
        F.col("preview").alias("last_message_preview"),
        F.col("ts").alias("last_message_at"),
        F.col("author").alias("last_message_author"),
        "message_count",
    )


def delete_list(rows: DataFrame) -> DataFrame:
    """The sessions of ``rows``, stored: joins then know how many there are."""
    return materialize(rows.select(*SESSION).distinct(), "deleted-sessions")


def purge(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Events or sessions without those of the deleted sessions."""
    return rows.join(deleted.select(*SESSION), SESSION, "left_anti")


def purge_counts(events: DataFrame, deleted: DataFrame) -> DataFrame:
    """Events removed per deleted session."""
    gone = events.join(deleted.select(*SESSION), SESSION, "left_semi")
    return gone.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("purged_events"))
