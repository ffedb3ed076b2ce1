"""The session log as a stream: log, state and previews kept per micro-batch."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablesteward.operators.sessions import (
    SESSION,
    event_log,
    fold_messages,
    latest_by_key,
    live_state,
    message_facts,
    preview_columns,
    recent_events,
    state_changes,
)
from tablesteward.session import setting
from tablesteward.sources.snapshots import SnapshotTable, is_missing

EVENT_SCHEMA = (
    "app_name string, user_id string, session_id string, event_id string, ts timestamp_ntz, arrival int, "
    "author string, partial boolean, compaction boolean, texts array<string>, state_delta map<string,string>"
)
EVENT_COLUMNS = [part.split()[0] for part in EVENT_SCHEMA.split(", ")]
SESSION_SCHEMA = "app_name string, user_id string, session_id string"
STATE_SCHEMA = "app_name string, user_id string, session_id string, key string, value string, ts timestamp_ntz, event_id string, arrival int"
MESSAGE_SCHEMA = (
    "app_name string, user_id string, session_id string, preview string, author string, event_id string, "
    "ts timestamp_ntz, message_count bigint"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


IDENTITY = [*SESSION, "event_id"]
SEEN_SCHEMA = "app_name string, user_id string, session_id string, event_id string, ts timestamp_ntz, arrival int, digest bigint"


def event_digest() -> Column:
    """A hash of what an event says, whatever its arrival."""
    entries = F.array_sort(F.map_entries("state_delta"))
    return F.xxhash64("ts", "author", "compaction", "texts", entries)


def moment(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


class SessionStream:
    """Folds event files into ``log``, ``state`` and ``messages`` under a folder.

    The stream's state keeps the winner of each event id, the copy that arrived
    last. Copies that say the same are dropped. One that changes an event makes
    its session *restated*: the session is folded again from the log, and what
    earlier batches folded of it counts no more. So results are those of the
    batch log, and each batch costs what its new events and its restated
    sessions cost. A batch writes only its own partition of each table and
    overwrites it when replayed; nothing is lost or counted twice. Readers fold
    the partitions again, and every ``compact_every`` batches the fold so far is
    stored as a snapshot. State keeps deletions as null values until read, so an
    older write that comes late cannot bring a key back.

    With a ``delay`` (a Spark interval text such as ``2 hours``) the stream is
    bounded: it remembers the ids of events no older than the delay before the
    latest event of earlier batches, and events older than that go to the table
    of late events as they are. An event sent again with another time within
    the delay still replaces the one before.

    With ``keep_recent`` the newest events of each session, at most that many, are
    kept as well: each batch adds its own newest ones, snapshots cut them again.
    """

    def __init__(
        self, spark: SparkSession, folder: str, compact_every: int = 16, delay: str | None = None, keep_recent: int | None = None
    ):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every
        self.delay, self.keep_recent = delay, keep_recent
        names = ("state", "messages", "recent") if keep_recent else ("state", "messages")
        self.bases = {name: SnapshotTable(spark, f"{self.folder}/{name}_base") for name in names}

    def start(
        self,
        source: str,
        files_per_batch: int = 1000,
        schema: str = EVENT_SCHEMA,
        state_partitions: int | None = None,
    ) -> StreamingQuery:
        """Process all files now under ``source`` and stop.

        ``state_partitions`` (default: the session's shuffle partitions) is fixed by the first
        start; each has a store that is committed every batch. A bounded stream keeps no such store.
        """
        events = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        stored = events.where(~F.col("partial"))
        frame, store = (stored, self.apply_bounded) if self.delay else (self.winners(stored), self.apply)
        # Each commit uploads the changes, not the files of the whole state.
        partitions = str(state_partitions or self.spark.conf.get(PARTITIONS))
        with (
            setting(self.spark, PROVIDER, ROCKSDB),
            setting(self.spark, CHANGELOG, "true"),
            setting(self.spark, PARTITIONS, partitions),
        ):
            return (
                frame.writeStream.foreachBatch(store)
                .outputMode("append" if self.delay else "update")
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )

    def run(self, source: str, **options) -> None:
        self.start(source, **options).awaitTermination()

    @staticmethod
    def winners(stored: DataFrame) -> DataFrame:
        """The last copy of each event of a batch, and whether it may replace another of an earlier batch.

        The time of a batch is one value, the same when it is replayed, so it
        tells ids that are new from those met before.
        """
        facts = [name for name in EVENT_COLUMNS if name not in IDENTITY]
        dated = stored.withColumns({"digest": event_digest(), "seen_at": F.current_timestamp()})
        kept = dated.groupBy(*IDENTITY).agg(
            F.max_by(F.struct(*facts), F.struct("arrival", "ts", "digest")).alias("event"),
            (F.min("seen_at") == F.max("seen_at")).alias("new"),
            (F.min("digest") != F.max("digest")).alias("differs"),
        )
        changed = ~F.col("new") & F.col("differs")
        rows = kept.where(F.col("new") | changed).select(*IDENTITY, "event.*", changed.alias("changed"))
        return rows.select(*EVENT_COLUMNS, "changed")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Store one batch of new and changed events and what it folds to."""
        batch = batch if "changed" in batch.columns else batch.withColumn("changed", F.lit(False))
        batch.write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch_id}")
        spark = batch.sparkSession
        events = spark.read.schema(f"{EVENT_SCHEMA}, changed boolean").parquet(f"{self.folder}/log/batch={batch_id}")
        restated = events.where("changed").select(*SESSION).distinct()
        if not restated.isEmpty():
            path = f"{self.folder}/restated/batch={batch_id}"
            restated.write.mode("overwrite").parquet(path)
            restated = spark.read.schema(SESSION_SCHEMA).parquet(path)
            # Written once: all folds read it, and the log is joined once for them.
            path = f"{self.folder}/refolded"
            self.refolded(batch_id, restated).write.mode("overwrite").parquet(path)
            events = spark.read.schema(EVENT_SCHEMA).parquet(path)
        folds = {
            "state": latest_by_key(state_changes(events)),
            "messages": fold_messages(message_facts(events), F.lit(1)),
        }
        everything = {"state": self.latest_state, "messages": self.messages, "recent": self.recent}
        if self.keep_recent:
            folds["recent"] = recent_events(events.select(*EVENT_COLUMNS), self.keep_recent).drop("back")

        def keep(name: str) -> None:
            folds[name].write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")
            # A replayed batch finds the snapshot it has already committed.
            if (batch_id + 1) % self.compact_every == 0 and self.bases[name].current() != batch_id:
                self.bases[name].write(everything[name](), batch_id)

        # Both tables depend only on the log part and are kept side by side.
        with ThreadPoolExecutor(len(folds)) as pool:
            list(pool.map(keep, folds))

    def apply_bounded(self, batch: DataFrame, batch_id: int) -> None:
        """One batch of a bounded stream: late events apart, the others against the ids remembered.

        What a batch reads was written by the batches before it, so a replay
        sees the same.
        """
        spark = batch.sparkSession
        mark = self.mark(batch_id - 1)
        is_late = F.col("ts").isNull() if mark is None else F.col("ts").isNull() | (F.col("ts") < moment(mark))
        path = f"{self.folder}/arrived/batch={batch_id}"
        batch.select(*EVENT_COLUMNS).withColumns({"digest": event_digest(), "late": is_late}).write.mode(
            "overwrite"
        ).parquet(path)
        arrived = spark.read.schema(f"{EVENT_SCHEMA}, digest bigint, late boolean").parquet(path)
        arrived.where("late").drop("late", "digest").write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
        on_time = event_log(arrived.where("NOT late").drop("late"))
        seen = self.seen(batch_id - 1)
        before = seen.select(*IDENTITY, F.struct("arrival", "ts").alias("at"), F.col("digest").alias("known"))
        met = on_time.join(before, IDENTITY, "left")
        new = F.col("known").isNull()
        changed = ~new & (F.struct("arrival", "ts") > F.col("at")) & (F.col("known") != F.col("digest"))
        fresh = met.where(new | changed).select(*EVENT_COLUMNS, "digest", F.coalesce(changed, F.lit(False)).alias("changed"))
        fresh_path = f"{self.folder}/fresh/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(fresh_path)
        fresh = spark.read.schema(f"{EVENT_SCHEMA}, digest bigint, changed boolean").parquet(fresh_path)
        latest = arrived.agg(F.max("ts").cast("timestamp_ntz").alias("latest")).select(
            (F.col("latest") - F.expr(f"INTERVAL {self.delay}")).alias("mark")
        )
        reached = [m for m in (mark, latest.first()[0]) if m is not None]
        mark = max(reached) if reached else None
        kept = seen.join(fresh.select(*IDENTITY), IDENTITY, "left_anti").unionByName(fresh.select(*seen.columns))
        kept = kept if mark is None else kept.where(F.col("ts") >= moment(mark))
        kept.write.mode("overwrite").parquet(f"{self.folder}/seen/version={batch_id}")
        self.apply(fresh.drop("digest"), batch_id)
        marks = spark.createDataFrame([(mark,)], "mark timestamp_ntz")
        marks.write.mode("overwrite").parquet(f"{self.folder}/marks/version={batch_id}")

    def _read(self, path: str, schema: str) -> DataFrame:
        """A table of this folder; empty before anything was written there."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{path}")
        except AnalysisException as problem:
            if not is_missing(problem):
                raise
            return self.spark.createDataFrame([], schema)

    def mark(self, version: int) -> datetime | None:
        """Events before this time are late to the batch after ``version``."""
        found = self._read(f"marks/version={version}", "mark timestamp_ntz").first()
        return found["mark"] if found else None

    def seen(self, version: int) -> DataFrame:
        """Ids that a bounded stream remembers after a batch."""
        return self._read(f"seen/version={version}", SEEN_SCHEMA)

    def late(self) -> DataFrame:
        """Events that came too late to a bounded stream."""
        return self._read("late", f"{EVENT_SCHEMA}, batch bigint")

    def _restated(self) -> DataFrame:
        """Restated sessions with the last batch that restated them."""
        found = self._read("restated", f"{SESSION_SCHEMA}, batch bigint")
        return found.groupBy(*SESSION).agg(F.max("batch").alias("since"))

    def _parts(self, name: str, schema: str) -> DataFrame:
        """The snapshot and the partitions written after it, of restated sessions only what counts."""
        covered = self.bases[name].current()
        covered = -1 if covered is None else covered
        rows = self._read(name, f"{schema}, batch bigint").where(F.col("batch") > covered)
        if covered >= 0:
            rows = rows.unionByName(self.bases[name].read(covered).withColumn("batch", F.lit(covered).cast("bigint")))
        counts = rows.join(self._restated(), SESSION, "left").where(F.col("since").isNull() | (F.col("batch") >= F.col("since")))
        return counts.drop("batch", "since")

    def refolded(self, batch_id: int, restated: DataFrame) -> DataFrame:
        """What a batch folds: its own events, and all events so far of the sessions that it restates."""
        rows = self._log_rows(batch_id)
        again = restated.select(*SESSION, F.lit(True).alias("again"))
        scope = rows.join(again, SESSION, "left").where(F.col("again") | (F.col("batch") == batch_id))
        return self._standing(scope, rows)

    def log(self, until: int | None = None) -> DataFrame:
        """Stored events as they are now, or as they were after a batch."""
        rows = self._log_rows(until)
        return self._standing(rows, rows)

    def _log_rows(self, until: int | None) -> DataFrame:
        rows = self._read("log", f"{EVENT_SCHEMA}, changed boolean, batch bigint")
        return rows if until is None else rows.where(F.col("batch") <= until)

    @staticmethod
    def _standing(rows: DataFrame, log: DataFrame) -> DataFrame:
        """Those of ``rows`` that no later change in the log replaces."""
        replaced = log.where("changed").groupBy(*IDENTITY).agg(F.max("batch").alias("since"))
        kept = rows.join(replaced, IDENTITY, "left").where(F.col("since").isNull() | (F.col("batch") >= F.col("since")))
        return kept.select(*EVENT_COLUMNS)

    def latest_state(self) -> DataFrame:
        return latest_by_key(self._parts("state", STATE_SCHEMA))

    def state(self) -> DataFrame:
        return live_state(self.latest_state())

    def messages(self) -> DataFrame:
        facts = self._parts("messages", MESSAGE_SCHEMA)
        return fold_messages(facts, F.col("message_count"))

    def recent(self, limit: int | None = None) -> DataFrame:
        """The newest events of each session, at most ``limit`` (default: all that are kept)."""
        if not self.keep_recent:
            raise ValueError("the stream keeps no recent events")
        most = min(limit or self.keep_recent, self.keep_recent)
        return recent_events(self._parts("recent", EVENT_SCHEMA), most).drop("back")

    def previews(self) -> DataFrame:
        return preview_columns(self.messages())

