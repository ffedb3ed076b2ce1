"""Registered queries: session event log, its stream, traces and call spacing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tablesteward.functions import jsontext, statekeys, text
from tablesteward.operators import sessions, timejoins, trace
from tablesteward.session import materialize, scratch_path
from tablesteward.streaming.sessions import SessionStream
from tablesteward.workload import inputs
from tablesteward.workload.inputs import SESSION_EVENTS_SQL, table

SESSION = sessions.SESSION
SINCE = datetime(2024, 1, 20, 12, 0, 0)


def event_log(spark, sf_dir):
    stored = sessions.event_log(inputs.resent_events(spark, sf_dir))
    return stored.select(*SESSION, "event_id", "arrival", "author", F.array_join("texts", "/").alias("content"))


def session_create(spark, sf_dir):
    """Sessions asked for by customers; those without a segment code get a made id."""
    given = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("s"), F.col("c_custkey").cast("string")))
    note = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    requests = table(spark, sf_dir, "customer").select(
        F.lit("shop").alias("app_name"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"),
        given.alias("session_id"),
        F.col("c_nationkey").alias("seq"),
        F.create_map(F.lit("temp:segment"), note, F.lit("nation"), F.col("c_nationkey").cast("string")).alias("state"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )
    made = sessions.create_sessions(requests)
    return made.select(*SESSION, F.array_join(F.array_sort(F.map_keys("state")), ",").alias("state_keys"))


def session_state(spark, sf_dir):
    """State of all sessions; each shop session began with a cart and a note."""
    events = inputs.session_events(spark, sf_dir)
    created = events.where("app_name = 'shop'").groupBy(*SESSION).agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("last_update_time"))
    begun = created.withColumn("state", F.create_map(F.lit("cart"), F.lit("new"), F.lit("temp:note"), F.lit("hello"), F.lit("last_error"), F.lit(None).cast("string")))
    begun = begun.withColumn("state", F.map_filter("state", lambda _, v: v.isNotNull()))
    return sessions.session_state(events, begun)


def state_keys(spark, sf_dir):
    """Keys of all deltas, escaped and back, with short and wrapped variants."""
    keys = inputs.session_events(spark, sf_dir).select("event_id", F.explode(F.map_keys("state_delta")).alias("base"))
    kinds = [F.col("base"), F.concat(F.lit("__"), "base", F.lit("__")), F.concat(F.lit("_Z_"), "base", F.lit("_Z_")), F.lit("____")]
    named = keys.select("event_id", "base", F.posexplode(F.array(*kinds)).alias("variant", "key"))
    encoded = statekeys.encode_key(F.col("key"))
    return named.select(
        "event_id", "base", "variant", encoded.alias("encoded"), statekeys.decode_key(encoded).alias("decoded"),
        statekeys.is_saved(F.col("key")).alias("saved"),
    )


def recent_events(spark, sf_dir):
    return sessions.recent_events(sessions.event_log(inputs.session_events(spark, sf_dir)), 3).select(*SESSION, "event_id", "ts", "back")


def events_since(spark, sf_dir):
    return sessions.events_since(sessions.event_log(inputs.session_events(spark, sf_dir)), SINCE).select(*SESSION, "event_id", "ts")


def session_list(spark, sf_dir):
    return sessions.session_list(inputs.session_events(spark, sf_dir), app_name="shop")


def session_preview(spark, sf_dir):
    return sessions.session_preview(inputs.resent_events(spark, sf_dir))


def session_purge(spark, sf_dir):
    """Events left, and removed per session, after deleting sessions with a warning mark."""
    # Stored once: the list, the events left and those removed all read it.
    log = sessions.event_log(inputs.session_events(spark, sf_dir))
    events = materialize(log.select(*SESSION, F.get("texts", F.lit(0)).alias("said")), "event-log")
    marked = F.col("said").isin("error 13", "error 42", "error 77")
    deleted = sessions.delete_list(events.where(marked))
    left = sessions.purge(events, deleted).groupBy(*SESSION).agg(F.count(F.lit(1)).alias("events")).withColumn("purged", F.lit(False))
    gone = sessions.purge_counts(events, deleted).withColumnRenamed("purged_events", "events").withColumn("purged", F.lit(True))
    return left.unionByName(gone)


def event_files(spark, events, batches: int, *keys) -> tuple[str, int]:
    """``events`` as files that a stream reads in so many batches, and the files of a batch: one for each core."""
    source, cores = scratch_path(spark, "event-files"), spark.sparkContext.defaultParallelism
    events.repartition(batches * cores, *keys).write.parquet(source)
    return source, cores


def stream_sessions(spark, sf_dir):
    """Previews kept by the stream over shuffled files: one author's events twice, errors again with other contents."""
    events = inputs.restated_events(spark, sf_dir)
    again = events.where("author = 'user'")
    source, files = event_files(spark, events.unionByName(again), 3, F.xxhash64("event_id", F.size("texts")) % 6, "user_id", "arrival")
    stream = SessionStream(spark, scratch_path(spark, "session-stream"), compact_every=2)
    stream.run(source, files_per_batch=files, state_partitions=spark.sparkContext.defaultParallelism)
    return stream.previews()


def stream_state(spark, sf_dir):
    """State kept by the stream over the same events, several batches."""
    source, files = event_files(spark, inputs.restated_events(spark, sf_dir), 4, "event_id", "arrival")
    stream = SessionStream(spark, scratch_path(spark, "session-stream"), compact_every=3)
    stream.run(source, files_per_batch=files, state_partitions=spark.sparkContext.defaultParallelism)
    return stream.state()


def stream_recent(spark, sf_dir):
    """The three newest events of each session, kept by the stream."""
    source, files = event_files(spark, inputs.restated_events(spark, sf_dir), 4, "event_id", "arrival")
    stream = SessionStream(spark, scratch_path(spark, "session-stream"), compact_every=2, keep_recent=3)
    stream.run(source, files_per_batch=files, state_partitions=spark.sparkContext.defaultParallelism)
    return stream.recent().select(*SESSION, "event_id", "ts", "arrival")


# How far back the bounded stream looks.
DELAY = "10 days"


def stream_bounded(spark, sf_dir):
    """Events of a bounded stream and whether they came too late: those of users first, then all others."""
    events = inputs.session_events(spark, sf_dir)
    stream = SessionStream(spark, scratch_path(spark, "session-stream"), delay=DELAY)
    source = scratch_path(spark, "event-files")
    for part in (F.col("author") == "user", F.col("author") != "user"):
        events.where(part).write.mode("append").parquet(source)
        stream.run(source)
    stored = [rows.select(*SESSION, "event_id", F.lit(late).alias("late")) for rows, late in ((stream.log(), False), (stream.late(), True))]
    return stored[0].unionByName(stored[1])


def truncate_marked(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_marked(F.col("text"), 200).alias("shortened"))


def content_summary(spark, sf_dir):
    """Turns as parts: a text line each, and a call, response or code by role."""
    nothing = F.lit(None).cast("string")

    def part(t=nothing, call=nothing, response=nothing, code=nothing):
        return F.struct(t.alias("text"), call.alias("call"), response.alias("response"), code.alias("code"))

    lines = F.transform(F.split("text", "\n"), lambda line: part(t=line))
    extra = (
        F.when(F.col("role") == "user", F.array(part(call=F.lit("run_query")), part()))
        .when(F.col("role") == "assistant", F.array(part(response=F.lit("run_query"))))
        .otherwise(F.array(part(code=F.lit("1 + 1"))))
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.content_summary(F.concat(lines, extra)).alias("summary")
    )


def kv_render(spark, sf_dir):
    entries = F.create_map(F.lit("url"), F.col("url"), F.lit("html"), F.col("html"), F.lit("id"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", text.kv_render(entries).alias("rendered"))


def kv_json(spark, sf_dir):
    """Customers as call arguments: a long value over many lines, short ones on one, an empty list among them."""
    place = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.array().cast("array<int>").alias("none"))
    marks = F.array(F.col("c_custkey") % 7, F.col("c_nationkey").cast("bigint"))
    detail = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), place.alias("place"), marks.alias("marks"))
    entries = F.create_map(
        F.lit("detail"), jsontext.json_value_text(F.to_json(detail)),
        F.lit("marks"), jsontext.json_value_text(F.to_json(marks)),
        F.lit("name"), F.col("c_name"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.kv_render(entries).alias("rendered"))


def trace_rollup(spark, sf_dir):
    return trace.trace_rollup(trace.trace_rows(inputs.trace_records(spark, sf_dir)))


# The events of one user are hours apart, so the spacing is half an hour.
SPACING = 1800.0


def call_gap_audit(spark, sf_dir):
    return trace.call_gaps(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", SPACING)


def paced_release(spark, sf_dir):
    return trace.paced_release(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", SPACING)


def state_at_event(spark, sf_dir):
    """Each purchase with what its user viewed last until then."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen_id"))
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    found = timejoins.asof_join(bought, views, ["user_id"], "ts", "seen_at", "seen_id")
    return found.select("user_id", "event_id", F.col("matched.seen_id").alias("seen_id"), F.col("matched.seen_at").alias("seen_at"))


def events_after_error(spark, sf_dir):
    """How many clicks each user made within a day after an error, or within thirty days after every tenth one."""
    events = table(spark, sf_dir, "events")
    days = F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL '30' DAY")).otherwise(F.expr("INTERVAL '1' DAY"))
    errors = events.where("event_type = 'error'").select("user_id", "event_id", "ts", (F.col("ts") + days).alias("until"))
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    pairs = timejoins.interval_join(errors, clicks, ["user_id"], "ts", "until", "clicked", width_seconds=86_400)
    return pairs.groupBy(F.col("span.event_id").alias("event_id")).agg(
        F.count(F.lit(1)).alias("clicks"), F.min("point.click_id").alias("first_click")
    )


QUERIES = {
    f.__name__: f
    for f in (
        event_log, session_create, session_state, state_keys, recent_events, events_since, session_list, session_preview,
        session_purge, stream_sessions, stream_state, stream_recent, stream_bounded, truncate_marked, content_summary, kv_render, kv_json, trace_rollup,
        call_gap_audit, paced_release, state_at_event, events_after_error,
    )
}


_CUT = r"""CASE WHEN length({t}) > {n} THEN regexp_replace(substr({t}, 1, {n}), '\s+$', '') || '… (+' || (length({t}) - {n}) || ' chars)' ELSE {t} END"""
_TRIM = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _cut(column: str, limit: int) -> str:
    return _CUT.format(t=_TRIM.format(t=column), n=limit)


_PREVIEWS = r"""facts AS (
  SELECT app_name, user_id, session_id, event_id, ts, author,
    array_to_string(list_filter(texts, lambda t: t IS NOT NULL AND t <> ''), ' ') AS body
  FROM stored WHERE NOT compaction AND len(list_filter(texts, lambda t: t IS NOT NULL AND t <> '')) > 0),
newest AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY app_name, user_id, session_id) AS message_count
  FROM facts WINDOW w AS (PARTITION BY app_name, user_id, session_id ORDER BY ts DESC, event_id DESC))
SELECT app_name, user_id, session_id, substr(body, 1, 80) || CASE WHEN length(body) > 80 THEN '…' ELSE '' END AS last_message_preview,
  ts AS last_message_at, CASE WHEN author = 'user' THEN 'user' ELSE 'agent' END AS last_message_author, message_count
FROM newest WHERE n = 1"""

_CHANGES = """changes AS (
  SELECT app_name, user_id, session_id, ts, event_id, unnest(CASE kind
    WHEN 'click' THEN [{'key': 'last_click', 'value': mark}]
    WHEN 'view' THEN [{'key': '__view__', 'value': mark}, {'key': 'cart', 'value': mark}]
    WHEN 'purchase' THEN [{'key': 'cart', 'value': NULL}]
    WHEN 'error' THEN [{'key': 'last_error', 'value': mark}]
    WHEN 'chat' THEN [{'key': 'topic', 'value': mark}]
    ELSE [{'key': 'last_click', 'value': NULL}] END) AS item
  FROM session_events WHERE NOT partial)"""
_STATE = """last_write AS (
  SELECT *, row_number() OVER (PARTITION BY app_name, user_id, session_id, item.key ORDER BY ts DESC, event_id DESC) AS n
  FROM all_changes)
SELECT app_name, user_id, session_id, item.key AS key, item.value AS value FROM last_write WHERE n = 1 AND item.value IS NOT NULL"""

_RESENT = """resent AS (
  SELECT * FROM session_events UNION ALL
  SELECT * REPLACE (1 AS arrival, ['resent ' || texts[1]] AS texts) FROM session_events WHERE kind = 'error'),
stored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, event_id ORDER BY arrival DESC) AS copy FROM resent WHERE NOT partial)
  WHERE copy = 1)"""

_KIND = """CASE event_type WHEN 'click' THEN 'llm_request' WHEN 'view' THEN 'llm_response' WHEN 'purchase' THEN 'tool_completed'
  WHEN 'error' THEN 'llm_error' ELSE 'user_message' END"""
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

ORACLE = {
    "event_log": f"""WITH {SESSION_EVENTS_SQL}, {_RESENT}
SELECT app_name, user_id, session_id, event_id, arrival, author, array_to_string(list_filter(texts, lambda t: t IS NOT NULL), '/') AS content FROM stored""",
    "session_create": """SELECT 'shop' AS app_name, 'u' || c_custkey AS user_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 's' || c_custkey
    ELSE substr(sha256('shop' || chr(0) || 'u' || c_custkey || chr(0) || c_nationkey), 1, 32) END AS session_id,
  CASE WHEN c_acctbal > 0 THEN 'nation,temp:segment' ELSE 'nation' END AS state_keys FROM customer""",
    "session_state": f"""WITH {SESSION_EVENTS_SQL}, {_CHANGES}, begun AS (
  SELECT app_name, user_id, session_id, date_trunc('day', min(ts)) AS ts, '' AS event_id
  FROM session_events WHERE app_name = 'shop' GROUP BY 1, 2, 3),
all_changes AS (SELECT * FROM changes UNION ALL
  SELECT *, unnest([{{'key': 'cart', 'value': 'new'}}, {{'key': 'temp:note', 'value': 'hello'}}]) FROM begun), {_STATE}""",
    "stream_state": f"WITH {SESSION_EVENTS_SQL}, {_CHANGES}, all_changes AS (SELECT * FROM changes), {_STATE}".replace(
        "{'key': 'last_error', 'value': mark}", "{'key': 'last_error', 'value': 'again ' || mark}"
    ),
    "stream_recent": f"""WITH {SESSION_EVENTS_SQL}, {_RESENT} SELECT * FROM (SELECT app_name, user_id, session_id, event_id, ts, arrival
  FROM stored QUALIFY row_number() OVER (PARTITION BY app_name, user_id, session_id ORDER BY ts DESC, event_id DESC) <= 3)""",
    "stream_bounded": f"""WITH {SESSION_EVENTS_SQL}, stored AS (SELECT * FROM session_events WHERE NOT partial),
border AS (SELECT max(ts) - INTERVAL {DELAY} AS reached FROM stored WHERE author = 'user')
SELECT app_name, user_id, session_id, event_id, author <> 'user' AND ts < reached AS late FROM stored, border""",
    "state_keys": f"""WITH {SESSION_EVENTS_SQL}, bases AS (SELECT event_id, unnest(CASE kind WHEN 'click' THEN ['last_click']
    WHEN 'view' THEN ['__view__', 'cart'] WHEN 'purchase' THEN ['cart'] WHEN 'error' THEN ['temp:error', 'last_error']
    WHEN 'chat' THEN ['topic'] ELSE ['last_click'] END) AS base FROM session_events),
keys AS (SELECT event_id, base, 0 AS variant, base AS key FROM bases UNION ALL SELECT event_id, base, 1, '__' || base || '__' FROM bases
  UNION ALL SELECT event_id, base, 2, '_Z_' || base || '_Z_' FROM bases UNION ALL SELECT event_id, base, 3, '____' FROM bases),
enc AS (SELECT *, regexp_replace(key, '^__(.+)__$', '_Z_\\1_Z_') AS encoded FROM keys)
SELECT event_id, base, variant, encoded, regexp_replace(encoded, '^_Z_(.+)_Z_$', '__\\1__') AS decoded,
  NOT starts_with(key, 'temp:') AS saved FROM enc""",
    "recent_events": f"""WITH {SESSION_EVENTS_SQL} SELECT * FROM (SELECT app_name, user_id, session_id, event_id, ts,
  CAST(row_number() OVER (PARTITION BY app_name, user_id, session_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS back
  FROM session_events WHERE NOT partial) WHERE back <= 3""",
    "events_since": f"""WITH {SESSION_EVENTS_SQL} SELECT app_name, user_id, session_id, event_id, ts FROM session_events
WHERE NOT partial AND ts > TIMESTAMP '2024-01-20 12:00:00'""",
    "session_list": f"""WITH {SESSION_EVENTS_SQL} SELECT app_name, user_id, session_id, max(ts) AS last_update_time
FROM session_events WHERE NOT partial AND app_name = 'shop' GROUP BY 1, 2, 3""",
    "session_preview": f"WITH {SESSION_EVENTS_SQL}, {_RESENT}, {_PREVIEWS}",
    "stream_sessions": f"WITH {SESSION_EVENTS_SQL}, {_RESENT}, {_PREVIEWS}",
    "session_purge": f"""WITH {SESSION_EVENTS_SQL},
gone AS (SELECT DISTINCT session_id FROM session_events WHERE NOT partial AND texts[1] IN ('error 13', 'error 42', 'error 77'))
SELECT app_name, user_id, session_id, count(*) AS events, session_id IN (SELECT session_id FROM gone) AS purged
FROM session_events WHERE NOT partial GROUP BY 1, 2, 3""",
    "state_at_event": """WITH v AS (
  SELECT user_id, ts AS seen_at, max(event_id) AS seen_id FROM events WHERE event_type = 'view' GROUP BY 1, 2),
p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT p.user_id, event_id, seen_id, seen_at FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.seen_at""",
    "events_after_error": """SELECT e.event_id, count(*) AS clicks, min(c.event_id) AS first_click FROM events e JOIN events c
  ON e.user_id = c.user_id AND c.ts BETWEEN e.ts AND e.ts + CASE WHEN e.event_id % 10 = 0 THEN INTERVAL 30 DAY ELSE INTERVAL 1 DAY END
WHERE e.event_type = 'error' AND c.event_type = 'click' GROUP BY 1""",
    "truncate_marked": f"SELECT doc_id, {_cut('text', 200)} AS shortened FROM documents",
    "content_summary": f"""WITH parts AS (
  SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
shown AS (
  SELECT conv_id, turn, role, i, CASE WHEN line = '' THEN 'other_part' ELSE 'text: ''' || {_cut('line', 200)} || '''' END AS line FROM parts)
SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) || chr(10) || CASE any_value(role)
  WHEN 'user' THEN 'function_call: run_query' || chr(10) || 'other_part' WHEN 'assistant' THEN 'function_response: run_query'
  ELSE 'code_execution_result' END AS summary
FROM shown GROUP BY 1, 2""",
    "kv_render": f"""WITH t AS (SELECT page_id, {_cut('url', 600)} AS url, {_cut('html', 600)} AS html FROM pages)
SELECT page_id, 'url: ' || url || chr(10) || CASE WHEN contains(html, chr(10))
  THEN 'html:' || chr(10) || '  ' || replace(html, chr(10), chr(10) || '  ') ELSE 'html: ' || html END || chr(10) || 'id: ' || page_id AS rendered
FROM t""",
    "kv_json": r"""SELECT c_custkey, replace('detail:|  {|    "id": ' || c_custkey || ',|    "name": "' || c_name || '",|    "place": {|      "nation": '
  || c_nationkey || ',|      "segment": "' || c_mktsegment || '",|      "none": []|    },|    "marks": [|      ' || c_custkey % 7 || ',|      '
  || c_nationkey || '|    ]|  }|marks: [' || c_custkey % 7 || ', ' || c_nationkey || ']|name: ' || c_name, '|', chr(10)) AS rendered FROM customer""",
    "trace_rollup": f"""WITH t AS (SELECT *, {_K} AS k, 'agent_' || (user_id % 7) AS agent, {_KIND} AS kind FROM events)
SELECT agent, kind, count(*) AS blocks, count(*) FILTER (event_type = 'error') AS errors,
  CAST(coalesce(sum(k) FILTER (event_type = 'view'), 0) AS BIGINT) AS tokens_in,
  CAST(coalesce(sum(user_id) FILTER (event_type = 'view'), 0) AS BIGINT) AS tokens_out,
  CAST(sum(CASE event_type WHEN 'view' THEN 3 WHEN 'error' THEN 2 ELSE 1 END) AS BIGINT) AS fields
FROM t WHERE NOT (event_type = 'view' AND k % 4 = 1) GROUP BY 1, 2""",
    "call_gap_audit": f"""WITH g AS (SELECT user_id, event_id,
  epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_micros FROM events)
SELECT *, {int(SPACING * 1e6)} - gap_micros AS wait_micros FROM g WHERE gap_micros < {int(SPACING * 1e6)}""",
    "paced_release": f"""WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS micros,
  row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_id, micros, i * {int(SPACING * 1e6)}
  + max(micros - i * {int(SPACING * 1e6)}) OVER (PARTITION BY user_id ORDER BY i) AS release_micros FROM p)
SELECT *, release_micros - micros AS wait_micros FROM r""",
}
