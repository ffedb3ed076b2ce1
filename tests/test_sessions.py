"""Session log: folds, hot sessions, and the stream against the batch."""

import datetime as dt
import random

import pytest

from tablesteward.operators import sessions
from tablesteward.streaming.sessions import EVENT_SCHEMA, SessionStream

START = dt.datetime(2024, 1, 1)


def event(number, session="s", minute=None, **fields):
    at = START + dt.timedelta(minutes=number if minute is None else minute)
    base = {
        "app_name": "a", "user_id": "u", "session_id": session, "event_id": f"e{number:05d}", "ts": at, "arrival": 0, "author": "user",
        "partial": False, "compaction": False, "texts": [f"text {number}"], "state_delta": {},
    }
    return tuple((base | fields).values())


@pytest.fixture(scope="module")
def history():
    """600 events; one session holds a third of them."""
    draw, rows = random.Random(3), []
    for number in range(600):
        session = "hot" if number % 3 == 0 else f"s{draw.randrange(40)}"
        kind = draw.randrange(6)
        fields = {
            0: {"partial": True}, 1: {"compaction": True}, 2: {"texts": []}, 3: {"state_delta": {"k": None, "temp:x": "1"}},
            4: {"state_delta": {"k": str(number), "__m__": "2"}, "author": "bot"}, 5: {"texts": ["a" * 50, "", None, "b" * 50]},
        }[kind]
        rows.append(event(number, session, draw.randrange(1000), **fields))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def plain_state(rows):
    """State by applying the deltas in order of time."""
    names = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    state = {}
    for row in sorted((dict(zip(names, r)) for r in rows), key=lambda r: (r["ts"], r["event_id"])):
        if row["partial"]:
            continue
        for key, value in row["state_delta"].items():
            if key.startswith("temp:"):
                continue
            if value is None:
                state.pop((row["session_id"], key), None)
            else:
                state[(row["session_id"], key)] = value
    return state


def as_state(df):
    return {(r["session_id"], r["key"]): r["value"] for r in df.collect()}


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_state_fold(spark, history):
    df = frame(spark, history)
    assert as_state(sessions.session_state(df)) == plain_state(history)
    # Events sent again change nothing, in any order.
    assert as_state(sessions.session_state(df.unionByName(df).repartition(7))) == plain_state(history)
    maps = {r["session_id"]: r["state"] for r in sessions.state_maps(sessions.session_state(df)).collect()}
    assert maps["hot"] == {k: v for (s, k), v in plain_state(history).items() if s == "hot"}


def test_created_sessions(spark):
    request = spark.createDataFrame(
        [("a", "u", None, 1, {"k": "0", "temp:t": "9", "n": None}, START), ("a", "u", "given", 2, {}, START)],
        "app_name string, user_id string, session_id string, seq int, state map<string,string>, created_at timestamp_ntz",
    )
    first, second = sessions.create_sessions(request).collect(), sessions.create_sessions(request).collect()
    assert first == second and first[1]["session_id"] == "given" and len(first[0]["session_id"]) == 32
    made = first[0]["session_id"]
    later = frame(spark, [event(1, made, state_delta={"k": None}), event(2, made, state_delta={"z": "1"})])
    state = as_state(sessions.session_state(later, sessions.create_sessions(request)))
    assert state == {(made, "temp:t"): "9", (made, "z"): "1"}


def test_log_replaces_by_id(spark):
    rows = [event(1, texts=["old"]), event(1, texts=["new"], arrival=1), event(2, partial=True), event(3)]
    stored = {r["event_id"]: r["texts"] for r in sessions.event_log(frame(spark, rows * 3)).collect()}
    assert stored == {"e00001": ["new"], "e00003": ["text 3"]}


def test_recent_and_since(spark, history):
    df = frame(spark, history)
    ordered = sorted((r for r in history if r[2] == "hot"), key=lambda r: (r[4], r[3]))
    newest = sessions.recent_events(df, 4).where("session_id = 'hot'").orderBy("ts", "event_id").collect()
    assert [r["event_id"] for r in newest] == [r[3] for r in ordered[-4:]] and [r["back"] for r in newest] == [4, 3, 2, 1]
    edge = ordered[-3][4]
    since = sessions.recent_events(df, 10, after=edge).where("session_id = 'hot'").collect()
    assert {r["event_id"] for r in since} == {r[3] for r in ordered if r[4] > edge}
    many = spark.range(5000).selectExpr(
        "'a' AS app_name", "'u' AS user_id", "'hot' AS session_id", "CAST(id AS STRING) AS event_id",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id % 1700 AS INT)) AS ts",
    )
    top = [r[0] for r in sessions.recent_events(many, 1200).orderBy("back").select("event_id").collect()]
    assert top == sorted(map(str, range(5000)), key=lambda i: (int(i) % 1700, i), reverse=True)[:1200]
    assert sessions.recent_events(df).count() == sessions.recent_events(df, 0).count() == 600


def test_previews(spark):
    rows = [
        event(1), event(2, author="bot", texts=["x" * 81]), event(3, compaction=True), event(4, texts=["", None]), event(2, minute=2, author="bot", texts=["x" * 81]),
        event(5, "other", texts=["a", "b"]), event(6, "silent", texts=[]),
    ]
    found = {r["session_id"]: list(r)[3:] for r in sessions.session_preview(frame(spark, rows)).collect()}
    assert found == {
        "s": ["x" * 80 + "…", START + dt.timedelta(minutes=2), "agent", 2], "other": ["a b", START + dt.timedelta(minutes=5), "user", 1],
    }


def test_listing_and_purge(spark):
    df = frame(spark, [event(1, "a"), event(5, "b"), event(3, "c"), event(9, "a", partial=True), event(2, "d", user_id="v")])
    assert [r["session_id"] for r in sessions.session_list(df, "a").collect()] == ["b", "c", "d", "a"]
    assert [r["session_id"] for r in sessions.session_list(df, "a", "v").collect()] == ["d"]
    assert sessions.session_list(df, "other").count() == 0
    gone = sessions.delete_list(df.where("session_id IN ('a', 'b')"))
    assert {r["session_id"] for r in sessions.purge(df, gone).collect()} == {"c", "d"}
    assert {r["session_id"]: r["purged_events"] for r in sessions.purge_counts(df, gone).collect()} == {"a": 2, "b": 1}


def write_files(spark, rows, folder, count):
    for part in range(count):
        frame(spark, rows[part::count]).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch(spark, history, tmp_path):
    """Shuffled files, a tenth of the rows sent again later, two runs, compaction between."""
    rows = history[:]
    random.Random(8).shuffle(rows)
    source, stream = str(tmp_path / "in"), SessionStream(spark, str(tmp_path / "out"), compact_every=3)
    write_files(spark, rows[:400], source, 4)
    stream.run(source, files_per_batch=1)
    write_files(spark, rows[400:] + rows[::10], source, 3)
    stream.run(source, files_per_batch=1)
    df = frame(spark, history)
    assert stream.bases["state"].current() == 5
    assert as_state(stream.state()) == as_state(sessions.session_state(df)) == plain_state(history)
    assert as_set(stream.previews()) == as_set(sessions.session_preview(df))
    assert stream.log().count() == sessions.event_log(df).count()


def test_changed_copies_replace(spark, history, tmp_path):
    """Every fifth event again with other contents, some before the copy they replace; unchanged copies in between."""
    rows = history[:]
    later = [[*r[:4], r[4], 1 + i % 2, *r[6:9], ["changed", r[3]], {"k0": f"new {r[3]}"}] for i, r in enumerate(rows[::5])]
    order = rows + later + rows[::7]
    random.Random(9).shuffle(order)
    source, stream = str(tmp_path / "in"), SessionStream(spark, str(tmp_path / "out"), compact_every=3, keep_recent=7)
    write_files(spark, order[:500], source, 3)
    stream.run(source, files_per_batch=1)
    write_files(spark, order[500:], source, 3)
    stream.run(source, files_per_batch=1)
    df = frame(spark, rows + later)
    assert as_state(stream.state()) == as_state(sessions.session_state(df))
    assert as_set(stream.previews()) == as_set(sessions.session_preview(df))
    names = ["session_id", "event_id", "arrival"]
    newest = sessions.recent_events(sessions.event_log(df), 7)  # the hot session has a third of all events
    assert as_set(stream.recent().select(*names)) == as_set(newest.select(*names))
    assert as_set(stream.recent(2).select(*names)) == as_set(newest.where("back <= 2").select(*names))
    assert as_set(stream.log().select(*names)) == as_set(sessions.event_log(df).select(*names))
    assert stream._read("restated", "app_name string, user_id string, session_id string").count() > 0


def test_bounded_stream(spark, tmp_path):
    """Ids older than the delay are forgotten, later ones still replace; late events are all kept apart."""
    stream = SessionStream(spark, str(tmp_path / "out"), compact_every=2, delay="30 minutes")
    source = str(tmp_path / "in")
    batches = [
        [event(n, minute=n, state_delta={"k": f"{n}"}) for n in range(20)],
        [event(n, minute=n, state_delta={"k": f"{n}"}) for n in range(40, 60)] + [event(5, minute=5, arrival=1, texts=["again"])],
        [event(3, minute=3, arrival=2, texts=["too late"]), event(59, minute=59, arrival=1, texts=["changed"], state_delta={"k": "won"})],
        [event(59, minute=59, arrival=1, texts=["changed"], state_delta={"k": "won"}), event(70, minute=70, partial=True)],
        [event(100, minute=100, state_delta={})],
    ]
    sizes = []
    for batch_id, rows in enumerate(batches):
        write_files(spark, rows, source, 1)
        stream.run(source)
        sizes.append(stream.seen(batch_id).count())
    assert sizes == [20, 20 + 0 + 0 + 0 + 0, 20, 20, 1]
    late = [(r["event_id"], r["batch"]) for r in stream.late().collect()]
    assert late == [(event(3)[3], 2)]
    stored = [rows for part in batches for rows in part if not (rows[5] == 2)]
    df = frame(spark, stored)
    assert as_state(stream.state()) == as_state(sessions.session_state(df)) == {("s", "k"): "won"}
    assert as_set(stream.previews()) == as_set(sessions.session_preview(df))
    assert stream.log().count() + stream.late().count() == len(stored) - 4 + 1


def test_replayed_bounded_batch(spark, tmp_path):
    stream = SessionStream(spark, str(tmp_path / "out"), delay="1 hour")
    first = frame(spark, [event(1, minute=0), event(2, minute=200)])
    second = frame(spark, [event(3, minute=1), event(2, minute=200, arrival=1, texts=["b"])])
    for batch_id, batch in ((0, first), (0, first), (1, second), (1, second)):
        stream.apply_bounded(batch, batch_id)
    assert [r["event_id"] for r in stream.late().collect()] == [event(3)[3]]
    assert {(r["event_id"], r["arrival"]) for r in stream.log().collect()} == {(event(1)[3], 0), (event(2)[3], 1)}
    assert {r["event_id"] for r in stream.seen(1).collect()} == {event(2)[3]}


def test_replayed_batches_change_nothing(spark, history, tmp_path):
    df = frame(spark, history).where("NOT partial")
    first, second = df.where("event_id < 'e00300'"), df.where("event_id >= 'e00300'")
    stream = SessionStream(spark, str(tmp_path / "out"), compact_every=2)
    for batch_id, batch in ((0, first), (0, first), (1, second), (1, second), (2, df.limit(0))):
        stream.apply(batch, batch_id)
    assert as_set(stream.previews()) == as_set(sessions.session_preview(df))
    assert as_state(stream.state()) == plain_state(history)


def test_late_write_does_not_undo_a_delete(spark, tmp_path):
    stream = SessionStream(spark, str(tmp_path / "out"), compact_every=1)
    stream.apply(frame(spark, [event(5, state_delta={"k": None})]), 0)
    stream.apply(frame(spark, [event(3, state_delta={"k": "late"})]), 1)
    assert as_state(stream.state()) == {}
    stream.apply(frame(spark, [event(7, state_delta={"k": "new"})]), 2)
    assert as_state(stream.state()) == {("s", "k"): "new"}


def test_resent_delta_replaces(spark):
    """The later arrival of one event id wins, whatever the order of rows."""
    first = {"k": "old", "gone": "x"}
    rows = [event(1, state_delta=first), event(1, state_delta={"k": "new"}, arrival=1)]
    for order in (rows, rows[::-1]):
        assert as_state(sessions.session_state(frame(spark, order))) == {("s", "k"): "new"}


def test_plans(spark, tmp_path):
    path = str(tmp_path / "events")
    frame(spark, [event(1)]).write.parquet(path)
    stored = spark.read.parquet(path)

    def plan(df):
        return df._jdf.queryExecution().toString()

    assert "GreaterThan(ts" in plan(sessions.events_since(stored, START))
    assert "WindowGroupLimit" in plan(sessions.recent_events(stored, 3))
    assert "WindowGroupLimit" in plan(sessions.event_log(stored))
    assert "partial_max_by" in plan(sessions.session_state(stored))
    # One shuffle for the log, one for the previews of it.
    assert plan(sessions.session_preview(stored)).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 2


def test_state_tasks_grow_with_the_events(spark, monkeypatch):
    """More rows make more tasks, not larger ones; the setting is as before afterwards."""
    from tablesteward.operators import sessions

    used, store = [], sessions.materialize

    def stored(df, purpose):
        used.append(spark.conf.get(sessions.PARTITIONS))
        return store(df, purpose)

    before = spark.conf.get(sessions.PARTITIONS)
    monkeypatch.setattr(sessions, "materialize", stored)
    monkeypatch.setattr(sessions, "ROWS_PER_TASK", 3)
    kinds = "app_name string, user_id string, session_id string, event_id string, ts timestamp_ntz, arrival int, partial boolean, state_delta map<string,string>"
    rows = [("a", "u", f"s{i % 5}", f"e{i}", dt.datetime(2024, 1, 1, 0, i), 0, False, {"k": str(i)}) for i in range(40)]
    got = sessions.session_state(spark.createDataFrame(rows, kinds)).collect()
    assert sorted((r["session_id"], r["value"]) for r in got) == [(f"s{i}", str(35 + i)) for i in range(5)]
    assert used == ["14"] and spark.conf.get(sessions.PARTITIONS) == before


def test_restated_sessions_are_folded_from_one_copy(spark, tmp_path):
    """All events of a restated session as they are now, and the batch's own events of the others, keys null or not."""
    stream = SessionStream(spark, str(tmp_path / "out"), keep_recent=3)
    first = [event(1, "s"), event(2, "s"), event(3, "t"), event(4, None)]
    second = [event(2, "s", texts=["changed"], arrival=1), event(5, "t"), event(6, None)]
    for number, (rows, changed) in enumerate(((first, "false"), (second, "event_id = 'e00002'"))):
        stream.apply(frame(spark, rows).selectExpr("*", f"{changed} AS changed"), number)
    folded = spark.read.schema(EVENT_SCHEMA).parquet(f"{stream.folder}/refolded")
    assert sorted((str(r.session_id), r.event_id, r.texts[0]) for r in folded.collect()) == [
        ("None", "e00006", "text 6"), ("s", "e00001", "text 1"), ("s", "e00002", "changed"), ("t", "e00005", "text 5"),
    ]
    assert stream.recent().count() == 6


def test_each_batch_has_a_file_for_each_core(spark, tmp_path):
    from tablesteward.workload import history

    rows = frame(spark, [event(n) for n in range(400)])
    source, files = history.event_files(spark, rows, 4, "event_id", "arrival")
    assert files == spark.sparkContext.defaultParallelism
    assert spark.read.parquet(source).count() == 400 and len(spark.read.parquet(source).inputFiles()) == 4 * files
