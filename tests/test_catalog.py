"""Profiling, cards and the index job on small made tables."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tablesteward.functions.vectors import hashed_term_embedder
from tablesteward.operators import cardindex, cards, profile
from tablesteward.plans.reindex import reindex
from tablesteward.sources.footers import FooterStore, Refresh, column_bytes, footer_inventory, table_rows
from tablesteward.sources.snapshots import SnapshotTable
from tablesteward.sources.tables import TableRef, catalog_tables, data_files, partition_summaries, resolve_datasets


@pytest.fixture(scope="module")
def refs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    nested = "id bigint, kind string, city string, code string, tags array<string>, at struct<day:date,spots:array<struct<x:int>>>"
    rows = [
        (i, "ozone" if i % 2 else "lead|dust", f"town {i}", f"{i:03d}", ["a"], (dt.date(2026, 5, 1), [(i,)])) for i in range(1, 9)
    ]
    spark.createDataFrame(rows, nested).repartition(3).write.parquet(f"{folder}/air_daily.parquet")
    days = spark.range(40).select("id", F.expr("date_add(DATE'2026-01-01', CAST(id % 4 AS INT)) AS day"), F.lit("n").alias("note"))
    days.write.partitionBy("day").parquet(f"{folder}/by_day.parquet")
    return [
        TableRef("p", "d_one", "air_daily", f"{folder}/air_daily.parquet", description="Daily air.", sample_order=("id",)),
        TableRef("p", "d_one", "by_day", f"{folder}/by_day.parquet", sample_order=("id",)),
        TableRef("p", "d_one", "a_view", f"{folder}/by_day.parquet", table_type="VIEW"),
    ]


def test_nested_columns(spark, refs):
    rows = profile.catalog_columns(spark, refs[:1]).orderBy("ordinal").collect()
    assert [(r["path"], r["type"], r["mode"]) for r in rows] == [
        ("id", "BIGINT", "NULLABLE"), ("kind", "STRING", "NULLABLE"), ("city", "STRING", "NULLABLE"), ("code", "STRING", "NULLABLE"),
        ("tags", "STRING", "REPEATED"), ("at", "STRUCT", "NULLABLE"), ("at.day", "DATE", "NULLABLE"), ("at.spots", "STRUCT", "REPEATED"),
        ("at.spots.x", "INT", "NULLABLE"),
    ]
    assert profile.flatten(refs[0].read(spark)).columns == ["id", "kind", "city", "code", "tags", "at.day", "at.spots"]


def test_card_text(spark, refs):
    found = {r["table_id"]: r for r in cards.collect_cards(spark, refs, 3).collect()}
    air = found["p.d_one.air_daily"]
    assert air["card"] == "\n".join(
        [
            "# Table: `p.d_one.air_daily`", "Description: Daily air.", "Approximate rows: 8", "", "## Columns", "- `id` (BIGINT)",
            "- `kind` (STRING)", "- `city` (STRING)", "- `code` (STRING)", "- `tags` (STRING, REPEATED)", "- `at` (STRUCT)",
            "- `at.day` (DATE)", "- `at.spots` (STRUCT, REPEATED)", "- `at.spots.x` (INT)", "", "## Sample rows (3)",
            "id | kind | city | code", "--- | --- | --- | ---", "1 | ozone | town 1 | 001", "2 | lead\\|dust | town 2 | 002",
            "3 | ozone | town 3 | 003",
        ]
    )
    assert air["embed_text"].endswith("Representative values:\n- kind: lead\\|dust, ozone")
    assert "Table name: air daily\nDataset: d one\n" in air["embed_text"]
    assert air["content_hash"] == hashlib.sha256(f"{air['card']}\0{air['embed_text']}".encode()).hexdigest()
    by_day = found["p.d_one.by_day"]["card"]
    assert "Partitioned by: DAY on `day`" in by_day and "Approximate rows: 40" in by_day
    view = found["p.d_one.a_view"]["card"]
    assert "Type: VIEW" in view and "Sample rows" not in view


def test_sample_options(spark, refs):
    assert profile.sample_cells(spark, refs, 0).count() == 0
    assert profile.sample_rows(refs[0].read(spark), 4).count() == 4
    missing = TableRef("p", "d", "gone", "/tmp/no-such-table.parquet", schema=refs[1].read(spark).schema)
    kept = profile.sample_cells(spark, [missing, refs[1]], 2)
    assert {r["table_id"] for r in kept.collect()} == {"p.d_one.by_day"}
    plan = profile.sample_rows(refs[0].read(spark), 2, ("id",))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(id,ScalarSubquery" in plan


def test_representative_value_rules(spark):
    cells = [
        ("kind", ["a", "a", "b"]), ("all_distinct", ["a", "b", "c"]), ("with_null", ["a", "b", "NULL"]), ("nulls", ["NULL"] * 3),
        ("long", ["x" * 41, "x" * 41, "y"]), ("numbers", ["01", "01", "7:30"]), ("Site_Name", ["a", "a", "b"]), ("mixed", ["01", "01", "b"]),
    ]
    rows = [("t", i, name, "STRING", n, v) for i, (name, values) in enumerate(cells) for n, v in enumerate(values)]
    rows += [("t", 99, "count", "INT", n, "1") for n in range(3)]
    found = profile.distinctive_values(spark.createDataFrame(rows, profile.CELL_SCHEMA)).orderBy("position").collect()
    assert [(r["column"], r["values"]) for r in found] == [("kind", "a, b"), ("with_null", "a, b"), ("mixed", "01, b")]
    many = [("t", i, f"c{i:02d}", "STRING", n, "v") for i in range(12) for n in range(2)]
    kept = profile.distinctive_values(spark.createDataFrame(many, profile.CELL_SCHEMA)).orderBy("position").collect()
    assert [r["column"] for r in kept] == [f"c{i:02d}" for i in range(8)]


def test_logical_bytes(spark, refs):
    sizes = {r["column"]: (r["rows"], r["logical_bytes"]) for r in profile.column_logical_bytes(spark, refs[:1]).collect()}
    assert sizes == {"id": (8, 64), "kind": (8, 56), "city": (8, 48), "code": (8, 24), "tags": (8, 8), "at": (8, 64)}


def test_footers(spark, refs):
    inventory = footer_inventory(data_files(spark, refs[:2]))
    assert {r["table_id"]: r["num_rows"] for r in table_rows(inventory).collect()} == {"p.d_one.air_daily": 8, "p.d_one.by_day": 40}
    columns = {(r["table_id"], r["column"]) for r in column_bytes(inventory).where("plain_bytes > 0").collect()}
    assert ("p.d_one.air_daily", "at") in columns and ("p.d_one.by_day", "day") not in columns


def test_footer_store(spark, tmp_path):
    """Only files that are new or changed are read; two tables may share files, and one may vanish."""
    path = str(tmp_path / "t.parquet")
    spark.range(90).repartition(9).write.parquet(path)
    refs = [TableRef("p", "d", "t", path), TableRef("p", "d", "also_t", path)]
    store = FooterStore(spark, str(tmp_path / "footers"))
    assert store.refresh(refs) == Refresh(0, 18, 0, 0) and store.refresh(refs) == Refresh(0, 0, 18, 0)
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    assert store.refresh(refs) == Refresh(1, 2, 18, 0)
    gone = min(tmp_path.glob("t.parquet/part-*"))
    gone.unlink()
    assert store.refresh(refs[:1]) == Refresh(2, 0, 9, 11)
    fresh = footer_inventory(data_files(spark, refs[:1]))
    columns = fresh.columns
    assert sorted(store.read().select(*columns).collect()) == sorted(fresh.collect())
    assert store.read().agg({"rows": "sum"}).first()[0] == table_rows(fresh).first()["num_rows"] < 95


def test_files_belong_to_one_folder(spark, tmp_path):
    """A folder whose path ends like another's."""
    for place in ("wh/a.parquet", "backup/wh/a.parquet"):
        spark.range(30).repartition(3).write.parquet(str(tmp_path / place))
    refs = [TableRef("p", "d", place, str(tmp_path / place)) for place in ("wh/a.parquet", "backup/wh/a.parquet")]
    counts = {r["table_id"]: r["count"] for r in data_files(spark, refs).groupBy("table_id").count().collect()}
    assert counts == {"p.d.wh/a.parquet": 3, "p.d.backup/wh/a.parquet": 3}


def test_session_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS stock")
    frame = spark.range(20).select("id", F.col("id").alias("shop"), F.expr("DATE'2026-01-01' AS day"))
    frame.write.partitionBy("day").bucketBy(4, "shop").mode("overwrite").saveAsTable("stock.sales")
    found = catalog_tables(spark, "stock")
    assert [r.table_id for r in found] == ["warehouse.stock.sales"]
    assert partition_summaries(spark, found)["warehouse.stock.sales"] == ("DAY on `day`", ["shop"])
    card = cards.collect_cards(spark, found, 2).first()["card"]
    assert "Clustered by: shop" in card and "Approximate rows: 20" in card
    assert resolve_datasets(spark, " stock , other.things,") == [("warehouse", "stock"), ("other", "things")]
    assert ("warehouse", "stock") in resolve_datasets(spark, "")


def test_index_job(spark, refs, tmp_path):
    store, embedder = SnapshotTable(spark, str(tmp_path / "index")), hashed_term_embedder(32)

    def run(tables, **options):
        report = reindex(spark, tables, store, embedder, "hashed", 32, **options)
        return report.tables, report.skipped, report.written, report.pruned

    assert run(refs, dry_run=True) == (3, 0, 0, 0) and store.current() is None
    assert run([]) == (0, 0, 0, 0)
    assert run(refs) == (3, 0, 3, 0)
    assert run(refs) == (3, 3, 0, 0) and store.current() == 0
    assert run(refs, force=True) == (3, 0, 3, 0)
    assert run(refs, sample=2) == (3, 1, 2, 0)
    assert run(refs[:1], sample=2) == (1, 1, 0, 0) and store.read().count() == 3
    assert run(refs[:1], sample=2, prune_missing=True) == (1, 1, 0, 2)
    assert [r["doc_id"] for r in store.read().collect()] == ["p.d_one.air_daily"]
    other = reindex(spark, refs[:1], store, hashed_term_embedder(16), "other", 16, sample=2)
    assert other.written == 1 and store.read().first()["embedding_dimensions"] == 16


def test_index_changes(spark):
    schema = "doc_id string, content_hash string, embedding_model string, embedding_dimensions int"
    index = spark.createDataFrame([("a", "1", "m", 8), ("b", "1", "m", 8), ("c", "1", "x", 8), ("d", "1", "m", 4), ("z", "1", "m", 8)], schema)
    live = spark.createDataFrame([(d, h, "m", 8) for d, h in [("a", "1"), ("b", "2"), ("c", "1"), ("d", "1"), ("e", "1")]], schema)
    changes = {r["doc_id"]: r["change"] for r in cardindex.index_diff(live, index, "m", 8).collect()}
    assert changes == {"a": "unchanged", "b": "changed", "c": "changed", "d": "changed", "e": "new", "z": "removed"}
    stale = cardindex.stale_cards(live, index, "m", 8)
    assert sorted(r["doc_id"] for r in stale.collect()) == ["b", "c", "d", "e"]
    updated = cardindex.upsert(index, stale)
    assert cardindex.stale_cards(live, updated, "m", 8).count() == 0 and updated.count() == 6
    assert cardindex.prune(updated, live).count() == 5 and cardindex.pruned_count(updated, live).first()[0] == 1


def test_null_leads_fill_a_sample(spark):
    from tablesteward.operators.profile import sample_rows

    for leads, want in (([3, None, None, None], 4), ([None, None, None], 3), ([1, 2, 3, 4, 5, 6, None], 5)):
        rows = spark.createDataFrame([(lead, i) for i, lead in enumerate(leads)], "lead int, i int")
        got = [r["lead"] for r in sample_rows(rows, 5, ("lead",)).collect()]
        assert len(got) == want and got[:1] == [min((x for x in leads if x is not None), default=None)]
