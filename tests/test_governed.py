"""Guarded runs: what is refused, what it is priced at, limits."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tablesteward.plans.governed import Warehouse, finish, governed_sql, run_with_timeout
from tablesteward.sources.tables import TableRef, catalog_tables
from tablesteward.workload.governance import TOPK
from tablesteward.workload.inputs import table_refs

ORDERS = "`warehouse.retail_mart.orders`"


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts") / "by_day.parquet")
    days = spark.range(4000).select("id", F.col("id").alias("n"), F.expr("date_add(DATE'2026-01-01', CAST(id % 4 AS INT)) AS day"))
    days.write.partitionBy("day").parquet(path)
    return Warehouse.open(spark, table_refs(SMALL) + [TableRef("warehouse", "retail_mart", "by_day", path)])


@pytest.mark.parametrize(
    "text, code",
    [
        ("DROP TABLE t", "not_read_only"), ("   ", "empty"), (None, "empty"), ("SELECT 1; DROP TABLE t", "multiple_statements"),
        ("SELECT reflect('java.lang.System', 'getenv', 'HOME')", "escape_hatch"),
        (f"SELECT TRANSFORM(o_orderkey) USING 'cat' AS (k) FROM {ORDERS}", "escape_hatch"),
        (f"SELECT transform(array(o_orderkey), x -> x + 1) FROM {ORDERS} JOIN {ORDERS} USING (o_orderkey)", None), ("SELECT * FROM parquet.`/etc`", "unknown_source"),
        (f"SELECT * FROM parquet.`{SMALL}/orders.parquet`", "unknown_source"), ("SELECT nothing FROM nowhere", "unknown_source"),
    ],
)
def test_refusals(spark, warehouse, text, code):
    run = governed_sql(warehouse, text)
    if code is None:  # what is registered may be read by its path, and lambdas are no scripts
        assert run.status == "success"
        return
    assert (run.status, run.error_code, run.result) == ("error", code, None)
    row = run.envelope(spark).first()
    assert (row["status"], row["row_count"], row["error"]) == ("error", None, run.error)


def test_unregistered_files(spark, warehouse, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "other.parquet"))
    assert governed_sql(warehouse, f"SELECT * FROM parquet.`{tmp_path}/other.parquet`").error_code == "unknown_source"


def test_catalog_tables(spark):
    """Tables of the session catalog are priced like folders, partitions too."""
    spark.sql("CREATE DATABASE IF NOT EXISTS ledger")
    days = spark.range(4000).selectExpr("id", "id AS n", "date_add(DATE'2026-01-01', CAST(id % 4 AS INT)) AS day")
    days.write.partitionBy("day").mode("overwrite").saveAsTable("ledger.sales")
    days.write.mode("overwrite").saveAsTable("ledger.flat")
    ledger = Warehouse.open(spark, catalog_tables(spark, "ledger"))
    whole = governed_sql(ledger, "SELECT sum(n) FROM `warehouse.ledger.sales`")
    day = governed_sql(ledger, "SELECT sum(n) FROM `warehouse.ledger.sales` WHERE day = DATE'2026-01-03'")
    none = governed_sql(ledger, "SELECT sum(n) FROM ledger.sales WHERE day = DATE'2027-01-03'")
    flat = governed_sql(ledger, "SELECT sum(n) FROM ledger.flat")
    assert 0 < day.estimated_bytes < whole.estimated_bytes and flat.estimated_bytes > 0
    assert (none.status, none.estimated_bytes) == ("success", 0)
    assert day.result.first()[0] == sum(n for n in range(4000) if n % 4 == 2)


def test_accepted_run(spark, warehouse):
    run = governed_sql(warehouse, f"```sql\n{TOPK};\n```")
    assert run.status == "success" and run.sql == TOPK
    done = finish(run, spark)
    row = done.envelope(spark).first()
    assert (row["status"], row["columns"], row["row_count"]) == ("success", ["nation", "avg_price"], done.result.count())
    assert row["bytes_billed"] == run.estimated_bytes > 0


def test_price_follows_columns_not_limit(warehouse):
    def price(text):
        return governed_sql(warehouse, text).estimated_bytes

    one = price(f"SELECT o_totalprice FROM {ORDERS}")
    whole = price(f"SELECT * FROM {ORDERS} LIMIT 10")
    assert 0 < one < whole
    assert price(f"SELECT avg(o_totalprice) FROM {ORDERS} WHERE o_totalprice > 5 LIMIT 1") == one
    assert price(f"SELECT count(*) FROM {ORDERS} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {ORDERS})") == one
    assert price("SELECT 1") == 0


def test_price_follows_partitions(warehouse):
    whole = governed_sql(warehouse, "SELECT sum(n) FROM `warehouse.retail_mart.by_day`").estimated_bytes
    day = governed_sql(warehouse, "SELECT sum(n) FROM `warehouse.retail_mart.by_day` WHERE day = DATE'2026-01-02'").estimated_bytes
    rest = governed_sql(warehouse, "SELECT sum(n) FROM `warehouse.retail_mart.by_day` WHERE day <> '2026-01-02'").estimated_bytes
    assert 0 < day < whole and day + rest == whole


def test_stored_inventory_gives_the_same_price(warehouse):
    stored = warehouse.with_stored_inventory()
    assert governed_sql(stored, TOPK).estimated_bytes == governed_sql(warehouse, TOPK).estimated_bytes


def test_ceiling(warehouse):
    price = governed_sql(warehouse, TOPK).estimated_bytes
    assert governed_sql(warehouse, TOPK, max_bytes=price).status == "success"
    run = governed_sql(warehouse, TOPK, max_bytes=price - 1)
    assert (run.status, run.error_code, run.estimated_bytes, run.max_bytes_billed) == ("error", "over_budget", price, price - 1)
    assert "LIMIT does not reduce" in run.error and run.result is None


def test_failing_run_is_a_record(spark, warehouse):
    run = finish(governed_sql(warehouse, f"SELECT raise_error('no') FROM {ORDERS}"), spark)
    assert (run.status, run.error_code) == ("error", "execution_failed")


def test_time_limit(spark, warehouse):
    slow = (
        f"SELECT count(*) AS n FROM {ORDERS} a JOIN {ORDERS} b ON hash(a.o_orderkey, b.o_orderkey) % 2 = 1 "
        f"JOIN {ORDERS} c ON hash(a.o_custkey, b.o_custkey, c.o_orderkey) % 7 = 1"
    )
    run = finish(governed_sql(warehouse, slow), spark, timeout=0.5)
    assert (run.status, run.error_code) == ("error", "timeout")
    assert run_with_timeout(spark, lambda: spark.range(5).count(), 60) == 5
