"""Guarded SQL: nothing is read before a refusal, and overlapping runs leave the session alone."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import SMALL

from tablesteward.plans.governed import Warehouse, governed_sql
from tablesteward.workload.governance import TOPK
from tablesteward.workload.inputs import table_refs


@pytest.fixture(scope="module")
def warehouse(spark):
    return Warehouse.open(spark, table_refs(SMALL))


def test_path_relations_run_no_job(spark, warehouse):
    context = spark.sparkContext
    context.setJobGroup("path-relation", "must stay empty")
    try:
        spark.range(1).collect()
        before = len(context.statusTracker().getJobIdsForGroup("path-relation"))
        run = governed_sql(warehouse, f"SELECT * FROM json.`{SMALL}`")
        ran = len(context.statusTracker().getJobIdsForGroup("path-relation")) - before
    finally:
        context._jsc.clearJobGroup()
    assert run.error_code == "unknown_source" and ran <= 1  # the text's own audit


def test_overlapping_runs(spark, warehouse):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with ThreadPoolExecutor(8) as pool:
        runs = list(pool.map(lambda _: governed_sql(warehouse, TOPK), range(16)))
    assert {r.status for r in runs} == {"success"} and len({r.estimated_bytes for r in runs}) == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_cached_tables_are_priced(spark, warehouse):
    name = next(f"`{ref.table_id}`" for ref in warehouse.refs if ref.table == "nation")
    text = f"SELECT n_nationkey FROM {name}"
    plain = governed_sql(warehouse, text).estimated_bytes
    spark.table(name).cache()
    try:
        run = governed_sql(warehouse, text)
    finally:
        spark.table(name).unpersist()
    assert run.status == "success" and run.estimated_bytes >= plain > 0
