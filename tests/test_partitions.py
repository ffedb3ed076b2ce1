"""Hash-partitioned tables: changes touch their partitions only, versions stay readable."""

import pytest
from pyspark.sql import functions as F

from tablesteward.functions.vectors import hashed_term_embedder
from tablesteward.plans.reindex import reindex
from tablesteward.sources.partitions import PartitionedTable
from tablesteward.sources.tables import folder_tables


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_touch_their_partitions(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), ["k"], partitions=16)
    with pytest.raises(ValueError):
        table.change(deletes=spark.range(1).withColumnRenamed("id", "k"))
    assert table.read() is None and table.current() is None
    base = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert table.write(base) == 0 and len(table.manifest().partitions) == 16
    fresh = spark.createDataFrame([(3, -3), (900, -900), (None, 7)], "k long, v long")
    gone = spark.createDataFrame([(5,), (3,), (12345,)], "k long")
    assert table.change(fresh, gone) == 1
    want = {i: i * 2 for i in range(400) if i != 5} | {3: -3, 900: -900}
    got = {r.k: r.v for r in table.read().collect()}
    assert got == want | {None: 7}
    rewritten = [n for n, version in table.manifest().partitions.items() if version == 1]
    assert 0 < len(rewritten) <= 6
    folders = {p.name for p in (tmp_path / "t" / "version=1").glob("partition_number=*")}
    assert folders == {f"partition_number={n}" for n in rewritten}
    assert table.change(spark.createDataFrame([(None, 8)], "k long, v long")) == 2
    assert [r.v for r in table.read().where("k IS NULL").collect()] == [8]
    assert table.change(deletes=gone.where("false")) == 2
    assert rows_of(table.read(0)) == rows_of(base)
    table.change(deletes=table.read().select("k"))
    assert table.read().count() == 0 and table.manifest().partitions == {}
    table.change(fresh)
    assert table.read().count() == 3


def test_failed_change_leaves_the_table(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), ["a", "b"], partitions=4)
    table.write(spark.range(20).selectExpr("id AS a", "id % 3 AS b", "'x' AS v"))
    broken = spark.range(3).selectExpr("id AS a", "id AS b", "raise_error('no') AS v")
    with pytest.raises(Exception, match="no"):
        table.change(broken)
    assert table.current() == 0 and table.read().count() == 20
    purged = spark.range(2).selectExpr("id AS a", "id AS b")
    assert table.change(deletes=purged) == 1 and table.read().count() == 18


def test_index_in_partitions(spark, tmp_path):
    for name in ("a", "b", "c"):
        spark.range(5).withColumn("kind", F.lit(name)).write.parquet(str(tmp_path / f"{name}.parquet"))
    refs = folder_tables(str(tmp_path), ["a", "b", "c"], "d", "p")
    store = PartitionedTable(spark, str(tmp_path / "index"), ["doc_id"], partitions=32)

    def run(tables, **options):
        report = reindex(spark, tables, store, hashed_term_embedder(16), "hashed", 16, **options)
        return report.written, report.pruned

    assert run(refs) == (3, 0) and run(refs) == (0, 0) and store.current() == 0
    spark.range(9).withColumn("other", F.lit("b")).write.mode("overwrite").parquet(str(tmp_path / "b.parquet"))
    assert run(refs[:2], prune_missing=True) == (1, 1)
    assert sorted(r.doc_id for r in store.read().collect()) == ["p.d.a", "p.d.b"]
    assert sum(version == 1 for version in store.manifest().partitions.values()) == 1
