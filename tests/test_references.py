"""Names found in SQL texts against what Spark's own plans would scan."""

import pytest

from conftest import SMALL
from tablesteward.functions.sqltext import ESCAPE_HATCHES, with_verdict
from tablesteward.operators import references
from tablesteward.plans.governed import Warehouse, governed_sql, scanned_columns
from tablesteward.workload import governance, inputs
from tablesteward.workload.inputs import QUERY_SHAPES, TABLES, table_refs

E, O, L = "warehouse.retail_mart.events", "warehouse.retail_mart.orders", "warehouse.retail_mart.lineitem"


@pytest.fixture(scope="module")
def catalog(spark):
    refs = table_refs(SMALL)
    Warehouse.open(spark, refs)
    for ref in refs:  # the log calls tables by short names too
        ref.read(spark).createOrReplaceTempView(ref.table)
    rows = [(ref.table_id, field.name) for ref in refs for field in ref.read(spark).schema.fields]
    return spark.createDataFrame(rows, "table_id string, column string").cache()


def found(spark, catalog, texts):
    log = spark.createDataFrame(list(enumerate(texts)), "id int, sql string")
    out = {i: set() for i in range(len(texts))}
    for r in references.log_columns(log, "id", "sql", catalog).collect():
        out[r["id"]].add((r["table_id"], r["column"]))
    return [out[i] for i in range(len(texts))]


PLANNED = [
    "SELECT o.o_orderkey, sum(l_quantity) FROM orders o LEFT JOIN lineitem USING (o_orderkey) GROUP BY 1",
    "SELECT EXTRACT(YEAR FROM o_orderdate) AS y FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' ORDER BY y",
    "SELECT x.n FROM (SELECT count(*) AS n, o_custkey AS k FROM orders GROUP BY o_custkey) AS x WHERE x.k IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0)",
    "WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT k FROM a WHERE k > 3) SELECT c.c_name FROM customer AS c JOIN b ON b.k = c.c_custkey",
    "SELECT `o_orderkey` FROM `orders` -- FROM lineitem, l_tax\n WHERE o_comment_like = '' /* o_custkey */",
    "SELECT a.o_orderkey FROM orders a, orders b WHERE a.o_custkey = b.o_custkey",
    "SELECT DISTINCT * FROM region EXCEPT SELECT * FROM region WHERE r_name LIKE 'A%'",
    "SELECT count(*), max(o_totalprice * 2) FROM orders HAVING count(*) > 1",
    "SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS o_totalprice FROM orders ORDER BY o_totalprice",
    "SELECT CASE WHEN event_type = 'o_custkey' THEN value ELSE user_id END FROM `warehouse.retail_mart.events` CROSS JOIN region",
    "SELECT `warehouse.retail_mart.events`.value FROM `warehouse.retail_mart.events`",
]


def planned(spark, text):
    scans = scanned_columns(spark.sql(text.replace(" retail_mart.", " ")), tuple(table_refs(SMALL)))
    return {(scan.table.table_id, column) for scan in scans for column in scan.columns}


def test_log_shapes_equal_the_plan(spark, catalog):
    """Every accepted shape of the log whose columns all exist, in the words that would be run."""
    accepted = [inner.format(u=7, k=3, t="click") for _, inner, verdict in QUERY_SHAPES if verdict == "ok"]
    missing = ("note", "updated_by", "a;b")
    texts = [text for text in accepted if not any(name in text for name in missing)]
    assert len(texts) >= 12
    assert found(spark, catalog, texts) == [planned(spark, text) for text in texts]


def test_other_texts_equal_the_plan(spark, catalog):
    runnable = [text for text in PLANNED if "USING (o_orderkey)" not in text and "o_comment_like" not in text]
    assert found(spark, catalog, runnable) == [planned(spark, text) for text in runnable]


def test_texts_that_name_unknown_columns(spark, catalog):
    got = found(spark, catalog, PLANNED[:1] + PLANNED[5:6] + ["SELECT nothing FROM orders", "DROP TABLE orders", None, ""])
    assert got == [{(O, "o_orderkey"), (L, "l_quantity")}, {(O, "o_orderkey")}, set(), set(), set(), set()]


def test_repeated_texts_and_quoted_words(spark, catalog):
    text = "SELECT value FROM events WHERE event_type = 'SELECT user_id FROM events'"
    assert found(spark, catalog, [text, f"```sql\n{text};\n```", text]) == [{(E, "value"), (E, "event_type")}] * 3


def test_long_text(spark, catalog):
    text = "SELECT " + ", ".join(f"value + {i} AS v{i}" for i in range(3000)) + " FROM events WHERE user_id IN (" + "1, " * 5000 + "2)"
    assert found(spark, catalog, [text]) == [{(E, "value"), (E, "user_id")}]


def test_refusals_as_the_governed_run(spark, catalog):
    """Code by code what the governed run says of the same texts, in the names that it knows."""
    texts = [text.format(u=7, k=3, t="click") for text, _ in governance.REFUSED]
    log = spark.createDataFrame(list(enumerate(texts)), "event_id int, sql string")
    got = {r["event_id"]: r["code"] for r in references.log_refusals(log, "event_id", "sql", catalog, ESCAPE_HATCHES).collect()}
    assert [got[i] for i in range(len(texts))] == [code for _, code in governance.REFUSED]
    warehouse = Warehouse.open(spark, table_refs(SMALL))
    full = "`warehouse.retail_mart.events`"
    for i, text in enumerate(texts):
        named = text.replace("retail_mart.events", "events").replace("`warehouse.events`", "events").replace(" events", f" {full}")
        # a table that Spark does not find either fails there when it is planned
        same = {got[i]} | ({"execution_failed"} if "later" in text else set())
        assert governed_sql(warehouse, named).error_code in same, named


def test_windows_do_not_shuffle(spark, catalog):
    log = inputs.query_log(spark, SMALL)
    plan = references.marked_tokens(references.distinct_texts(log, "sql"))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_texts_are_read_once(spark, catalog, monkeypatch):
    """Words of the log are stored by one projection without a filter; what follows reads no text again."""
    plans, store = [], references.materialize

    def stored(df, purpose):
        if purpose == "log-words":
            plans.append(df._jdf.queryExecution().toString().split("== Physical Plan ==")[1])
        return store(df, purpose)

    monkeypatch.setattr(references, "materialize", stored)
    log = inputs.query_log(spark, SMALL)
    sizes = catalog.selectExpr("table_id", "column", "1L AS logical_bytes")
    for rows in (references.log_costs(log, "query_id", "sql", sizes), references.log_columns(log, "query_id", "sql", sizes)):
        assert "regexp_extract_all" not in rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert len(plans) == 2 and all(p.count("regexp_extract_all") == 1 and "+- Filter" not in p for p in plans)


def test_verdict_of_shapes_is_as_stated(spark):
    texts = [(i, text.format(u=7, k=3, t="click")) for i, (text, _, _) in enumerate(QUERY_SHAPES)]
    told = with_verdict(spark.createDataFrame(texts, "id int, sql string"), "sql").orderBy("id").collect()
    assert [r["verdict"] for r in told] == [verdict for _, _, verdict in QUERY_SHAPES]
    assert set(TABLES) >= {"events", "orders"}
