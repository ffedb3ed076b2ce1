"""Run registered queries next to their SQL and compare whole results.

    python tests/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """A value both engines print alike."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def type_problems(df, cursor) -> list[str]:
    """Columns whose types differ between the two engines."""
    want = {d[0]: str(d[1]) for d in cursor.description}
    got = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    return [f"{name}: {kind} here, {want.get(name)} in SQL" for name, kind in got.items() if kind != want.get(name)]


def compare(name: str, df, sql: str, connection) -> tuple[str, int]:
    """``("", rows)`` if equal, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = type_problems(df, cursor)
    want = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    if got != want:
        missing = [r for r in want if r not in set(got)][:2]
        surplus = [r for r in got if r not in set(want)][:2]
        return f"{len(got)} rows, want {len(want)}\n   only here:   {surplus}\n   only in SQL: {missing}", len(got)
    return "; ".join(types), len(got)


def main() -> int:
    import __spark_entry__ as entry
    from tablesteward.session import local_session

    arguments = sys.argv[1:]
    sf_dir = arguments.pop(0) if arguments and "/" in arguments[0] else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    connection, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in arguments or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem, rows = compare(name, df, oracle[name], connection) if name in oracle else ("", df.count())
        except Exception as error:  # noqa: BLE001 - reported per query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", 0
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok  " if name in oracle else "rows")
        print(f"{mark} {name:24s} {rows:8d} rows {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
