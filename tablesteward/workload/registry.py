"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from tablesteward.workload import answers, catalog, governance, history, search

MODULES = (catalog, search, governance, answers, history)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
