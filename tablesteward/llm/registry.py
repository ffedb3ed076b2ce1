"""The queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from tablesteward.llm import (
    alignment,
    annsearch,
    bpe,
    centroids,
    language,
    maxent,
    mixing,
    packing,
    pii,
    quality,
    secretscan,
    sharding,
    simhash,
)

MODULES = (
    annsearch, bpe, language, maxent, mixing, pii, quality, secretscan, sharding, simhash, alignment, packing, centroids,
)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
