"""All named queries of the core."""

from __future__ import annotations

from . import context, integrity, records, retrieval, stores, texts

_PARTS = (retrieval, context, texts, records, stores, integrity)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}


def flagship(spark, d: str):
    return QUERIES["L5_hybrid"](spark, d)
