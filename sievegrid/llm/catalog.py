"""All named queries of the subpackage."""

from __future__ import annotations

from . import queries

QUERIES = dict(queries.QUERIES)
SQL = dict(queries.SQL)
