"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from netlex.plans import communities, graphs, nulls, text, traversal

QUERIES = {}
SQL = {}
for module in (graphs, traversal, communities, nulls, text):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
