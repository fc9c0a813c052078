"""All registered queries of the engine itself, with their SQL."""

from __future__ import annotations

from . import analysis, data_checks, more_queries, relational

_PARTS = [relational, data_checks, analysis, more_queries]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in _PARTS:
    QUERIES |= _part.R.queries
    ORACLE_SQL |= _part.R.sql

FLAGSHIP = relational.ex_tpch_top_customers
