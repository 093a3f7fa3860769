"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import choices, contracts, joins, metrics, review, rules, selection, sequences, tables_io

MODULES = (sequences, joins, metrics, selection, choices, rules, review, contracts, tables_io)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = "g1_sessions"
