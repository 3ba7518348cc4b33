"""All queries of the library proper, by name."""

from __future__ import annotations

from . import joins, limits, planning, records, scalars, sequences, sources

_MODULES = (scalars, joins, limits, sequences, planning, records, sources)
QUERIES = {name: query for m in _MODULES for name, (query, _) in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
