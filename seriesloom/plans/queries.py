"""All queries of the library over the driver's tables, and the SQL of each."""

from __future__ import annotations

from . import q_data, q_eval, q_events, q_files, q_records, q_windows

MODULES = (q_windows, q_events, q_data, q_eval, q_records, q_files)
QUERIES = {name: fn for m in MODULES for name, fn in m.Q.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
