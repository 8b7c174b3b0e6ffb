"""Every query over the driver's tables with its DuckDB equivalent."""

from __future__ import annotations

from talkgrain.plans import backup_queries, detail_queries, lifecycle_queries, live_queries, session_queries, signal_queries, text_queries, turn_queries, vector_queries

MODULES = [session_queries, turn_queries, text_queries, vector_queries, lifecycle_queries, live_queries, signal_queries, detail_queries, backup_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
