"""Names of the queries and their SQL over the driver's tables."""

from __future__ import annotations

from stellwerk.plans import queries, sql

QUERIES = queries.QUERIES
ORACLE_SQL = sql.ORACLE_SQL
