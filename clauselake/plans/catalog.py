"""Registry of the engine's named queries."""

from __future__ import annotations

from . import functions, records, relational, retrieval, text

FLAGSHIP = "stat_category"
QUERIES = {**relational.QUERIES, **text.QUERIES, **retrieval.QUERIES, **functions.QUERIES, **records.QUERIES}
ORACLE_SQL = {**relational.ORACLE_SQL, **text.ORACLE_SQL, **retrieval.ORACLE_SQL, **functions.ORACLE_SQL, **records.ORACLE_SQL}
