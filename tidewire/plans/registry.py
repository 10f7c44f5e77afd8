"""Named queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from tidewire.plans import assembly_queries, edition_queries, editorial_queries, intake_queries, news_queries, payload_queries, record_queries, store_queries, text_queries

QUERIES: dict = {**news_queries.QUERIES, **text_queries.QUERIES, **editorial_queries.QUERIES, **payload_queries.QUERIES, **assembly_queries.QUERIES, **store_queries.QUERIES, **intake_queries.QUERIES, **edition_queries.QUERIES, **record_queries.QUERIES}
ORACLE_SQL: dict = {**news_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **editorial_queries.ORACLE_SQL, **payload_queries.ORACLE_SQL, **assembly_queries.ORACLE_SQL, **store_queries.ORACLE_SQL, **intake_queries.ORACLE_SQL, **edition_queries.ORACLE_SQL, **record_queries.ORACLE_SQL}
