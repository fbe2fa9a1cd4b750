"""All queries of the library and the SQL each is compared with."""

from __future__ import annotations

from .plans import activity_queries, audit_queries, contact_queries, ingest_queries, kept_queries, outreach_queries, resolve_queries, rule_queries, scoring_queries, text_queries

_ALL = {**activity_queries.QUERIES, **audit_queries.QUERIES, **text_queries.QUERIES, **resolve_queries.QUERIES, **scoring_queries.QUERIES, **ingest_queries.QUERIES, **outreach_queries.QUERIES, **contact_queries.QUERIES, **kept_queries.QUERIES, **rule_queries.QUERIES}


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
