"""All queries of the text operators and their SQL."""

from __future__ import annotations

from tidepanel.llm import queries_audit, queries_free, queries_native


def queries() -> dict:
    return {**queries_free.QUERIES, **queries_native.QUERIES, **queries_audit.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**queries_free.ORACLES, **queries_native.ORACLES, **queries_audit.ORACLES}
