"""All queries of the library by name, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from talus.plans import conversations, imports, search, transactions, writes

PLANS = (conversations, search, writes, imports, transactions)


def queries():
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql():
    return {name: sql for plan in PLANS for name, sql in plan.ORACLE.items()}
