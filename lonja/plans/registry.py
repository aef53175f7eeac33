"""All core queries and their SQL, collected from the plan modules."""

from __future__ import annotations

from lonja.plans import listing_queries, official_queries, problems, source_queries, table_queries

MODULES = (problems, listing_queries, official_queries, table_queries, source_queries)
FLAGSHIP = listing_queries.market_reference


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
