"""Every registered query of the routing data model, with its SQL."""

from __future__ import annotations

from switchyard.plans import analytics, integrity, prompts


def queries() -> dict:
    return {**prompts.QUERIES, **integrity.QUERIES, **analytics.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**prompts.SQL, **integrity.SQL, **analytics.SQL}
