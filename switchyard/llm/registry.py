"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from switchyard.llm import queries as q


def queries() -> dict:
    return {name: plan for name, plan in vars(q).items() if name.startswith("op") and callable(plan)}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(q, f"{name.split('_')[0].upper()}_SQL") for name in queries() if hasattr(q, f"{name.split('_')[0].upper()}_SQL")}
