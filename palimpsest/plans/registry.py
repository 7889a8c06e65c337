"""All queries of the core, collected from the plan modules."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["history_queries", "lexical_queries", "lifecycle_queries", "capsule_queries", "graph_queries", "source_queries", "retrieval_queries", "formula_queries", "answer_queries", "upkeep_queries", "law_queries", "learning_queries", "statement_queries"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        found |= getattr(import_module(f"palimpsest.plans.{name}"), attribute)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
