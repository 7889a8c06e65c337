"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["p3_queries", "p1_queries", "p4_queries", "p5_queries", "p7_queries", "p8_queries", "p9_queries"]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"palimpsest.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
