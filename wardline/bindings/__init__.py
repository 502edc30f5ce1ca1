"""Queries on the given test tables, each with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text_queries", "label_queries", "curation_queries", "action_queries"]


def registered() -> tuple[dict, dict]:
    """``(queries, SQL)`` by name."""
    from wardline.bindings import base

    for module in MODULES:
        import_module(f"wardline.bindings.{module}")
    return base.QUERIES, base.ORACLES
