"""Named queries over the driver's tables, by family; each module has QUERIES and SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("advantage", "metrics", "batch", "text", "pipeline", "streams", "recipes", "checks", "contracts")


def _modules():
    return [importlib.import_module(f"millrace.plans.{name}") for name in FAMILIES]


def queries():
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
