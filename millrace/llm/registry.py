"""Queries of the corpus operators."""

from __future__ import annotations

import importlib

#: query -> module of this subpackage
OPERATORS = {
    "op1_chat": "chat",
    "op2_mixing": "mixing",
    "op3_toxicity": "toxicity",
    "op4_decontamination": "decontamination",
    "op5_url_filter": "url_filter",
    "op6_sharding": "sharding",
    "op7_near_dedup": "near_dedup",
    "op8_secrets": "secrets",
    "op9_exact_dedup": "exact_dedup",
    "op10_line_dedup": "line_dedup",
}


def _modules():
    return {name: importlib.import_module(f"millrace.llm.{module}") for name, module in OPERATORS.items()}


def queries():
    return {name: module.query for name, module in _modules().items()}


def oracle_sql():
    return {name: module.SQL for name, module in _modules().items() if getattr(module, "SQL", None)}
