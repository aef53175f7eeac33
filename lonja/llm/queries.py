"""Queries p3_ to p10_ of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in ("q_text", "q_values", "q_sizes", "q_subjects", "q_entities", "q_products"):
    _m = importlib.import_module(f"lonja.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
