"""All queries of this subpackage, by name."""

from __future__ import annotations

import importlib

_MODULES = ["percentile_queries", "encoding_queries", "mixing_queries", "content_queries"]

QUERIES: dict = {}
ORACLE: dict = {}
for _m in _MODULES:
    _found = importlib.import_module(f"sitewise.llm.{_m}")
    QUERIES |= _found.QUERIES
    ORACLE |= _found.ORACLE
