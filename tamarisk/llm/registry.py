"""All queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

import importlib
import pkgutil

from tamarisk import llm


def _gather(attribute: str) -> dict:
    found: dict = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(llm.__path__) if m.name.startswith("queries_")):
        found |= getattr(importlib.import_module(f"{llm.__name__}.{module}"), attribute)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
