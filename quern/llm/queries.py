"""The queries of this subpackage and their SQL, gathered from its ``q_*`` modules."""

from __future__ import annotations

import importlib
import pkgutil

import quern.llm


#: Imported at once, so that whoever imports this module learns whether all can be imported.
MODULES = [importlib.import_module(f"quern.llm.{m.name}") for m in pkgutil.iter_modules(quern.llm.__path__) if m.name.startswith("q_")]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
