"""The registered queries and their SQL, gathered from this package's ``q_*`` modules."""

from __future__ import annotations

import importlib
import pkgutil

import quern.plans

_MODULES = [importlib.import_module(f"quern.plans.{m.name}") for m in pkgutil.iter_modules(quern.plans.__path__) if m.name.startswith("q_")]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
