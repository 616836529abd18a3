"""The engine's queries and the SQL that each must agree with."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans
from .registry import REGISTRY

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    importlib.import_module(f"{plans.__name__}.{_m}")


def queries():
    return {k: q.run for k, q in REGISTRY.items()}


def oracle_sql():
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}


def operators() -> dict[str, list[str]]:
    """The inventory's operator ids and the queries that exercise each."""
    out: dict[str, list[str]] = {}
    for k, q in REGISTRY.items():
        for o in q.operators:
            out.setdefault(o, []).append(k)
    return dict(sorted(out.items()))
