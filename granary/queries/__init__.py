"""Registered queries: a module for each area, each with QUERIES = {name: (function, SQL or None)}."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries() -> dict:
    """Every query of the modules in this package, by name."""
    found: dict = {}
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        found.update(importlib.import_module(f"{__name__}.{m.name}").QUERIES)
    return found
