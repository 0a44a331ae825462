"""All registered queries and their oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil

MODULES = ("prepare", "features", "selection")


def _collect(kind: str) -> dict:
    out: dict = {}
    here = importlib.import_module("tidepanel.queries")
    names = {m.name for m in pkgutil.iter_modules(here.__path__)}
    for name in MODULES:
        if name in names:
            out.update(getattr(importlib.import_module(f"tidepanel.queries.{name}"), kind))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
