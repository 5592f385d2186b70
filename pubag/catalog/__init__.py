"""Registry of the checked queries: name -> Spark callable, name -> oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = ["basic", "sampling", "evaluation", "ensemble", "experiments", "learners", "ensemble_more", "explain", "more_ops"]


def _mods():
    return [importlib.import_module(f"pubag.catalog.{m}") for m in _MODULES]


def all_queries() -> dict:
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_sql() -> dict:
    out = {}
    for m in _mods():
        out.update(m.SQL)
    return out
