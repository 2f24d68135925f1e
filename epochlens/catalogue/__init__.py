"""Registered queries, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

import importlib

_MODULES = ("scalars", "catalog", "pairing", "pixels", "evidence", "rules", "screening", "timeline", "search", "lineage", "tables")


def load():
    """Import every query module once and return the registry."""
    from epochlens.catalogue import registry

    for name in _MODULES:
        importlib.import_module(f"epochlens.catalogue.{name}")
    return registry.QUERIES
