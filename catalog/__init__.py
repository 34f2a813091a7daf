"""Queries over the driver tables and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ["calibration", "evaluation", "tables", "vectors", "images", "trust"]


def load():
    """Import every catalogue module and return ``(queries, oracles)``."""
    from catalog import registry
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
    return registry.QUERIES, registry.ORACLES
