"""Registered queries, one module per family of operators."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

FAMILIES = ["inputs", "rows", "joins", "windows", "aggregates", "charts", "models", "streams"]


def load() -> ModuleType:
    """Import every family, which registers its queries, and return the catalog."""
    for family in FAMILIES:
        import_module(f"barloom.plans.{family}")
    return import_module("barloom.plans.catalog")
