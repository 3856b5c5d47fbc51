"""Registered queries by family."""

from __future__ import annotations

import importlib

FAMILIES = ("sources", "structure", "markdown", "wording", "facts", "outline", "citations", "retrieval", "memory", "runs", "pages", "streams", "tables")


def load_all():
    """Import every family and return the catalogue."""
    for family in FAMILIES:
        importlib.import_module(f"quire.plans.{family}")
    from quire.plans.registry import REGISTRY

    return REGISTRY
