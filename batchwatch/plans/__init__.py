"""Named queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

MODULES = ("quality", "many", "drift", "contracts", "monitoring", "incidents", "storage", "streams", "retraining")


def load_all():
    """Import every plan module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"batchwatch.plans.{name}")
    return importlib.import_module("batchwatch.plans.registry")
