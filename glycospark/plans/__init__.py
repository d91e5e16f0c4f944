"""Composed pipelines and the query catalogue over the driver tables."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries():
    """(queries, SQL) after loading every ``q_*`` module."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
    from .catalog import ORACLES, QUERIES

    return QUERIES, ORACLES
