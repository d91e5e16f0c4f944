"""Registry of the text queries, with their SQL where SQL can say it."""

from __future__ import annotations

import importlib
import pkgutil
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under a name."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return register


def all_queries():
    """(queries, SQL) after loading every ``q_*`` module beside this one."""
    package = __name__.rpartition(".")[0]
    path = importlib.import_module(package).__path__
    for module in sorted(m.name for m in pkgutil.iter_modules(path) if m.name.startswith("q_")):
        importlib.import_module(f"{package}.{module}")
    return QUERIES, ORACLES
