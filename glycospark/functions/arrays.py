"""Expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it.

    A column that a later filter or projection uses is put in its place as often as it is
    named there, and so are the columns it uses; a lambda's argument is not.
    """
    return F.get(F.transform(F.array(x), f), F.lit(0))
