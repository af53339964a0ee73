"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it.

    A column that is built in stages grows exponentially when the planner puts
    each stage into the next; the variable of a lambda does not.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))
