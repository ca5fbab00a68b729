"""Naming of an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Used several times, or inside a lambda, an expression is otherwise
    computed again each time: common parts are not shared across lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)
