"""Evaluate a column once and use it many times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also when ``body`` uses it per array element."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))
