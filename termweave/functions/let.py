"""Binding a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed. Inside a lambda an outer expression would run once per element."""
    return F.element_at(F.transform(F.array(value), body), 1)
