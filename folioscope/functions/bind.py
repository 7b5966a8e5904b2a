"""Name a value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside a lambda Spark re-evaluates every captured expression per element,
    so a captured ``regexp_extract_all`` would make a linear rule quadratic. A
    lambda variable holds the computed value instead.
    """
    return F.transform(F.array(value), body)[0]
