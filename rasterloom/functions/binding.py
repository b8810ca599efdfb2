"""Values computed once per row, and literal tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column | str, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once per row.

    A column used inside a lambda may be merged into it and then be computed per element; bound
    to a lambda variable it cannot.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def int_array(values) -> Column:
    """A literal array of integers."""
    return F.expr(f"array({','.join(str(int(v)) for v in values)})")
