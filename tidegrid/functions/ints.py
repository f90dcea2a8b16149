"""Whole-number arithmetic on nanoseconds, which doubles cannot hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: int | Column) -> Column:
    """Quotient rounded down, exact in 64 bits."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a - F.pmod(a, b), b)
