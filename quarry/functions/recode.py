"""Label recodes, casts, rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binary_recode(c: Column, negative_value) -> Column:
    """``negative_value`` -> 0, anything else (including NULL) -> 1, as int."""
    return F.when(c == F.lit(negative_value), F.lit(0)).otherwise(F.lit(1)).cast("int")


def sign_to_binary(c: Column) -> Column:
    """label -1 -> 0, other values unchanged."""
    return F.when(c == -1, F.lit(0)).otherwise(c)


def to_int(c: Column) -> Column:
    """F12 (strict): ANSI cast; use ``functions.logparse.tolerant_int`` for dirty text."""
    return c.cast("int")


def to_double(c: Column) -> Column:
    return c.cast("double")


def round_metric(c: Column, digits: int = 4) -> Column:
    """rounding for display; apply after choosing a best value, never before."""
    return F.round(c, digits)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as double; NULL when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
