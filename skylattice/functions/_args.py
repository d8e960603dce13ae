"""Argument handling shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    """A column from a column, a column name or a number."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def num(value) -> Column:
    """Like :func:`col`, with Python numbers made doubles."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(float(value))
    return col(value)


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)
