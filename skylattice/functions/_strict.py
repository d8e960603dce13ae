"""Strict and lenient results of parsing columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_or_null(value: Column, source: Column, message: str, strict: bool) -> Column:
    """``value``, or an error for sources that gave NULL where ``strict``."""
    if not strict:
        return value
    failure = F.raise_error(F.concat(F.lit(f"{message}: "), source.cast("string")))
    return F.coalesce(value, F.when(source.isNotNull(), failure))
