"""Row limits, overflow, sort policies, paging."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: default and hard row limits by kind of service
LIMITS = {"query": (2000, 20_000_000), "datasets": (10_000, 1_000_000), "parameters": (100, 20_000_000)}


def effective_limit(asked: int | None, kind: str = "query") -> int:
    """The limit that applies; requests above the hard limit are lowered with a warning."""
    default, hard = LIMITS[kind]
    if asked is None:
        return default
    if asked > hard:
        warnings.warn(f"limit lowered from {asked} to {hard}", stacklevel=2)
        return hard
    return asked


def limited(df: DataFrame, n: int, *order) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def overflow(df: DataFrame, n: int) -> DataFrame:
    """One row: number of rows delivered under a limit, and whether there were more.

    Stops reading after ``n + 1`` rows.
    """
    counted = df.limit(n + 1).agg(F.count(F.lit(1)).alias("found"))
    return counted.select(F.least(F.col("found"), F.lit(n)).alias("matched"),
                          F.when(F.col("found") > n, "OVERFLOW").otherwise("OK").alias("status"))


def sort_keys(user: list[str] | None, fixed: str | None = None, fallback: str | None = None,
              descending: bool = False) -> list[Column]:
    """User keys, else the fixed key, else the fallback; one direction for all."""
    from .relational import ordering

    names = user or ([fixed] if fixed else [fallback] if fallback else [])
    return [ordering(name, descending) for name in names]


def page(df: DataFrame, key, size: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` in key order."""
    keys = key if isinstance(key, (list, tuple)) else [key]
    return df.orderBy(*keys).offset(offset).limit(size)


def page_after(df: DataFrame, key: str, size: int, last=None) -> DataFrame:
    """The page following the key value ``last``; reads no earlier rows, unlike offsets."""
    if last is not None:
        df = df.filter(F.col(key) > F.lit(last))
    return df.orderBy(key).limit(size)


def continuation(offset: int, size: int, delivered: int) -> int | None:
    """Offset of the next page, None after the last."""
    return offset + size if delivered == size else None
