"""Joins, set operations and ordering with the rules of the query dialect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class OperandError(ValueError):
    """Set operands that do not fit together."""


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns of the same name; the joined columns come first, once."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise OperandError("no common columns for a natural join")
    return left.join(right, shared, how)


def check_operands(*frames: DataFrame) -> None:
    """Set operands need the same column names in the same order."""
    first = frames[0].columns
    for other in frames[1:]:
        if other.columns != first:
            raise OperandError(f"columns {other.columns} do not fit {first}")


def union(*frames: DataFrame, keep_all: bool = False) -> DataFrame:
    check_operands(*frames)
    together = reduce(DataFrame.union, frames)
    return together if keep_all else together.distinct()


def intersect(left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    check_operands(left, right)
    return left.intersectAll(right) if keep_all else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    check_operands(left, right)
    return left.exceptAll(right) if keep_all else left.subtract(right)


def set_limit(result: DataFrame, order, *limits: int | None) -> DataFrame:
    """The largest operand limit applied to the whole result of a set operation; none if an operand had none."""
    if any(limit is None for limit in limits) or not limits:
        return result
    return result.orderBy(*order).limit(max(limits))


def ordering(name: str, descending: bool = False) -> Column:
    """Sort key with NULLs counting as largest."""
    return F.desc_nulls_first(name) if descending else F.asc_nulls_last(name)


def order_by(df: DataFrame, *keys, descending: bool = False) -> DataFrame:
    """Sorted by names or 1-based ordinals, one direction for all."""
    names = [df.columns[k - 1] if isinstance(k, int) else k for k in keys]
    return df.orderBy(*(ordering(n, descending) for n in names))


def union_view(mapped: list[DataFrame], columns: dict[str, str]) -> DataFrame:
    """Several mapped tables as one, each column cast to the declared type; missing ones are NULL."""
    def adapt(df: DataFrame) -> DataFrame:
        return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n)
                           for n, t in columns.items()))

    return reduce(DataFrame.unionByName, (adapt(df) for df in mapped))
