"""Tolerant casts of text literals.

Blank numeric literals are NULL; junk is NULL too, or an error with ``strict``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import times
from ._args import col
from ._strict import strict_or_null

# fixed values: boolean literals, in any case
TRUE_LITERALS = ("true", "yes", "t", "on", "enabled", "1")
FALSE_LITERALS = ("false", "no", "f", "off", "disabled", "0")


def _blank_to_null(text) -> Column:
    trimmed = F.trim(col(text).cast("string"))
    return F.nullif(trimmed, F.lit(""))


def to_int(text, strict: bool = False, kind: str = "bigint") -> Column:
    source = _blank_to_null(text)
    value = F.when(source.rlike(r"^[+-]?\d+$"), source.try_cast(kind))
    return strict_or_null(value, source, "no integer", strict)


def to_float(text, strict: bool = False, kind: str = "double") -> Column:
    source = _blank_to_null(text)
    return strict_or_null(source.try_cast(kind), source, "no number", strict)


def to_bool(text, strict: bool = False) -> Column:
    source = F.lower(col(text).cast("string"))
    value = F.when(source.isin(*TRUE_LITERALS), True).when(source.isin(*FALSE_LITERALS), False)
    return strict_or_null(value, source, "no boolean literal", strict)


def literal_cast(text, target: T.DataType, strict: bool = False) -> Column:
    """The cast a column type asks for when the source is text."""
    if isinstance(target, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return to_int(text, strict, target.simpleString())
    if isinstance(target, (T.FloatType, T.DoubleType)):
        return to_float(text, strict, target.simpleString())
    if isinstance(target, T.BooleanType):
        return to_bool(text, strict)
    if isinstance(target, T.DateType):
        source = _blank_to_null(text)
        return strict_or_null(times.parse_date(source), source, "no date", strict)
    if isinstance(target, (T.TimestampNTZType, T.TimestampType)):
        source = _blank_to_null(text)
        return strict_or_null(times.parse_iso(source).cast(target), source, "no timestamp", strict)
    return col(text).cast(target)


def parse_with_null(text, parser, null_literal: str | None = None, default=None, checker=None) -> Column:
    """``parser(text)``; the default for NULL, the null literal, or where ``checker(text)`` holds."""
    text = col(text)
    default = F.lit(default) if not isinstance(default, Column) else default
    is_null = text.isNull()
    if null_literal is not None:
        is_null = is_null | (text == F.lit(null_literal))
    if checker is not None:
        is_null = is_null | checker(text)
    return F.when(is_null, default).otherwise(F.coalesce(parser(text), default))
