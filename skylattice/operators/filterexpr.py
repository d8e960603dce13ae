"""Filter expressions people type into search forms, as boolean columns.

Numbers and dates: ``< 5``, ``1 .. 3``, ``5 +/- 1``, ``1, 2, 3`` joined by
``!``, ``&``, ``|``.  Strings: an operator in front and shell wildcards.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from ..functions import times
from ..functions._args import col


class FilterError(ValueError):
    """An expression that cannot be read."""


_FLOAT = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_RANGE_SAFE_FLOAT = re.compile(r"\s*([+-]?(?:\d+(?:\.(?!\.)\d*)?|\.\d+)(?:[eE][+-]?\d+)?)")
_DATE = re.compile(r"\s*(\d{4}-\d\d-\d\d(?:T\d\d:\d\d:\d\d)?)")
_COMPARISON = re.compile(r"\s*(>=|<=|=|>|<)")


def _number(text: str):
    try:
        return int(text)
    except ValueError:
        return float(text)


def _date(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text)


class _Numbers:
    """How numeric operands turn into predicates."""

    literal = _RANGE_SAFE_FLOAT
    read = staticmethod(_number)
    error = _FLOAT

    def __init__(self, column: Column, scaling: float | None = None):
        self.column, self.scaling = column, scaling

    def value(self, v):
        return v * self.scaling if self.scaling else v

    def compare(self, operator: str, v) -> Column:
        v = self.value(v)
        return {"=": self.column == v, "<": self.column < v, "<=": self.column <= v,
                ">": self.column > v, ">=": self.column >= v}[operator]

    def between(self, low, high) -> Column:
        return self.column.between(self.value(low), self.value(high))

    def plus_minus(self, v, error: float) -> Column:
        return self.between(v - error, v + error)

    def one_of(self, values) -> Column:
        return self.column.isin([self.value(v) for v in values])


class _Dates(_Numbers):
    """Bare days mean the whole day."""

    literal = _DATE
    read = staticmethod(_date)

    def value(self, v: datetime.datetime):
        return times.timestamp_literal(v)

    @staticmethod
    def day_end(v: datetime.datetime) -> datetime.datetime:
        bare = v.hour == v.minute == v.second == 0
        return v.replace(hour=23, minute=59, second=59) if bare else v

    def compare(self, operator: str, v) -> Column:
        if operator == "=" and v.hour == v.minute == 0:
            return self.between(v, self.day_end(v))
        if operator in ("<=", ">"):
            v = self.day_end(v)
        return super().compare(operator, v)

    def plus_minus(self, v, error: float) -> Column:
        days = datetime.timedelta(days=error)
        return self.between(v - days, v + days)

    def one_of(self, values) -> Column:
        result = self.compare("=", values[0])
        for v in values[1:]:
            result = result | self.compare("=", v)
        return result


class _Mjds(_Dates):
    """Dates against a column of MJD numbers."""

    def value(self, v: datetime.datetime):
        return times.mjd_of_datetime(v)


def _skip(text: str, at: int, sign: str) -> int | None:
    match = re.compile(r"\s*" + sign).match(text, at)
    return match.end() if match else None


def _simple(text: str, at: int, kind: _Numbers) -> tuple[Column, int]:
    comparison = _COMPARISON.match(text, at)
    if comparison:
        at = comparison.end()
    first = kind.literal.match(text, at)
    if not first:
        raise FilterError(f"no value at position {at} of {text!r}")
    value, at = kind.read(first.group(1)), first.end()
    if comparison:
        return kind.compare(comparison.group(1), value), at
    if (after := _skip(text, at, r"\.\.")) is not None:
        second = kind.literal.match(text, after)
        if not second:
            raise FilterError(f"open range in {text!r}")
        return kind.between(value, kind.read(second.group(1))), second.end()
    if (after := _skip(text, at, r"(?:\+/-|±)")) is not None:
        error = kind.error.match(text, after)
        if not error:
            raise FilterError(f"no error margin in {text!r}")
        return kind.plus_minus(value, float(error.group(1))), error.end()
    values = [value]
    while (after := _skip(text, at, ",")) is not None:
        following = kind.literal.match(text, after)
        if not following:
            raise FilterError(f"unfinished list in {text!r}")
        values.append(kind.read(following.group(1)))
        at = following.end()
    return (kind.one_of(values) if len(values) > 1 else kind.compare("=", value)), at


def _negated(text: str, at: int, kind: _Numbers) -> tuple[Column, int]:
    after = _skip(text, at, "!")
    if after is None:
        return _simple(text, at, kind)
    test, at = _simple(text, after, kind)
    return ~test, at


def _all_of(text: str, at: int, kind: _Numbers) -> tuple[Column, int]:
    test, at = _negated(text, at, kind)
    while (after := _skip(text, at, "&")) is not None:
        more, at = _negated(text, after, kind)
        test = test & more
    return test, at


def _read(text: str, kind: _Numbers) -> Column:
    test, at = _all_of(text, 0, kind)
    while (after := _skip(text, at, r"\|")) is not None:
        more, at = _all_of(text, after, kind)
        test = test | more
    if text[at:].strip():
        raise FilterError(f"junk at position {at} of {text!r}")
    return test


def numeric_filter(column, text: str, scaling: float | None = None) -> Column:
    """A numeric expression; literals are multiplied with ``scaling`` to get to the column's unit."""
    return _read(text, _Numbers(col(column), scaling))


def date_filter(column, text: str) -> Column:
    """A date expression against a timestamp column."""
    return _read(text, _Dates(col(column)))


def mjd_filter(column, text: str) -> Column:
    """A date expression against a column of MJDs."""
    return _read(text, _Mjds(col(column)))


def _wildcard_regex(pattern: str) -> str:
    out, rest = [], pattern
    while rest:
        members = re.match(r"\[([^\]]+)\]", rest)
        if members:
            out.append("[" + members.group(1).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]")
            rest = rest[members.end():]
            continue
        sign, rest = rest[0], rest[1:]
        out.append({"*": ".*", "?": "."}.get(sign) or re.sub(r"([^\w\s])", r"\\\1", sign))
    return "^" + "".join(out) + "$"


def string_filter(column, text: str) -> Column:
    """A string expression.

    ``==`` and ``!=`` compare, ``<`` and friends order, ``~`` matches a
    pattern in any case, ``=`` in the given case, ``!`` and ``!~`` negate
    these, ``=~`` takes the operand as it is in any case, ``=,`` and ``=|``
    list alternatives, ``!=,`` excludes.  Without operator: equality.
    """
    column, text = col(column), text.strip()
    for operator, separator in (("!=,", ","), ("=,", ","), ("=|", "|")):
        if text.startswith(operator):
            listed = [v.strip() for v in text[len(operator):].split(separator) if v.strip()]
            test = column.isin(listed)
            return ~test if operator == "!=," else test
    for operator in ("==", "!=", ">=", "<=", ">", "<"):
        if text.startswith(operator):
            operand = text[len(operator):].lstrip()
            return {"==": column == operand, "!=": column != operand, ">=": column >= operand,
                    "<=": column <= operand, ">": column > operand, "<": column < operand}[operator]
    if text.startswith("=~"):
        literal = re.sub(r"([^\w\s])", r"\\\1", text[2:].lstrip())
        return column.rlike(f"(?i)^{literal}$")
    for operator in ("!~", "~", "=", "!"):
        if text.startswith(operator):
            regex = _wildcard_regex(text[len(operator):].lstrip())
            test = column.rlike(("(?i)" if "~" in operator else "") + regex)
            return ~test if operator.startswith("!") else test
    return column == text
