"""Range lists of the search protocols: ``v``, ``a/b``, ``/b``, ``a/``, ``a/b/step``, joined by commas.

A literal turns into one predicate, term by term.  Stepped ranges are tested by arithmetic, so their length does not matter.
"""

from __future__ import annotations

import datetime
import re
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sphere, times
from ..functions._args import col
from ..functions.text import has_words
from .predicates import shell_match


class RangeError(ValueError):
    """A literal that is no range list."""


class Term(NamedTuple):
    """A value (``low`` and ``high`` the same, ``single``), or limits of which one may be missing, with a step or not."""

    low: object
    high: object
    step: object = None
    single: bool = False


def _date(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text.removesuffix("Z"))


_VALUE = {"string": str, "plain": str, "int": int, "float": float, "date": _date}
_STEP = {"int": int, "date": lambda text: datetime.timedelta(days=float(text))}
_SHAPE = re.compile(r"(?P<low>[^/]*)/(?P<high>[^/]*)(?:/(?P<step>[^/]*))?")


def _term(text: str, kind: str) -> Term:
    def value(part: str | None, read):
        try:
            return read(unquote(part)) if part else None
        except (ValueError, TypeError):
            raise RangeError(f"{part!r} is no {kind}") from None

    if kind == "plain" or "/" not in text:
        single = value(text, _VALUE[kind]) if text else ""
        return Term(single, single, single=True)
    shape = _SHAPE.fullmatch(text)
    if shape is None:
        raise RangeError(f"{text!r} has more than limits and a step")
    if shape["step"] and kind not in _STEP:
        raise RangeError(f"a {kind} range has no step")
    term = Term(value(shape["low"], _VALUE[kind]), value(shape["high"], _VALUE[kind]), value(shape["step"], _STEP.get(kind)))
    missing = (term.low is None) + (term.high is None)
    if missing == 2 or (missing and term.step is not None):
        raise RangeError(f"{text!r} lacks a limit")
    if term.step is not None and term.step == term.step * 0:
        raise RangeError("a step of nothing leads nowhere")
    return term


def split_qualifier(text: str) -> tuple[str, str | None]:
    """The list and what stands behind its semicolon."""
    body, *more = text.split(";")
    if len(more) > 1:
        raise RangeError("more than one qualifier")
    return body, unquote(more[0]) if more and more[0] else None


def terms(text: str | None, kind: str = "string") -> list[Term] | None:
    """The terms of a literal; None for no restriction."""
    if text is None or (not text and kind not in ("string", "plain")):
        return None
    return [_term(part, kind) for part in split_qualifier(text)[0].split(",")]


#: days (or years) within which a column of dates as numbers counts as on a step
_NEAR = {"mjd": 1e-9, "jd": 1e-8, "jy": 3e-11}


def _in_column(value, form: str | None):
    if not isinstance(value, datetime.datetime):
        return value
    if form is None:
        return times.timestamp_literal(value)
    mjd = times.mjd_of_datetime(value)
    return {"mjd": mjd, "jd": mjd + times.JD_OF_MJD, "jy": 2000.0 + (mjd - times.MJD_J2000) / times.JULIAN_YEAR}[form]


def _on_step(column: Column, term: Term, form: str | None) -> Column:
    """Whether a value between the limits is a whole number of steps above the lower one."""
    step, low = abs(term.step), _in_column(term.low, form)
    if not isinstance(step, datetime.timedelta):
        return (column - F.lit(low)) % F.lit(step) == 0
    if form is None:
        micros = F.timestamp_diff("MICROSECOND", F.lit(low) if not isinstance(low, Column) else low, column)
        return micros % F.lit(step // datetime.timedelta(microseconds=1)) == 0
    width = step / datetime.timedelta(days=1) / (times.JULIAN_YEAR if form == "jy" else 1)
    return F.abs(column - (F.round((column - low) / width) * width + low)) <= _NEAR[form]


def _test(column: Column, term: Term, form: str | None) -> Column:
    low, high = _in_column(term.low, form), _in_column(term.high, form)
    if term.single:
        return column == low
    slack = _NEAR.get(form, 0) if term.step is not None else 0
    parts = [column >= (low - slack if slack else low)] if low is not None else []
    parts += [column <= (high + slack if slack else high)] if high is not None else []
    parts += [_on_step(column, term, form)] if term.step is not None else []
    return reduce(lambda a, b: a & b, parts)


def range_filter(column, text: str | None, kind: str = "string", column_form: str | None = None) -> Column | None:
    """The predicate of a range list; None when it does not restrict.

    ``column_form`` (mjd, jd, jy) says how a column holds dates.  Single values become one IN.
    """
    found = terms(text, kind)
    if found is None:
        return None
    column = col(column)
    singles = [_in_column(t.low, column_form) for t in found if t.single]
    tests = [column.isin(singles)] if len(singles) > 1 else [column == singles[0]] if singles else []
    tests += [_test(column, t, column_form) for t in found if not t.single]
    return reduce(lambda a, b: a | b, tests)


def interval_filter(low, high, text: str | None) -> Column | None:
    """A float range list against an interval in two columns."""
    found = terms(text, "float")
    if found is None:
        return None
    low, high = col(low), col(high)

    def meets(term: Term) -> Column:
        if term.single:
            return F.lit(term.low).between(low, high)
        ends = [low < F.lit(term.high)] if term.high is not None else []
        ends += [high > F.lit(term.low)] if term.low is not None else []
        return reduce(lambda a, b: a & b, ends)

    return reduce(lambda a, b: a | b, map(meets, found))


def names_value(text: str, value: str) -> bool:
    """Whether a list of plain values has this one."""
    return any(t.low == value for t in terms(text, "plain"))


def caseless_filter(column, text: str | None) -> Column | None:
    return None if text is None else range_filter(F.lower(col(column)), text.lower(), "string")


def shell_filter(column, text: str | None, nocase: bool = True) -> Column | None:
    return None if text is None else shell_match(column, text, nocase)


def words_filter(column, text: str | None) -> Column | None:
    """Documents holding all words of any of the comma-separated queries."""
    found = terms(text, "plain") if text else None
    return None if found is None else reduce(lambda a, b: a | b, (has_words(column, t.low) for t in found))


def positions(text: str | None) -> list[tuple[float, float]] | None:
    """The positions of a POS literal, with ICRS as only qualifier."""
    if not text:
        return None
    literal = text.upper().replace("%2C", ",")
    frame = split_qualifier(literal)[1]
    if frame not in (None, "ICRS"):
        raise RangeError(f"no positions in frame {frame}")
    found = terms(literal, "float")
    if len(found) % 2 or not all(t.single and t.low != "" for t in found):
        raise RangeError("positions are pairs of numbers")
    return [(a.low, b.low) for a, b in zip(found[::2], found[1::2])]


def cone_filter(ra, dec, text: str | None, size: float) -> Column | None:
    """Positions strictly within ``size`` degrees of any position of a POS literal."""
    centers = positions(text)
    if centers is None:
        return None
    result = None
    for ra0, dec0 in centers:
        near = sphere.dec_band(dec, dec0, size) & (sphere.distance(ra, dec, ra0, dec0) < float(size))
        result = near if result is None else result | near
    return result
