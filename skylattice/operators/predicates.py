"""Predicates built from parameters: each function returns a boolean column (or None when inactive)."""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions._args import col

# fixed values: media types by group of the spectrum search FORMAT parameter
COMPLIANT_TYPES = ("application/x-votable+xml", "application/fits")
NATIVE_GROUPS = ("all", "compliant", "native", "graphic", "votable", "fits")


def conjunction(conditions: Iterable[Column | None]) -> Column:
    """AND of the active conditions; true when there are none."""
    active = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, active) if active else F.lit(True)


def disjunction(conditions: Iterable[Column | None]) -> Column | None:
    """OR of the active conditions; inactive when there are none."""
    active = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, active) if active else None


class Condition:
    """One search condition: input names, a maker ``params -> Column``, and how parts are joined.

    Missing inputs switch it off unless it is required.
    """

    def __init__(self, maker, *inputs: str, required: bool = False, joiner: str = "OR"):
        self.maker, self.inputs, self.required, self.joiner = maker, inputs, required, joiner

    def build(self, params: dict) -> Column | None:
        if any(params.get(name) is None for name in self.inputs):
            if self.required:
                missing = [n for n in self.inputs if params.get(n) is None]
                raise ValueError(f"missing required parameters: {', '.join(missing)}")
            return None
        made = self.maker(params)
        if isinstance(made, (list, tuple)):
            return disjunction(made) if self.joiner == "OR" else conjunction(made)
        return made


def search_filter(conditions: Iterable[Condition], params: dict) -> Column:
    return conjunction(c.build(params) for c in conditions)


def any_of(c, values) -> Column:
    """Equality with one of several literals."""
    return col(c).isin(list(values))


def any_of_nocase(c, values) -> Column:
    return F.lower(col(c)).isin([str(v).lower() for v in values])


def between_open(c, low=None, high=None) -> Column | None:
    """Closed or half-open range; inactive without limits."""
    c = col(c)
    if low is None and high is None:
        return None
    if low is None:
        return c <= high
    if high is None:
        return c >= low
    return c.between(low, high)


def _literal(value):
    return times.timestamp_literal(value) if isinstance(value, datetime.datetime) else F.lit(value)


def equals_value(c, value, xtype: str | None = None) -> Column | None:
    """Predicate from a typed value: a scalar, a set, or (``xtype`` interval) a two-element range.

    Infinite interval ends are open.  MJD numbers against a date column
    (``xtype`` mjd-interval) become timestamps.
    """
    if value is None:
        return None
    if xtype in ("interval", "mjd-interval"):
        low, high = value
        low = None if low is None or low == -math.inf else low
        high = None if high is None or high == math.inf else high
        if xtype == "interval":
            low, high = (None if v is None else _literal(v) for v in (low, high))
        if xtype == "mjd-interval":
            low, high = (None if v is None else times.timestamp_of_mjd(float(v)) for v in (low, high))
        return between_open(c, low, high)
    if isinstance(value, (list, tuple, set, frozenset)):
        return any_of(c, map(_literal, sorted(value))) if value else None
    return col(c) == _literal(value)


def on_constant(constant, test) -> Column:
    """A test against a table-wide constant, decided on the driver; a contradiction empties the plan."""
    return F.lit(bool(test(constant)))


def overlaps(low_column, high_column, low=None, high=None) -> Column:
    """A query interval touching a (low, high) column pair in more than an end point."""
    parts = []
    if high is not None and high != math.inf:
        parts.append(col(low_column) < high)
    if low is not None and low != -math.inf:
        parts.append(col(high_column) > low)
    return conjunction(parts)


def overlaps_any(low_column, high_column, intervals) -> Column | None:
    return disjunction(overlaps(low_column, high_column, *i) for i in intervals)


def covers_value(low_column, high_column, value) -> Column:
    return F.lit(value).between(col(low_column), col(high_column))


def in_any_interval(c, intervals) -> Column | None:
    return disjunction(between_open(c, *(None if math.isinf(v) else v for v in i)) for i in intervals)


def has_state(c, states) -> Column | None:
    """Membership in a slash-delimited set such as ``/I/Q/U/``."""
    return disjunction(col(c).contains(f"/{s}/") for s in states)


def media_type(c, wanted: str, native: str | None = None, compliant=COMPLIANT_TYPES) -> Column | None:
    """Media types by group name or by a comma list of types; ``all`` is no restriction."""
    c, key = col(c), wanted.strip().lower()
    if key == "all":
        return None
    if key == "compliant":
        return c.isin(list(compliant))
    if key == "native":
        return c == native if native else c.isNotNull()
    if key == "graphic":
        return c.like("image/%")
    if key == "votable":
        return c.isin("application/x-votable+xml", "text/xml;x-votable")
    if key == "fits":
        return c == "application/fits"
    return c.isin([t.strip() for t in wanted.split(",")])


# --- shell patterns --------------------------------------------------------

def shell_regex(pattern: str) -> str:
    """Regular expression of a shell pattern with \\-escapes, ``[...]`` and ``[!...]``."""
    token = re.compile(r"\\(?P<escaped>.)|\[(?P<set>(?:\\.|[^\]\\])*)\]|(?P<star>\*)|(?P<one>\?)|(?P<plain>.)", re.S)
    out = []
    for match in token.finditer(pattern):
        if match["star"]:
            out.append(".*")
        elif match["one"]:
            out.append(".")
        elif match["set"] is not None:
            members = re.sub(r"\\(.)", r"\1", match["set"])
            negated = members.startswith("!")
            members = members[1:] if negated else members
            members = re.sub(r"([\[\]\\^&])", r"\\\1", members).replace("-", "\\-")
            out.append(("[^" if negated else "[") + members + "]")
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", match["escaped"] or match["plain"] or ""))
    return "".join(out)


def shell_match(c, pattern: str, nocase: bool = False, whole: bool = False) -> Column:
    """Shell pattern against a text column; found anywhere unless ``whole``."""
    regex = shell_regex(pattern)
    if whole:
        regex = f"^{regex}$"
    return col(c).rlike(("(?i)" if nocase else "") + regex)


# --- row triggers ----------------------------------------------------------

def key_present(df: DataFrame, name: str) -> Column:
    """True when the raw rows have the key with a value."""
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def key_missing(df: DataFrame, name: str) -> Column:
    return ~key_present(df, name)


def key_null(df: DataFrame, name: str) -> Column:
    return F.col(name).isNull() if name in df.columns else F.lit(True)


def key_is(df: DataFrame, name: str, value) -> Column:
    """True where the key has the value; a missing key is no match."""
    return F.coalesce(F.col(name) == F.lit(value), F.lit(False)) if name in df.columns else F.lit(False)


def trigger_or(*triggers: Column) -> Column:
    return reduce(lambda a, b: a | b, triggers)


def trigger_and(*triggers: Column) -> Column:
    return reduce(lambda a, b: a & b, triggers)


def trigger_not(*triggers: Column) -> Column:
    return ~trigger_or(*triggers)


def ignore_on(df: DataFrame, trigger: Column) -> DataFrame:
    """Rows on which the trigger does not fire."""
    return df.filter(~F.coalesce(trigger, F.lit(False)))


# --- access ----------------------------------------------------------------

def visible_to(embargo, owner, groups=(), today: datetime.date | None = None) -> Column:
    """Rows without embargo, with a past one, or owned by one of the caller's groups."""
    now = F.lit(today) if today else F.current_date()
    test = col(embargo).isNull() | (col(embargo) < now)
    return test | col(owner).isin(list(groups)) if groups else test


def by_key(df: DataFrame, key: dict) -> DataFrame:
    """The row with a primary key."""
    return df.filter(conjunction(F.col(k) == F.lit(v) for k, v in key.items()))


def delete_matching(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that stay when the matching ones are deleted; NULL conditions do not delete."""
    return df.filter(~F.coalesce(condition, F.lit(False)))
