"""Sexagesimal angles: parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import col, num
from ._strict import strict_or_null


def _fields(text: Column, separator: str | None) -> Column:
    if separator == "":
        rest = text.substr(F.lit(5), F.length(text))
        return F.array(F.substring(text, 1, 2), F.substring(text, 3, 2), rest)
    if separator is None:
        return F.split(text, r"\s+")
    return F.split(text, "\\Q" + separator + "\\E")


def _sexagesimal(parts: Column) -> Column:
    """Seconds in [h, m] or [h, m, s] fields; NULL where they do not parse."""
    third = F.when(F.size(parts) == 2, F.lit(0.0)).otherwise(F.get(parts, F.lit(2)).try_cast("double"))
    whole = F.trim(F.get(parts, F.lit(0)))
    hours = F.when(whole.rlike(r"^[+-]?\d+$"), whole.try_cast("int"))
    seconds = hours * 3600 + F.get(parts, F.lit(1)).try_cast("double") * 60 + third
    return F.when(F.size(parts).isin(2, 3), seconds)


def hms_to_deg(text, separator: str | None = None, strict: bool = False) -> Column:
    """Degrees of an hour angle ``h m s`` or ``h m``; an empty separator takes hhmmss."""
    value = _sexagesimal(_fields(F.trim(col(text)), separator)) / 240.0
    return strict_or_null(value, col(text), "invalid time angle", strict)


def dms_to_deg(text, separator: str | None = None, strict: bool = False) -> Column:
    """Degrees of ``d m s`` or ``d m``; the sign of -0 is kept."""
    trimmed = F.trim(col(text))
    sign = F.when(trimmed.startswith("-"), -1.0).otherwise(1.0)
    bare = F.trim(F.regexp_replace(trimmed, r"^[+-]", ""))
    value = sign * _sexagesimal(_fields(bare, separator)) / 3600.0
    return strict_or_null(value, col(text), "invalid dms angle", strict)


def hours_to_deg(hours) -> Column:
    return num(hours) * 15.0


def parse_angle(text, kind: str, separator: str | None = None) -> Column:
    """Degrees of an angle in one of the forms hms, dms, fracHour."""
    if kind == "hms":
        return hms_to_deg(text, separator)
    if kind == "dms":
        return dms_to_deg(text, separator)
    if kind == "fracHour":
        return hours_to_deg(col(text).try_cast("double"))
    raise ValueError(f"unknown angle format {kind}")


_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_PAIR = rf"^\s*({_NUMBER})\s*[\s,/]\s*({_NUMBER})\s*$"


def _sexagesimal_pair(text: Column, blank: str, separator: str | None) -> Column:
    field = rf"(?:\d+{blank})?(?:\d+{blank})?\d+(?:\.\d*)?"
    pattern = rf"^\s*({field})\s*[\s,/]?\s*([+-]?\s*{field})\s*$"
    ra = hms_to_deg(F.regexp_extract(text, pattern, 1), separator)
    dec = dms_to_deg(F.regexp_extract(text, pattern, 2), separator)
    return F.when(text.rlike(pattern) & ra.isNotNull() & dec.isNotNull(),
                  F.struct(ra.alias("ra"), dec.alias("dec")))


def parse_pair(text) -> Column:
    """Struct (ra, dec) from free text: two floats, else sexagesimal with blanks, else with colons."""
    text = col(text)
    floats = F.when(
        text.rlike(_PAIR),
        F.struct(
            F.regexp_extract(text, _PAIR, 1).try_cast("double").alias("ra"),
            F.regexp_extract(text, _PAIR, 2).try_cast("double").alias("dec")))
    return F.coalesce(
        floats, _sexagesimal_pair(text, r"\s+", None), _sexagesimal_pair(text, ":", ":"))


def _sexagesimal_text(value: Column, plus: str, lead: str, separator: str, digits: int) -> Column:
    size = F.abs(value)
    whole = F.floor(size)
    minutes_all = (size - whole) * 60
    minutes = F.floor(minutes_all)
    seconds = (minutes_all - minutes) * 60
    width = digits + 3 if digits > 0 else 2
    return F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit(plus)),
        F.format_string(lead, whole),
        F.lit(separator),
        F.format_string("%02d", minutes),
        F.lit(separator),
        F.format_string(f"%0{width}.{max(digits, 0)}f", seconds))


def deg_to_hms(deg, separator: str = " ", digits: int = 3) -> Column:
    """``hh mm ss.sss`` of an angle in degrees."""
    return _sexagesimal_text(num(deg) / 360.0 * 24.0, "", "%02d", separator, digits)


def deg_to_dms(deg, separator: str = " ", digits: int = 2) -> Column:
    """``+d mm ss.ss`` of an angle in degrees; the sign is always shown."""
    return _sexagesimal_text(num(deg), "+", "%d", separator, digits)
