"""Julian dates, literal parsing, time scales.

Timestamps are read as naive wall-clock values; nothing here depends on the
session time zone when columns are ``timestamp_ntz``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import col, num

JD_OF_MJD = 2400000.5
MJD_J2000 = 51544.5
JULIAN_YEAR = 365.25
# fixed values: Besselian epoch 1900.0 and the tropical year in days
JD_B1900 = 2415020.31352
TROPICAL_YEAR = 365.242198781
_MJD_EPOCH = "1858-11-17"


def seconds_of_day(ts) -> Column:
    ts = col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def mjd(ts) -> Column:
    """Modified Julian date of a timestamp."""
    days = F.datediff(F.to_date(col(ts)), F.lit(_MJD_EPOCH).cast("date"))
    return days + seconds_of_day(ts) / 86400.0


def jd(ts) -> Column:
    return mjd(ts) + JD_OF_MJD


def julian_year(ts) -> Column:
    return 2000.0 + (mjd(ts) - MJD_J2000) / JULIAN_YEAR


def besselian_year(ts) -> Column:
    return 1900.0 + (jd(ts) - JD_B1900) / TROPICAL_YEAR


def epoch_seconds(ts) -> Column:
    return (mjd(ts) - 40587.0) * 86400.0


def timestamp_of_mjd(value) -> Column:
    value = num(value)
    days = F.floor(value)
    seconds = F.round((value - days) * 86400.0, 6).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit(_MJD_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"), zero, zero, seconds)


def timestamp_of_jd(value) -> Column:
    return timestamp_of_mjd(num(value) - JD_OF_MJD)


def timestamp_of_julian_year(value) -> Column:
    return timestamp_of_mjd((num(value) - 2000.0) * JULIAN_YEAR + MJD_J2000)


def timestamp_of_besselian_year(value) -> Column:
    return timestamp_of_mjd((num(value) - 1900.0) * TROPICAL_YEAR + JD_B1900 - JD_OF_MJD)


def timestamp_of_epoch_seconds(value) -> Column:
    return timestamp_of_mjd(num(value) / 86400.0 + 40587.0)


# fixed pattern: ISO date with optional time; dashes, colons, fraction and UTC marks are optional
_ISO = r"^(\d{4})-?(\d\d)-?(\d\d)(?:[T ](\d\d):?(\d\d):?(\d\d)(\.\d+)?\.?Z?(?:\+00:00)?)?$"


def parse_iso(text) -> Column:
    """Timestamp of an ISO literal, NULL otherwise.

    One pattern replacement per row brings the literal to the standard form
    and marks the ones that fitted.
    """
    marked = F.regexp_replace(F.trim(col(text)), _ISO, "=$1-$2-$3 $4:$5:$6$7")
    whole_day = F.replace(marked, F.lit(" ::"), F.lit(" 00:00:00"))
    return F.when(marked.startswith("="), F.ltrim(whole_day, F.lit("=")).try_cast("timestamp_ntz"))


def parse_timestamp(text, pattern: str | None = None) -> Column:
    """Timestamp by a datetime pattern, with ISO always tried after it."""
    if pattern is None:
        return parse_iso(text)
    return F.coalesce(
        F.try_to_timestamp(col(text), F.lit(pattern)).cast("timestamp_ntz"), parse_iso(text))


def parse_date(text, pattern: str | None = None) -> Column:
    """Date of a literal; the pattern ``!!jYear`` reads Julian epochs."""
    if pattern == "!!jYear":
        return timestamp_of_julian_year(col(text).try_cast("double")).cast("date")
    return parse_timestamp(text, pattern).cast("date")


def any_to_mjd(value, kind: str = "number") -> Column:
    """MJD of a number (JD above a million), a timestamp or an ISO string."""
    if kind == "timestamp":
        return mjd(value)
    if kind == "string":
        return mjd(parse_iso(value))
    value = num(value)
    return F.when(value > 1e6, value - JD_OF_MJD).otherwise(value)


def interval_of_seconds(seconds) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, F.round(num(seconds), 6).cast("decimal(18,6)"))


def time_seconds(text, pattern: str = "%H:%M:%S") -> Column:
    """Seconds in a time literal; hours above 24 are fine.

    Patterns: ``!!secondsSinceMidnight``, ``!!decimalHours`` or a template
    with %H, %M, %S.
    """
    from .text import percent_part

    if pattern == "!!secondsSinceMidnight":
        return col(text).try_cast("double")
    if pattern == "!!decimalHours":
        return col(text).try_cast("double") * 3600.0
    total = F.lit(0.0)
    for code, factor in (("H", 3600.0), ("M", 60.0), ("S", 1.0)):
        if f"%{code}" in pattern:
            total = total + percent_part(text, pattern, code).try_cast("double") * factor
    return total


def parse_time(text, pattern: str = "%H:%M:%S") -> Column:
    """Time literal as a day-time interval."""
    return interval_of_seconds(time_seconds(text, pattern))


def make_timestamp(date, interval) -> Column:
    """Timestamp from a date and a time of day (interval)."""
    return col(date).cast("timestamp_ntz") + col(interval)


# --- time scales -----------------------------------------------------------

# fixed values: MJDs at whose start a leap second took effect since 1972-01-01
LEAP_SECOND_MJDS = (
    41317, 41499, 41683, 42048, 42413, 42778, 43144, 43509, 43874, 44239, 44786, 45151, 45516, 46247,
    47161, 47892, 48257, 48804, 49169, 49534, 50083, 50630, 51179, 53736, 54832, 56109, 57204, 57754,
)
_BEFORE_1972 = 9
# fixed values: defining constants of the scales
TT_MINUS_TAI = 32.184
L_G = 6.969291e-10
L_B = 1.550505e-8
_MJD_1977 = 43144.0

SCALES = ("UTC", "TAI", "TT", "TDB", "TCG", "TCB")


def _leap_count(at: Column, in_tai: bool) -> Column:
    count = None
    for i, day in reversed(list(enumerate(LEAP_SECOND_MJDS))):
        seconds = _BEFORE_1972 + 1 + i
        mark = at >= day + (seconds / 86400.0 if in_tai else 0.0)
        count = F.when(mark, seconds) if count is None else count.when(mark, seconds)
    return count.otherwise(F.when(at.isNotNull(), _BEFORE_1972))


def _tdb_minus_tt(at: Column) -> Column:
    anomaly = F.radians(357.53 + 0.9856003 * (at - MJD_J2000))
    return 0.001658 * F.sin(anomaly) + 0.000014 * F.sin(2 * anomaly)


def scale_offset(mjd_value, source: str, target: str) -> Column:
    """Seconds to add to a date on ``source`` to get it on ``target``."""
    at = num(mjd_value)
    for scale in (source, target):
        if scale not in SCALES:
            raise ValueError(f"unknown time scale {scale}")
    if source == target:
        return F.lit(0.0)
    tcg = L_G * 86400.0 * (at - _MJD_1977)
    tcb = L_B * 86400.0 * (at - _MJD_1977)
    to_tt = {
        "UTC": _leap_count(at, False) + TT_MINUS_TAI,
        "TAI": F.lit(TT_MINUS_TAI),
        "TT": F.lit(0.0),
        "TDB": -_tdb_minus_tt(at),
        "TCG": -tcg,
        "TCB": -tcb - _tdb_minus_tt(at),
    }[source]
    tt = at + to_tt / 86400.0
    from_tt = {
        "UTC": -TT_MINUS_TAI - _leap_count(tt - TT_MINUS_TAI / 86400.0, True),
        "TAI": F.lit(-TT_MINUS_TAI),
        "TT": F.lit(0.0),
        "TDB": _tdb_minus_tt(tt),
        "TCG": L_G * 86400.0 * (tt - _MJD_1977),
        "TCB": L_B * 86400.0 * (tt - _MJD_1977) + _tdb_minus_tt(tt),
    }[target]
    return to_tt + from_tt


def convert_scale(mjd_value, source: str, target: str) -> Column:
    """An MJD moved between time scales."""
    return num(mjd_value) + scale_offset(mjd_value, source, target) / 86400.0


def convert_scale_timestamp(ts, source: str, target: str) -> Column:
    """A timestamp moved between time scales."""
    return col(ts).cast("timestamp_ntz") + interval_of_seconds(scale_offset(mjd(ts), source, target))


def in_unit(ts, unit: str) -> Column:
    """A timestamp as a number or text, by the unit declared for its column."""
    if unit == "mjd":
        return mjd(ts)
    if unit in ("d", "jd"):
        return jd(ts)
    if unit in ("yr", "a"):
        return julian_year(ts)
    if unit == "s":
        return epoch_seconds(ts)
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def iso_of(value, unit: str) -> Column:
    """ISO text of a JD, MJD, Julian year or epoch-second number."""
    convert = {
        "jd": timestamp_of_jd, "d": timestamp_of_jd, "mjd": timestamp_of_mjd,
        "yr": timestamp_of_julian_year, "s": timestamp_of_epoch_seconds,
    }[unit]
    return F.date_format(F.date_trunc("second", convert(value) + F.expr("INTERVAL '0.5' SECOND")),
                         "yyyy-MM-dd'T'HH:mm:ss")


def timestamp_literal(value) -> Column:
    """A Python datetime as a literal that means the same wall-clock time in every session zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def year_to_mjd(year: float) -> float:
    """MJD of a Julian year, for literals."""
    return (year - 2000.0) * JULIAN_YEAR + MJD_J2000


def mjd_of_datetime(value) -> float:
    """MJD of a Python date or datetime, for literals."""
    day = value.toordinal() - 678576
    seconds = 0.0
    if hasattr(value, "hour"):
        seconds = value.hour * 3600 + value.minute * 60 + value.second + value.microsecond * 1e-6
    return math.fsum((day, seconds / 86400.0))
