"""Columns as text for people: digits, units, dates, sizes, shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import angles, times
from ._args import col, num
from .text import strip_tags  # noqa: F401  (part of this module's surface)
from .units import conversion_factor

NOT_AVAILABLE = "N/A"


def or_na(text: Column) -> Column:
    return F.coalesce(text, F.lit(NOT_AVAILABLE))


def significant(value, digits: int) -> Column:
    """A float with a fixed number of decimals."""
    value = num(value)
    return or_na(F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double"))))


def hms(deg, separator: str = " ", digits: int = 2) -> Column:
    return or_na(angles.deg_to_hms(deg, separator, digits))


def dms(deg, separator: str = " ", digits: int = 2) -> Column:
    return or_na(angles.deg_to_dms(deg, separator, digits))


def display_unit(value, source: str, target: str, digits: int = 2) -> Column:
    return significant(num(value) * conversion_factor(source, target), digits)


def display_unit_array(values, source: str, target: str, digits: int = 2) -> Column:
    factor = conversion_factor(source, target)
    items = F.transform(col(values), lambda v: significant(v * factor, digits))
    return or_na(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))


def human_date(ts) -> Column:
    return or_na(F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss"))


def human_day(ts) -> Column:
    return or_na(F.date_format(col(ts), "yyyy-MM-dd"))


def human_date_of_number(value, unit: str) -> Column:
    """ISO text of a date kept as jd, mjd, yr or s."""
    return or_na(times.iso_of(value, unit))


def clock(seconds, digits: int = 0) -> Column:
    """``hh:mm:ss.s`` of seconds since midnight; whole days of longer intervals are dropped."""
    inside = F.pmod(num(seconds), F.lit(86400.0))
    hours = F.floor(inside / 3600)
    minutes = F.floor((inside - hours * 3600) / 60)
    rest = inside - hours * 3600 - minutes * 60
    return F.when(num(seconds).isNotNull(),
                  F.format_string(f"%02d:%02d:%0{digits + 3 if digits else 2}.{digits}f", hours, minutes, rest))


def clock_of_timestamp(ts, digits: int = 0) -> Column:
    return clock(times.seconds_of_day(ts), digits)


def byte_size(value, digits: int = 1) -> Column:
    """A byte count in Bytes, kiB, MiB or GiB; the switch is at powers of 1000."""
    value = num(value).cast("double")
    unit = lambda n, name: F.format_string(f"%.{digits}f{name}", value / 1024.0**n)
    return or_na(
        F.when(value < 1e3, F.format_string("%d Bytes", value.cast("long")))
        .when(value < 1e6, unit(1, "kiB"))
        .when(value < 1e9, unit(2, "MiB"))
        .when(value.isNotNull(), unit(3, "GiB")))


def _ten_digits(value: Column) -> Column:
    text = F.format_string("%.10f", value.cast("double"))
    return F.regexp_replace(text, r"\.?0+$", "")


def stc_point(p, frame: str = "ICRS") -> Column:
    p = col(p)
    return F.concat_ws(" ", F.lit("Position"), F.lit(frame), _ten_digits(p["ra"]), _ten_digits(p["dec"]))


def stc_circle(c, frame: str = "ICRS") -> Column:
    c = col(c)
    return F.concat_ws(" ", F.lit("Circle"), F.lit(frame), _ten_digits(c["ra"]), _ten_digits(c["dec"]),
                       _ten_digits(c["radius"]))


def stc_polygon(vertices, frame: str = "ICRS") -> Column:
    points = F.transform(col(vertices), lambda v: F.concat_ws(" ", _ten_digits(v["ra"]), _ten_digits(v["dec"])))
    return F.concat_ws(" ", F.lit("Polygon"), F.lit(frame), F.array_join(points, " "))


def stc_box(b, frame: str = "ICRS") -> Column:
    b = col(b)
    return F.concat_ws(" ", F.lit("PositionInterval"), F.lit(frame), _ten_digits(b["ra_min"]),
                       _ten_digits(b["dec_min"]), _ten_digits(b["ra_max"]), _ten_digits(b["dec_max"]))


def position_array(p) -> Column:
    """A position struct as the array [ra, dec]."""
    return F.array(col(p)["ra"], col(p)["dec"])


def one_line(text) -> Column:
    """Text with every run of white space as one blank."""
    return F.regexp_replace(col(text), r"\s+", " ")
