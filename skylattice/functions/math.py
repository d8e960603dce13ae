"""Numeric functions whose results differ between SQL engines when taken as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import col, num


def natural_log(x) -> Column:
    """LOG of the query dialect: natural logarithm."""
    return F.ln(num(x))


def log10(x) -> Column:
    return F.log10(num(x))


def square(x) -> Column:
    return num(x) * num(x)


def round_places(x, places: int = 0) -> Column:
    """``x`` to a number of decimal places (negative allowed): scaled, rounded to even, scaled back."""
    x = num(x)
    if places == 0:
        return F.rint(x)
    factor = 10.0 ** abs(places)
    if places > 0:
        return F.rint(x * factor) / factor
    return F.rint(x / factor) * factor


def truncate(x, places: int = 0) -> Column:
    """``x`` cut towards zero at a number of decimal places (negative allowed)."""
    x = num(x)
    factor = 10.0 ** abs(places)
    scaled = F.abs(x) if places == 0 else (F.abs(x) * factor if places > 0 else F.abs(x) / factor)
    cut = F.floor(scaled).cast("double")
    back = cut if places == 0 else (cut / factor if places > 0 else cut * factor)
    return F.signum(x) * back


def int_div(a, b) -> Column:
    """Integer division cut towards zero; NULL for a zero divisor."""
    a, b = col(a), col(b)
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def cot(x) -> Column:
    return F.cot(num(x))


def scale(value, factor, offset=0.0) -> Column:
    """``value * factor + offset``; NULL stays NULL."""
    return num(value) * num(factor) + num(offset)


def mean(a, b) -> Column:
    """Mean of two numbers."""
    a, b = num(a), num(b)
    return a + (b - a) / 2.0


def mean_timestamp(a, b) -> Column:
    """Timestamp halfway between two timestamps."""
    a, b = col(a).cast("timestamp_ntz"), col(b).cast("timestamp_ntz")
    return a + (b - a) / 2


def total_pm(pm_ra, pm_dec) -> Column:
    """Length of a proper motion whose ra part holds cos(dec)."""
    return F.sqrt(num(pm_ra) * num(pm_ra) + num(pm_dec) * num(pm_dec))


def pm_angle(pm_ra, pm_dec) -> Column:
    """Position angle of a proper motion in degrees, east over north."""
    return F.degrees(F.atan2(num(pm_ra), num(pm_dec)))


def random(seed: int | None = None) -> Column:
    """Uniform random numbers in [0, 1)."""
    return F.rand(seed)
