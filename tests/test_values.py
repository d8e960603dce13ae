"""Times, angles, text, units, numbers, formats."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions import angles, casts, formats, text, times, units
from skylattice.functions import math as m

def noon():
    return F.lit("1984-08-05 12:00:00").cast("timestamp_ntz")



def test_julian_dates(values):
    assert values(times.mjd(noon()), times.jd(noon())) == (45917.5, 2445918.0)
    assert values(times.julian_year(F.lit("2000-01-01 12:00:00").cast("timestamp_ntz")))[0] == 2000.0


def test_dates_do_not_depend_on_the_session_zone(spark, value):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert value(times.mjd(noon())) == 45917.5
        assert value(times.timestamp_of_mjd(45917.5)) == datetime.datetime(1984, 8, 5, 12)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("literal,expected", [
    ("1998-12-14", datetime.datetime(1998, 12, 14)),
    ("1998-12-14T13:30:12", datetime.datetime(1998, 12, 14, 13, 30, 12)),
    ("1998-12-14T13:30:12Z", datetime.datetime(1998, 12, 14, 13, 30, 12)),
    ("1998-12-14T13:30:12.224Z", datetime.datetime(1998, 12, 14, 13, 30, 12, 224000)),
    ("19981214T133012Z", datetime.datetime(1998, 12, 14, 13, 30, 12)),
    ("19981214T133012+00:00", datetime.datetime(1998, 12, 14, 13, 30, 12)),
    ("1998-12-14 13:30:12.", datetime.datetime(1998, 12, 14, 13, 30, 12)),
    ("1998-13-14", None), ("junk", None), ("1998", None),
])
def test_iso_literals(value, literal, expected):
    assert value(times.parse_iso(F.lit(literal))) == expected


@pytest.mark.parametrize("literal,pattern,seconds", [
    ("89930", "!!secondsSinceMidnight", 89930), ("23.4", "!!decimalHours", 84240), ("3.4:5", "%H.%M:%S", 11045),
    ("20:04", "%H:%M", 72240), ("25:33", "%H:%M", 91980), ("2357", "%H%M", 86220),
])
def test_time_literals(value, literal, pattern, seconds):
    assert value(times.time_seconds(F.lit(literal), pattern)) == pytest.approx(seconds)
    assert value(times.parse_time(F.lit(literal), pattern)) == datetime.timedelta(seconds=seconds)


def test_leap_seconds(values):
    at = lambda text: times.mjd(F.lit(text).cast("timestamp_ntz"))
    tai = lambda text: times.scale_offset(at(text), "UTC", "TAI")
    assert values(tai("1998-12-31 23:59:58"), tai("1999-01-01 00:00:00"), tai("1971-06-01 00:00:00"),
                  tai("2020-01-01 00:00:00")) == (31.0, 32.0, 9.0, 37.0)


@pytest.mark.parametrize("a", times.SCALES)
@pytest.mark.parametrize("b", times.SCALES)
def test_scales_invert(value, a, b):
    there = times.convert_scale(F.lit(51234.375), a, b)
    assert value(times.convert_scale(there, b, a)) == pytest.approx(51234.375, abs=2e-11)


ANGLES = [("hms", "22 23 23.3", None, 335.84708333), ("hms", "22:23:23.3", ":", 335.84708333),
          ("hms", "222323.3", "", 335.84708333), ("dms", "45 30.6", None, 45.51), ("dms", "45:30.6", ":", 45.51),
          ("dms", "-45 30 7.6", None, -45.50211111), ("dms", "-0 30", None, -0.5), ("dms", "+ 12 30", None, 12.5),
          ("hms", "23 59 59.95", None, 359.999791667), ("dms", "-20:31:05.12", ":", -20.518088889),
          ("fracHour", "21.0209556", None, 315.314334)]


@pytest.mark.parametrize("kind,literal,separator,expected", ANGLES)
def test_angles(value, kind, literal, separator, expected):
    assert value(angles.parse_angle(F.lit(literal), kind, separator)) == pytest.approx(expected, abs=1e-8)


def test_bad_angles(value):
    assert value(angles.hms_to_deg(F.lit("junk"))) is None
    with pytest.raises(Exception, match="invalid time angle"):
        value(angles.hms_to_deg(F.lit("junk"), strict=True))


PAIRS = [("23 12", (23.0, 12.0)), ("23.5,-12.25", (23.5, -12.25)), ("3.75 -12.125", (3.75, -12.125)),
         ("3 25,-12 30", (51.25, -12.5)), ("12 15 30.5 +52 18 27.5", (183.877083333, 52.3076388889)),
         ("12:15:30.5 +52:18:27.5", (183.877083333, 52.3076388889)), ("3.39 -12 39", None),
         ("12 15 30.5 +52 18 27.5e", None), ("QSO2230+44.3", None)]


@pytest.mark.parametrize("literal,expected", PAIRS)
def test_position_pairs(value, literal, expected):
    found = value(angles.parse_pair(F.lit(literal)))
    assert (found is None) if expected is None else tuple(found) == pytest.approx(expected, abs=1e-8)


def test_sexagesimal_text(values):
    lit = lambda v: F.lit(float(v))
    assert values(
        angles.deg_to_hms(lit(0)), angles.deg_to_hms(lit(122.056), digits=1), angles.deg_to_hms(lit(-0.056), digits=0),
        angles.deg_to_hms(lit(-1.056), digits=0), angles.deg_to_hms(lit(359.2222), ":", 4), angles.deg_to_dms(lit(0)),
        angles.deg_to_dms(lit(-0.25)), angles.deg_to_dms(lit(-23.5), digits=4),
    ) == ("00 00 00.000", "08 08 13.4", "-00 00 13", "-00 04 13", "23:56:53.3280", "+0 00 00.00", "-0 15 00.00",
          "-23 30 00.0000")


def test_percent_templates(values):
    given, template = F.lit("12,xy:33,"), "%a:%b,%c"
    assert values(*(text.percent_part(given, template, c) for c in "abc")) == ("12,xy", "33", "")
    given, template = F.lit("2357-x"), "%H%M-%u"
    assert values(*(text.percent_part(given, template, c) for c in "HMu")) == ("23", "57", "x")
    assert values(text.percent_part(F.lit("12,13,14"), "%a:%b,%c", "a"))[0] is None
    with pytest.raises(ValueError):
        text.percent_part(given, "%a%b", "a")


def test_words(values):
    doc = F.lit("The Galaxies, observed by two telescopes; galaxy catalogue.")
    assert values(text.has_words(doc, "galaxy"), text.has_words(doc, "telescope observing"), text.has_words(doc, "the and"),
                  text.has_words(doc, "galax", stemmed=False), text.has_words(doc, "quasar")) == (
        True, True, False, False, False)
    assert values(text.hashlist_has(F.lit("radio#optical"), "Optical"), text.hashlist_has(F.lit("radio#optical"), "opt")) == (
        True, False)
    assert values(text.is_bibcode(F.lit("1984ApJ...280..123K")), text.is_bibcode(F.lit("no bibcode"))) == (True, False)


@pytest.mark.parametrize("source,target,factor", [
    ("m/s", "cm/s", 100), ("10**+4 V/m", "kV/dm", 1), ("arcsec/a", "mas/d", 2.73785078713), ("kHz", "GHz", 1e-6),
    ("cm**-1", "J", 1.986445824e-23), ("MeV", "m**-1", 8.065544005e11), ("km", "m", 1000), ("h", "s", 3600),
])
def test_unit_factors(source, target, factor):
    assert units.conversion_factor(source, target) == pytest.approx(factor, rel=1e-9)


@pytest.mark.parametrize("source,target", [("m/s", "V/m"), ("arcsec/m", "byte"), ("m7v", "cm/s"), ("m/ks", "cm..s")])
def test_bad_units(source, target):
    with pytest.raises(units.UnitError):
        units.conversion_factor(source, target)


def test_parallaxes(values):
    assert values(units.parallax_to_distance(F.lit(0.1)), units.parallax_to_distance(F.lit(0.0)),
                  units.distance_to_parallax(F.lit(10.0)), units.distance_to_parallax(F.lit(1e9))) == pytest.approx(
        (10.0, 1e7, 0.1, 0.0))
    assert values(units.spectral(F.lit(500.0), "nm", "GHz"))[0] == pytest.approx(599584.916)


def test_rounding(values):
    assert values(m.round_places(F.lit(2.5)), m.round_places(F.lit(-1.26), 1), m.round_places(F.lit(1250.0), -2),
                  m.truncate(F.lit(-1.29), 1), m.truncate(F.lit(1299.0), -2), m.int_div(F.lit(-7), F.lit(2)),
                  m.int_div(F.lit(7), F.lit(0))) == (2.0, -1.3, 1200.0, -1.2, 1200.0, -3, None)


def test_casts(values):
    assert values(casts.to_int(F.lit(" 32 ")), casts.to_int(F.lit("")), casts.to_int(F.lit("3x")),
                  casts.to_float(F.lit("   5e9 ")), casts.to_float(F.lit("  ")), casts.to_bool(F.lit("Enabled")),
                  casts.to_bool(F.lit("OFF")), casts.to_bool(F.lit("maybe"))) == (
        32, None, None, 5e9, None, True, False, None)
    with pytest.raises(Exception, match="no integer"):
        values(casts.literal_cast(F.lit("3x"), T.IntegerType(), strict=True))


def test_formats(values):
    assert values(formats.byte_size(F.lit(999)), formats.byte_size(F.lit(2048)), formats.byte_size(F.lit(3 * 2**20)),
                  formats.byte_size(F.lit(5 * 2**30)), formats.clock(F.lit(91980.0)), formats.strip_tags(F.lit("a<b>c</b>")),
                  formats.significant(F.lit(None).cast("double"), 2)) == (
        "999 Bytes", "2.0kiB", "3.0MiB", "5.0GiB", "01:33:00", "ac", "N/A")
