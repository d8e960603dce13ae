"""The functions of the query dialect for ``spark.sql`` and as columns."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sqlgeometry  # noqa: F401
from .functions import regions, registry, sphere, text, times
from .functions.registry import UserFunction, register

_HAVERSINE = ("degrees(2 * asin(sqrt(least(1D, pow(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * "
              "cos(radians(dec2)) * pow(sin(radians(ra2 - ra1) / 2), 2)))))")
_POSITIONS = "ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE"
_MJD = ("datediff(to_date(d), DATE'1858-11-17') + (hour(d) * 3600 + minute(d) * 60 + "
        "CAST(extract(SECOND FROM d) AS DOUBLE)) / 86400D")

register(UserFunction("sky_distance", _POSITIONS, "DOUBLE", "Great-circle distance in degrees.", sql=_HAVERSINE,
                      column=sphere.distance, unit="deg", ucd="pos.angDistance"))
register(UserFunction("sky_contains_circle", "ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE, r DOUBLE", "INT",
                      "1 if the first position is at most r from the second, else 0.",
                      sql=f"CAST({_HAVERSINE} <= r AS INT)",
                      column=lambda *a: regions.as_int(sphere.within(*a)), predicate=True))
register(UserFunction("sky_crossmatch", "ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE, r DOUBLE", "BOOLEAN",
                      "Whether two positions are at most r apart.", sql=f"{_HAVERSINE} <= r", column=sphere.within,
                      predicate=True))
register(UserFunction("to_mjd", "d TIMESTAMP_NTZ", "DOUBLE", "Modified Julian date of a timestamp.", sql=_MJD,
                      column=times.mjd, unit="d", ucd="time.epoch"))
register(UserFunction("to_jd", "d TIMESTAMP_NTZ", "DOUBLE", "Julian date of a timestamp.", sql=f"{_MJD} + 2400000.5D",
                      column=times.jd, unit="d", ucd="time.epoch"))
register(UserFunction("rx_match", "s STRING, pattern STRING", "INT", "1 if the pattern is found in the text.",
                      sql="CAST(s RLIKE pattern AS INT)", column=text.matches, predicate=True))
register(UserFunction("nocasematch", "s STRING, pattern STRING", "INT", "LIKE without regard to case, as 0 or 1.",
                      sql="CAST(s ILIKE pattern AS INT)", column=text.like_nocase, predicate=True))
register(UserFunction("hashlist_has", "list STRING, item STRING", "INT", "Membership in a #-joined list, as 0 or 1.",
                      sql="CAST(array_contains(split(list, '#'), lower(item)) AS INT)", column=text.hashlist_has,
                      predicate=True))
register(UserFunction("log_natural", "x DOUBLE", "DOUBLE", "LOG of the dialect.", sql="ln(x)", column=F.ln))
register(UserFunction("square", "x DOUBLE", "DOUBLE", "x times x.", sql="x * x", column=lambda x: x * x))
register(UserFunction("truncate_to", "x DOUBLE, n INT", "DOUBLE", "x cut towards zero at n decimals.",
                      sql="signum(x) * floor(abs(x) * pow(10, n)) / pow(10, n)"))


def install(spark: SparkSession) -> list[str]:
    """Makes the pack known to ``spark.sql`` as temporary functions."""
    return registry.install(spark)


def install_generators(spark: SparkSession) -> None:
    """Table functions for row filters: ``index_rows(n)`` gives 0 to n-1."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION index_rows(n BIGINT) RETURNS TABLE (ind BIGINT) "
              "RETURN SELECT explode(CASE WHEN n > 0 THEN sequence(0L, n - 1) END)")
