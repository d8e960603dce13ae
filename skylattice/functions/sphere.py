"""Positions on the unit sphere: distances, vectors, motion, folding.

All angles are degrees.  Arguments may be columns, column names or numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import is_number, num

# slack added to pre-filter bands so that rounding never loses an edge row
BAND_SLACK = 1e-9


def haversine_term(ra1, dec1, ra2, dec2) -> Column:
    """sin^2(d/2) of the great-circle distance d; monotonic in d."""
    ra1, dec1, ra2, dec2 = map(num, (ra1, dec1, ra2, dec2))
    sin_dec = F.sin(F.radians(dec2 - dec1) / 2)
    sin_ra = F.sin(F.radians(ra2 - ra1) / 2)
    return sin_dec * sin_dec + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * sin_ra * sin_ra


def distance(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance, stable for small angles."""
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), haversine_term(ra1, dec1, ra2, dec2)))))


def within(ra1, dec1, ra2, dec2, radius) -> Column:
    """Whether two positions are at most ``radius`` apart (edge included)."""
    return distance(ra1, dec1, ra2, dec2) <= num(radius)


def dec_band(dec, dec0, radius) -> Column:
    """Declination range around a cone; prunes Parquet row groups for constants."""
    dec = num(dec)
    if is_number(dec0) and is_number(radius):
        return dec.between(dec0 - radius - BAND_SLACK, dec0 + radius + BAND_SLACK)
    dec0, radius = num(dec0), num(radius)
    return dec.between(dec0 - radius - BAND_SLACK, dec0 + radius + BAND_SLACK)


def ra_halfwidth(dec0: float, radius: float) -> float:
    """Half the right ascension range a cone covers; 180 when it holds a pole."""
    if abs(dec0) + radius >= 90:
        return 180.0
    return min(
        180.0,
        math.degrees(math.asin(min(1.0, math.sin(math.radians(radius)) / math.cos(math.radians(dec0))))),
    )


def ra_band(ra, ra0: float, dec0: float, radius: float) -> Column:
    """Right ascension range of a constant cone, for ra folded into [0, 360)."""
    half = ra_halfwidth(dec0, radius) + BAND_SLACK
    if half >= 180:
        return F.lit(True)
    ra = num(ra)
    low, high = (ra0 - half) % 360, (ra0 + half) % 360
    return ra.between(low, high) if low <= high else (ra >= low) | (ra <= high)


def in_cone(ra, dec, ra0, dec0, radius) -> Column:
    """Cone test with the declination band in front."""
    return dec_band(dec, dec0, radius) & within(ra, dec, ra0, dec0, radius)


def unit_vector(ra, dec) -> Column:
    """Struct (x, y, z) on the unit sphere."""
    ra, dec = F.radians(num(ra)), F.radians(num(dec))
    return F.struct(
        (F.cos(dec) * F.cos(ra)).alias("x"),
        (F.cos(dec) * F.sin(ra)).alias("y"),
        F.sin(dec).alias("z"),
    )


def vector_ra(x, y) -> Column:
    return fold_ra(F.degrees(F.atan2(num(y), num(x))))


def vector_dec(x, y, z) -> Column:
    x, y, z = num(x), num(y), num(z)
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def position_of_vector(x, y, z) -> Column:
    """Struct (ra, dec) of a direction vector of any length."""
    return F.struct(vector_ra(x, y).alias("ra"), vector_dec(x, y, z).alias("dec"))


def heading(ra1, dec1, ra2, dec2) -> Column:
    """Initial heading from the first position to the second, north over east, [0, 360)."""
    ra1, dec1, ra2, dec2 = map(num, (ra1, dec1, ra2, dec2))
    dra, d1, d2 = F.radians(ra2 - ra1), F.radians(dec1), F.radians(dec2)
    east = F.sin(dra) * F.cos(d2)
    north = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(dra)
    angle = fold_ra(F.degrees(F.atan2(east, north)))
    pole_slack = math.degrees(1e-10)
    return (
        F.when(F.abs(ra1 - ra2) <= pole_slack, F.when(dec1 < dec2, 0.0).otherwise(180.0))
        .when(dec1 <= -90 + pole_slack, F.lit(0.0))
        .when(dec1 >= 90 - pole_slack, F.lit(180.0))
        .otherwise(angle)
    )


def move(ra, dec, pm_ra, pm_dec, years) -> Column:
    """Struct (ra, dec) after proper motion along a great circle.

    ``pm_ra`` holds cos(dec); motions are degrees per unit of ``years``.
    """
    ra, dec, pm_ra, pm_dec, years = map(num, (ra, dec, pm_ra, pm_dec, years))
    total = F.sqrt(pm_ra * pm_ra + pm_dec * pm_dec)
    arc = F.radians(total * years)
    east, north = pm_ra / total, pm_dec / total
    sin_ra, cos_ra = F.sin(F.radians(ra)), F.cos(F.radians(ra))
    sin_dec, cos_dec = F.sin(F.radians(dec)), F.cos(F.radians(dec))
    x = cos_dec * cos_ra * F.cos(arc) - (sin_dec * cos_ra * north + sin_ra * east) * F.sin(arc)
    y = cos_dec * sin_ra * F.cos(arc) - (sin_dec * sin_ra * north - cos_ra * east) * F.sin(arc)
    z = sin_dec * F.cos(arc) + cos_dec * north * F.sin(arc)
    still = F.struct(ra.cast("double").alias("ra"), dec.cast("double").alias("dec"))
    return F.when(total < math.degrees(1e-20), still).otherwise(position_of_vector(x, y, z))


def fold_ra(ra) -> Column:
    """Longitude folded into [0, 360)."""
    return F.pmod(num(ra), F.lit(360.0))


def clamp_dec(dec) -> Column:
    """Latitude clamped to [-90, 90]; NULL stays NULL."""
    dec = num(dec)
    return F.when(dec.isNotNull(), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), dec)))


def crosses_stitch(ra_min, ra_max) -> Column:
    """Whether something less than 180 degrees wide lies over the 0/360 line."""
    return (num(ra_max) > 270) & (num(ra_min) < 90)


def point(ra, dec) -> Column:
    """Position struct (ra, dec)."""
    return F.struct(num(ra).cast("double").alias("ra"), num(dec).cast("double").alias("dec"))


# WGS84, fixed values
WGS84_RADIUS = 6378137.0
WGS84_FLATTENING = 1 / 298.257223563
_ECC2 = 2 * WGS84_FLATTENING - WGS84_FLATTENING**2


def geodetic_to_geocentric(lon, lat, height) -> Column:
    """Struct (lon, lat, rho): geocentric latitude, distance in earth radii; height in metres."""
    lon, lat, height = num(lon), F.radians(num(lat)), num(height)
    flat2 = (1 - WGS84_FLATTENING) ** 2
    c = 1 / F.sqrt(F.cos(lat) * F.cos(lat) + flat2 * F.sin(lat) * F.sin(lat))
    across = (c + height / WGS84_RADIUS) * F.cos(lat)
    up = (c * flat2 + height / WGS84_RADIUS) * F.sin(lat)
    return F.struct(
        lon.alias("lon"),
        F.degrees(F.atan2(up, across)).alias("lat"),
        F.sqrt(across * across + up * up).alias("rho"),
    )


def geocentric_to_geodetic(df, lon, lat, rho, prefix: str = "geod_", steps: int = 6):
    """Adds geodetic ``<prefix>lat`` and ``<prefix>height`` (metres) columns.

    The usual fixed-point iteration converges by a factor of 150 per step, so
    a constant number of projections suffices.
    """
    axis, up, phi = f"{prefix}axis", f"{prefix}up", f"{prefix}lat"
    lat_rad = F.radians(num(lat))
    df = df.withColumns({
        axis: num(rho) * F.cos(lat_rad) * WGS84_RADIUS,
        up: num(rho) * F.sin(lat_rad) * WGS84_RADIUS,
    }).withColumn(phi, F.atan2(F.col(up), F.col(axis)))

    def curvature():
        return 1 / F.sqrt(1 - _ECC2 * F.sin(F.col(phi)) * F.sin(F.col(phi)))

    for _ in range(steps):
        df = df.withColumn(
            phi, F.atan2(F.col(up) + WGS84_RADIUS * _ECC2 * curvature() * F.sin(F.col(phi)), F.col(axis))
        )
    # away from the equator the polar distance gives the height with more digits
    by_axis = F.col(axis) / F.cos(F.col(phi)) - WGS84_RADIUS * curvature()
    by_pole = F.col(up) / F.sin(F.col(phi)) - WGS84_RADIUS * (1 - _ECC2) * curvature()
    df = df.withColumn(f"{prefix}height", F.when(F.abs(F.col(phi)) > 0.8, by_pole).otherwise(by_axis))
    return df.withColumn(phi, F.degrees(F.col(phi))).drop(axis, up)
