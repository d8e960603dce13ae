"""Positional joins: pairs of rows within a radius on the sphere.

The sphere is cut into declination zones, each zone into right ascension
buckets about as wide as the zone is high on the sky, so that cells have
similar areas up to the poles (after the zones algorithm of Gray,
Nieto-Santisteban and Szalay 2006).  One side sits in one cell per row; the
other is copied to the few cells its circle touches.  The join is an
equi-join on the cell; the exact distance decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere
from .skew import salted, spread_pairs

MIN_ZONE_HEIGHT = 1.0 / 3600
_ZONE_STEP = 1 << 32
_SKY_AREA = 360.0 * 360.0 / math.pi
# dense spots are looked for in blocks of cells, of which there are at most about this many
_MAX_BLOCKS = 1 << 24


def _bucket_count(zone: Column, height: float) -> Column:
    """RA buckets of a zone, at least one; even the poleward edge has buckets of ``height`` on the sky."""
    low = zone * height - 90.0
    farthest = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(low + height)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(farthest)) / height)).cast("bigint")


def _zone(dec: Column, height: float) -> Column:
    return F.floor((dec + 90.0) / height).cast("bigint")


def with_cell(df: DataFrame, ra, dec, height: float, out: str = "__cell") -> DataFrame:
    """Adds the cell a position falls into."""
    df = df.withColumn("__zone", _zone(dec, height))
    count = _bucket_count(F.col("__zone"), height)
    bucket = F.least(count - 1, F.floor(sphere.fold_ra(ra) * count / 360.0).cast("bigint"))
    return df.withColumn(out, F.col("__zone") * _ZONE_STEP + bucket).drop("__zone")


def block_shift(height: float) -> int:
    """How many bits of a cell number to drop for blocks of neighbouring cells in a zone."""
    return max(0, math.ceil(math.log2(max(1.0, _SKY_AREA / (height * height) / _MAX_BLOCKS))))


def with_touched_cells(df: DataFrame, ra, dec, radius: Column, height: float, out: str = "__cell") -> DataFrame:
    """One row per cell a circle touches."""
    slack = sphere.BAND_SLACK
    reach = radius + slack
    top = int(math.floor(180.0 / height))
    over_pole = F.abs(dec) + reach >= 90
    ratio = F.sin(F.radians(F.least(reach, F.lit(90.0)))) / F.cos(F.radians(dec))
    half = F.when(over_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + slack)
    zones = F.sequence(
        F.greatest(F.lit(0), _zone(dec - reach, height)), F.least(F.lit(top), _zone(dec + reach, height)))
    df = df.withColumns({"__ra": sphere.fold_ra(ra), "__half": half, "__zone": F.explode(zones)})
    df = df.withColumn("__count", _bucket_count(F.col("__zone"), height))
    count = F.col("__count")
    first = F.floor((F.col("__ra") - F.col("__half")) * count / 360.0).cast("bigint")
    last = F.floor((F.col("__ra") + F.col("__half")) * count / 360.0).cast("bigint")
    # a circle wider than the zone's ring must not meet a bucket twice
    df = df.withColumn("__bucket", F.explode(F.sequence(first, F.least(last, first + count - 1))))
    return df.withColumn(
        out, F.col("__zone") * _ZONE_STEP + F.pmod(F.col("__bucket"), F.col("__count"))
    ).drop("__ra", "__half", "__zone", "__count", "__bucket")


def crossmatch(left: DataFrame, right: DataFrame, radius, left_ra="ra", left_dec="dec", right_ra="ra",
               right_dec="dec", how: str = "inner", distance: str = "dist", zone_height: float | None = None,
               max_radius: float | None = None, left_suffix: str = "_1", right_suffix: str = "_2",
               slice_rows: int = 1_000_000) -> DataFrame:
    """All pairs of rows at most ``radius`` degrees apart, with their distance.

    ``right`` is the side that is copied to neighbouring cells, so pass the
    smaller table there.  ``radius`` may be the name of a column of ``right``,
    with ``max_radius`` fixing the cell size (bigger radii stay correct and
    just touch more cells).  Cells with more than ``slice_rows`` pairs to look
    at are spread over tasks; for semi and anti joins blocks of cells
    holding more than that many rows of ``left``.  ``how`` is ``inner``, ``left_semi`` or ``left_anti``.
    Columns with the same name on both sides get the suffixes.
    """
    per_row = isinstance(radius, str)
    size = max_radius if per_row else float(radius)
    if size is None:
        raise ValueError("a radius column needs max_radius")
    height = min(90.0, max(zone_height or size, MIN_ZONE_HEIGHT))
    shared = set(left.columns) & set(right.columns)
    rename = lambda df, suffix: df.select(*(
        F.col(c).alias(c + suffix if c in shared else c) for c in df.columns))
    named = lambda c, suffix: F.col(c + suffix if c in shared else c)
    left, right = rename(left, left_suffix), rename(right, right_suffix)
    ra1, dec1 = named(left_ra, left_suffix), named(left_dec, left_suffix)
    ra2, dec2 = named(right_ra, right_suffix), named(right_dec, right_suffix)
    reach = named(radius, right_suffix) if per_row else F.lit(float(radius))
    a = with_cell(left.filter(ra1.isNotNull() & dec1.isNotNull()) if how == "inner" else left, ra1, dec1, height)
    b = with_touched_cells(right.filter(ra2.isNotNull() & dec2.isNotNull()), ra2, dec2, reach, height)
    if how == "inner":
        a, b = spread_pairs(a, b, ["__cell"], slice_rows)
        pairs = a.join(b, ["__cell", "__salt"]).drop("__salt")
        close = sphere.haversine_term(ra1, dec1, ra2, dec2)
        pairs = pairs.withColumn(distance, F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), close)))))
        return pairs.filter(F.col(distance) <= reach).drop("__cell")
    if how in ("left_semi", "left_anti"):
        shift = block_shift(height)
        a, b = (df.withColumn("__block", F.shiftright("__cell", shift)) for df in (a, b))
        a, b = (df.drop("__block") for df in salted(a, b, ["__block"], slice_rows))
        condition = (a["__cell"] == b["__cell"]) & (a["__salt"] == b["__salt"]) & sphere.within(
            ra1, dec1, ra2, dec2, reach)
        return a.join(b, condition, how).drop("__cell", "__salt")
    raise ValueError(f"no {how} crossmatch")


def match_regions(points: DataFrame, regions: DataFrame, predicate, ra="ra", dec="dec", center_ra="center_ra",
                  center_dec="center_dec", radius="radius", max_radius: float = 5.0) -> DataFrame:
    """Points joined to the regions containing them.

    Each region brings a circle around it; ``predicate`` is the exact test on
    the columns of both tables.  Works for any number of regions, as only the
    cells of their circles are joined.
    """
    pairs = crossmatch(points, regions, radius, ra, dec, center_ra, center_dec, max_radius=max_radius,
                       distance="__dist")
    return pairs.filter(predicate).drop("__dist")


def nearest(df: DataFrame, ra0: float, dec0: float, n: int, max_radius: float = 180.0, ra="ra", dec="dec",
            out: str = "dist", ties=()) -> DataFrame:
    """The ``n`` objects nearest to a position, nearest first, by distance and then ``ties``."""
    if max_radius < 180:
        df = df.filter(sphere.in_cone(ra, dec, ra0, dec0, max_radius))
    found = df.withColumn(out, sphere.distance(ra, dec, ra0, dec0))
    return found.orderBy(F.col(out).asc_nulls_last(), *ties).limit(n)


def cone_search(df: DataFrame, ra0: float, dec0: float, radius: float, ra="ra", dec="dec", out: str = "dist",
                folded: bool = False, sort: bool = True, ties=()) -> DataFrame:
    """Rows in a cone with their distance, nearest first.

    ``folded`` promises right ascensions in [0, 360); the cone's range of
    them then prunes the scan as its declination range does.
    """
    df = df.filter(sphere.dec_band(dec, dec0, radius))
    if folded:
        df = df.filter(sphere.ra_band(ra, ra0, dec0, radius))
    df = df.withColumn(out, sphere.distance(ra, dec, ra0, dec0)).filter(F.col(out) <= float(radius))
    return df.orderBy(F.col(out), *ties) if sort else df


def multi_cone(df: DataFrame, positions, radius: float, ra="ra", dec="dec") -> DataFrame:
    """Rows strictly within ``radius`` of any of a few positions."""
    test = F.lit(False)
    for ra0, dec0 in positions:
        near = sphere.distance(ra, dec, float(ra0), float(dec0)) < float(radius)
        test = test | (sphere.dec_band(dec, float(dec0), float(radius)) & near)
    return df.filter(test)
