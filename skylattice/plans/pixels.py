"""Images as pixel tables (key, x, y, value): cutouts, downscaling, axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions, stctext
from ..functions._args import col, num
from ..functions.units import LIGHT_C, conversion_factor
from ..session import scratch_path
from ..sources.ranges import spread
from .images import pixel_slice


# --- one axis: value = crval + (pixel - crpix) * cdelt ------------------------

def pixel_to_value(pixel, crval, crpix, cdelt) -> Column:
    """Physical value of a 1-based pixel coordinate."""
    return num(crval) + (num(pixel) - num(crpix)) * num(cdelt)


def value_to_pixel(value, crval, crpix, cdelt) -> Column:
    return (num(value) - num(crval)) / num(cdelt) + num(crpix)


def axis_limits(length, crval, crpix, cdelt) -> Column:
    """Struct (low, high) of the values an axis takes."""
    first, last = pixel_to_value(1.0, crval, crpix, cdelt), pixel_to_value(length, crval, crpix, cdelt)
    return F.struct(F.least(first, last).alias("low"), F.greatest(first, last).alias("high"))


# --- cutouts -----------------------------------------------------------------

def crop(first, last, length) -> Column:
    """Struct (first, last) of a 1-based inclusive pixel range inside an axis; at least one pixel is left."""
    length = col(length)
    low = F.least(F.greatest(F.lit(1), F.coalesce(col(first), F.lit(1))), length)
    high = F.least(length, F.greatest(F.lit(1), F.coalesce(col(last), length)))
    return F.struct(low.alias("first"), F.greatest(low, high).alias("last"))


def _limit(value):
    return F.lit(None).cast("bigint") if value is None else col(value)


def cut_pixels(df: DataFrame, cuts: dict, lengths: dict, ref_pixels: dict | None = None) -> DataFrame:
    """Pixels inside ranges, counted anew from 1, with reference pixels shifted along.

    ``cuts`` maps axis columns to (first, last), 1-based and inclusive, None
    being open; ``lengths`` maps axis columns to their length (number or
    column); ``ref_pixels`` maps axis columns to reference pixel columns.
    """
    kept = df
    for axis, (first, last) in cuts.items():
        kept = kept.withColumn(f"__{axis}", crop(_limit(first), _limit(last), lengths[axis]))
        kept = kept.filter(F.col(axis).between(F.col(f"__{axis}.first"), F.col(f"__{axis}.last")))
    changed = {}
    for axis in cuts:
        shift = F.col(f"__{axis}.first") - 1
        changed[axis] = F.col(axis) - shift
        if ref_pixels and axis in ref_pixels:
            changed[ref_pixels[axis]] = F.col(ref_pixels[axis]) - shift
    return kept.withColumns(changed).drop(*(f"__{a}" for a in cuts)) if cuts else kept


def spectral_cut(df: DataFrame, axis: str, low_m: float | None, high_m: float | None, unit: str, crval, crpix, cdelt,
                 length, ref_pixel: str | None = None) -> DataFrame:
    """Planes of cubes between wavelengths in metres; the axis may be in wavelength or frequency units."""
    def on_axis(metres):
        if metres is None:
            return None
        try:
            value = metres * conversion_factor("m", unit)
        except ValueError:
            value = LIGHT_C / metres * conversion_factor("Hz", unit)
        return value_to_pixel(float(value), crval, crpix, cdelt)

    ends = [on_axis(low_m), on_axis(high_m)]
    if all(e is not None for e in ends):
        ends = [F.least(*ends), F.greatest(*ends)]
    first = None if ends[0] is None else F.ceil(ends[0] - 1e-9)
    last = None if ends[1] is None else F.floor(ends[1] + 1e-9)
    return cut_pixels(df, {axis: (first, last)}, {axis: length}, {axis: ref_pixel} if ref_pixel else None)


def region_cut(pixels: DataFrame, images: DataFrame, key: str, text: str) -> DataFrame:
    """Pixels of each image in the smallest pixel rectangle around a region, counted anew from 1.

    ``images`` has one row per image with its TAN description; images off
    the region give nothing.
    """
    shape = stctext.parse_search_shape(text)
    if shape.kind == "circle":
        area = regions.circle_to_polygon(shape.column())
    elif shape.kind == "range":
        ra_min, ra_max, dec_min, dec_max = shape.numbers
        area = regions.box_to_polygon(regions.interval_box(ra_min, dec_min, ra_max, dec_max))
    else:
        area = shape.column()
    # the region is the same for all images: its corners are worked out once; an image is a small row and much work
    corners = pixels.sparkSession.range(1).select(area.alias("v")).first()["v"]
    area = F.array(*(regions.point(p["ra"], p["dec"]) for p in corners))
    images = spread(images, key, tasks=int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # kept before they are filtered: a filter would move into the scan of the images, and to its few tasks
    slices, path = images.select(key, pixel_slice(area).alias("__r")), scratch_path(images.sparkSession, "slices")
    slices.write.parquet(path)
    ranges = images.sparkSession.read.schema(slices.schema).parquet(path).filter(F.col("__r").isNotNull())
    inside = (F.col("x").between(F.col("__r.x0"), F.col("__r.x1"))
              & F.col("y").between(F.col("__r.y0"), F.col("__r.y1")))
    kept = pixels.join(ranges, key).filter(inside)
    return kept.withColumns({"x": F.col("x") - F.col("__r.x0") + 1, "y": F.col("y") - F.col("__r.y0") + 1}).drop("__r")


def downscale(df: DataFrame, factor: int, width, height, key=("image",), value: str = "value") -> DataFrame:
    """Block averages by an integer factor; pixels of incomplete blocks at the border are left out."""
    if factor < 1:
        raise ValueError("the factor must be at least 1")
    x, y = F.floor((F.col("x") - 1) / factor), F.floor((F.col("y") - 1) / factor)
    whole = (x < F.floor(col(width) / factor)) & (y < F.floor(col(height) / factor))
    return df.filter(whole).groupBy(*key, (x + 1).alias("x"), (y + 1).alias("y")).agg(F.avg(value).alias(value))


def factor_for_size(width: int, height: int, wanted: int) -> int:
    """Downscaling factor that brings the longer side to about a size."""
    return max(1, max(width, height) // wanted + 1)
