"""Image catalogues: box and shape searches, TAN world coordinates, cutouts estimated per row.

An image row has wcs_refPixel and wcs_refValues (two numbers each),
wcs_cdmatrix (four, row by row), pixelSize (two) and a coverage polygon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions, sphere, stctext
from ..functions._args import col, num

INTERSECT_MODES = ("COVERS", "ENCLOSED", "CENTER", "OVERLAPS")


def parse_position(text: str) -> tuple[float, float]:
    """``ra,dec``; a sign may stand for a lost comma."""
    for sign in (",", "+", "-"):
        parts = text.split(sign)
        if len(parts) == 2 and all(x.strip() for x in parts):
            try:
                # the sign that stood for the comma is not read as a minus
                return float(parts[0]), float(parts[1])
            except ValueError:
                continue
    raise ValueError(f"{text!r} is no ra,dec pair")


def search_boxes(ra: float, dec: float, width: float, height: float) -> list[tuple[float, float, float, float]]:
    """Boxes (ra_min, dec_min, ra_max, dec_max) of a search area; two when it folds over a pole."""
    span = 360.0 if 90 - abs(dec) < 0.1 else width / math.cos(math.radians(dec))
    left, right = ra - span / 2, ra + span / 2
    bottom, top = dec - abs(height) / 2, dec + abs(height) / 2
    if bottom < -90 and top > 90:
        raise ValueError("search area over both poles")
    if bottom < -90:
        return [(left, -90.0, right, top), (left + 180, -90.0, right + 180, top)]
    if top > 90:
        return [(left, bottom, right, 90.0), (left + 180, bottom, right + 180, 90.0)]
    return [(left, bottom, right, top)]


def box_search(ra: float, dec: float, size, mode: str = "OVERLAPS", coverage="coverage") -> Column:
    """Predicate of an image search by box in one of the four modes.

    COVERS: the image covers the whole box; ENCLOSED: the image lies in the
    box; CENTER: the image covers the box's centre; OVERLAPS: they share a
    point.
    """
    width, height = size if isinstance(size, (tuple, list)) else (size, size)
    if mode not in INTERSECT_MODES:
        raise ValueError(f"{mode} is none of {', '.join(INTERSECT_MODES)}")
    if mode == "CENTER":
        return regions.point_in_polygon(regions.point(float(ra), float(dec)), coverage)
    test = {"COVERS": regions.polygon_covers_constant_box, "ENCLOSED": regions.polygon_in_constant_box,
            "OVERLAPS": regions.polygon_intersects_constant_box}[mode]
    result = None
    for limits in search_boxes(ra, dec, width, height):
        one = test(coverage, limits)
        result = one if result is None else result | one
    return result


def search_images(df: DataFrame, params: dict, coverage: str = "coverage",
                  center: tuple[str, str] | None = None, reach: str | None = None) -> DataFrame:
    """Images by POS, SIZE and INTERSECT.

    With ``center`` (ra, dec columns) and ``reach`` (a column with a radius in
    degrees around the whole footprint), a declination comparison goes before
    the polygon test.
    """
    ra, dec = parse_position(params["POS"])
    sizes = [float(s) for s in params["SIZE"].split(",")]
    size = tuple(sizes * 2 if len(sizes) == 1 else sizes)
    test = box_search(ra, dec, size, params.get("INTERSECT", "OVERLAPS"), coverage)
    if center and reach:
        boxes = search_boxes(ra, dec, *size)
        low, high = min(b[1] for b in boxes), max(b[3] for b in boxes)
        near = (F.col(center[1]) + F.col(reach) >= low) & (F.col(center[1]) - F.col(reach) <= high)
        test = near & test
    return df.filter(test)


def shape_search(text: str, coverage="coverage", center: tuple[str, str] | None = None,
                 reach: str | None = None) -> Column:
    """CIRCLE, RANGE or POLYGON against a footprint column: whether they intersect.

    With ``center`` (ra, dec columns) and ``reach`` (a column with a radius in
    degrees around the whole footprint), comparisons of declinations, and for
    circles of distances, go before the polygon test.
    """
    shape = stctext.parse_search_shape(text)
    if shape.kind == "circle":
        ra, dec, radius = shape.numbers
        low, high = dec - radius, dec + radius
        test = regions.circle_intersects_polygon(shape.column(), coverage)
    elif shape.kind == "range":
        ra_min, ra_max, low, high = shape.numbers
        test = regions.polygon_intersects_constant_box(coverage, (ra_min, low, ra_max, high))
    else:
        low, high = regions.dec_range(shape.vertices)
        test = regions.polygons_intersect(coverage, shape.column())
    if not (center and reach):
        return test
    slack = sphere.BAND_SLACK
    near = (F.col(center[1]) + F.col(reach) >= low - slack) & (F.col(center[1]) - F.col(reach) <= high + slack)
    if shape.kind == "circle":
        near = near & (sphere.distance(*center, ra, dec) <= F.col(reach) + radius + slack)
    return near & test


# --- TAN projection ---------------------------------------------------------

def pixel_to_sky(x, y, ref_pixel="wcs_refPixel", ref_value="wcs_refValues", cd="wcs_cdmatrix") -> Column:
    """Struct (ra, dec) of 1-based pixel coordinates of a TAN image."""
    x, y, p, v, m = num(x), num(y), col(ref_pixel), col(ref_value), col(cd)
    dx, dy = x - p[0], y - p[1]
    xi, eta = F.radians(m[0] * dx + m[1] * dy), F.radians(m[2] * dx + m[3] * dy)
    dec0 = F.radians(v[1])
    below = F.cos(dec0) - eta * F.sin(dec0)
    ra = v[0] + F.degrees(F.atan2(xi, below))
    dec = F.degrees(F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.sqrt(xi * xi + below * below)))
    return F.struct(sphere.fold_ra(ra).alias("ra"), dec.alias("dec"))


def sky_to_pixel(ra, dec, ref_pixel="wcs_refPixel", ref_value="wcs_refValues", cd="wcs_cdmatrix") -> Column:
    """Struct (x, y) of a position on a TAN image; NULL for positions on the far half of the sky."""
    p, v, m = col(ref_pixel), col(ref_value), col(cd)
    dra, dec, dec0 = F.radians(num(ra) - v[0]), F.radians(num(dec)), F.radians(v[1])
    depth = F.sin(dec) * F.sin(dec0) + F.cos(dec) * F.cos(dec0) * F.cos(dra)
    xi = F.degrees(F.cos(dec) * F.sin(dra) / depth)
    eta = F.degrees((F.sin(dec) * F.cos(dec0) - F.cos(dec) * F.sin(dec0) * F.cos(dra)) / depth)
    determinant = m[0] * m[3] - m[1] * m[2]
    return F.when(depth > 0, F.struct(
        (p[0] + (m[3] * xi - m[1] * eta) / determinant).alias("x"),
        (p[1] + (m[0] * eta - m[2] * xi) / determinant).alias("y")))


def footprint_of_wcs(size="pixelSize", **wcs) -> Column:
    """Corners of a TAN image, through the outer pixel centres."""
    n = col(size)
    corners = ((F.lit(1.0), F.lit(1.0)), (F.lit(1.0), n[1].cast("double")),
               (n[0].cast("double"), n[1].cast("double")), (n[0].cast("double"), F.lit(1.0)))
    return F.array(*(pixel_to_sky(x, y, **wcs) for x, y in corners))


def with_image_metadata(headers: DataFrame) -> DataFrame:
    """Adds centre, scale, size and footprint to rows with FITS header cards as text or number columns.

    Wants NAXIS1, NAXIS2, CRPIX1/2, CRVAL1/2, CTYPE1 and a CD matrix (or
    CDELT1/2 with CROTA2).  Rows not in TAN projection keep NULLs.
    """
    def card(name, default=None):
        value = F.col(name).cast("double") if name in headers.columns else F.lit(None).cast("double")
        return F.coalesce(value, F.lit(default)) if default is not None else value

    turn = F.radians(card("CROTA2", 0.0))
    cd = F.array(
        F.coalesce(card("CD1_1"), card("CDELT1") * F.cos(turn)),
        F.coalesce(card("CD1_2"), -card("CDELT2") * F.sin(turn)),
        F.coalesce(card("CD2_1"), card("CDELT1") * F.sin(turn)),
        F.coalesce(card("CD2_2"), card("CDELT2") * F.cos(turn)))
    tan = F.coalesce(F.col("CTYPE1").rlike("^RA---TAN") if "CTYPE1" in headers.columns else F.lit(False), F.lit(False))
    df = headers.withColumns({
        "nAxes": card("NAXIS", 2.0).cast("int"),
        "pixelSize": F.array(card("NAXIS1").cast("int"), card("NAXIS2").cast("int")),
        "wcs_refPixel": F.array(card("CRPIX1"), card("CRPIX2")),
        "wcs_refValues": F.array(card("CRVAL1"), card("CRVAL2")),
        "wcs_cdmatrix": cd,
        "wcs_projection": F.when(tan, "TAN")})
    m = F.col("wcs_cdmatrix")
    df = df.withColumns({
        "pixelScale": F.array(F.sqrt(m[0] * m[0] + m[2] * m[2]), F.sqrt(m[1] * m[1] + m[3] * m[3])),
        "__center": F.when(tan, pixel_to_sky((card("NAXIS1") + 1) / 2, (card("NAXIS2") + 1) / 2)),
        "coverage": F.when(tan, footprint_of_wcs())})
    return df.withColumns({"centerAlpha": F.col("__center.ra"), "centerDelta": F.col("__center.dec")}).drop("__center")


def cutout_estimate(df: DataFrame, ra: float | None, dec: float | None, width: float, height: float,
                    bytes_per_pixel: int = 2) -> DataFrame:
    """New centre, reference pixel and estimated size of the cutout a search would give of each image.

    Without a position the images' own centres are kept.
    """
    if dec is not None:
        cosine = math.cos(math.radians(dec))
        width = width / cosine if abs(cosine) > 1e-5 else 360.0
    center_ra = F.lit(float(ra)) if ra is not None else F.col("centerAlpha")
    center_dec = F.lit(float(dec)) if dec is not None else F.col("centerDelta")
    df = df.withColumns({
        "__a": sky_to_pixel(center_ra - width / 2, center_dec - height / 2),
        "__b": sky_to_pixel(center_ra + width / 2, center_dec + height / 2),
        "__c": sky_to_pixel(center_ra, center_dec)})
    pixels = F.abs(F.col("__a.x") - F.col("__b.x")) * F.abs(F.col("__a.y") - F.col("__b.y"))
    estimate = F.floor(bytes_per_pixel * pixels).cast("bigint")
    usable = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("__c").isNotNull()
    return df.withColumns({
        "accsize": F.when(usable, F.least(F.col("accsize"), estimate)).otherwise(F.col("accsize")),
        "wcs_refPixel": F.when(usable, F.array(F.col("__c.x") - F.col("__b.x"), F.col("__c.y") - F.col("__b.y")))
        .otherwise(F.col("wcs_refPixel")),
        "wcs_refValues": F.when(usable, F.array(center_ra, center_dec)).otherwise(F.col("wcs_refValues")),
        "centerAlpha": F.when(usable, center_ra).otherwise(F.col("centerAlpha")),
        "centerDelta": F.when(usable, center_dec).otherwise(F.col("centerDelta")),
    }).drop("__a", "__b", "__c")


def pixel_slice(vertices, size="pixelSize") -> Column:
    """Pixel ranges (x0, x1, y0, y1) covering a sky polygon on a TAN image, cropped to it; NULL off the image."""
    n = col(size)
    corners = F.transform(col(vertices), lambda v: sky_to_pixel(v["ra"], v["dec"]))

    def bounds(c):
        low = lambda f: F.floor(F.array_min(F.transform(c, lambda q: q[f]))).cast("bigint")
        high = lambda f: F.ceil(F.array_max(F.transform(c, lambda q: q[f]))).cast("bigint")
        x0, x1 = F.greatest(F.lit(1), low("x")), F.least(n[0].cast("bigint"), high("x"))
        y0, y1 = F.greatest(F.lit(1), low("y")), F.least(n[1].cast("bigint"), high("y"))
        whole = F.forall(c, lambda q: q.isNotNull())
        return F.when(whole & (x0 <= x1) & (y0 <= y1),
                      F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")))

    return F.element_at(F.transform(F.array(corners), bounds), 1)
