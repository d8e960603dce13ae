"""Bounding boxes of footprints: arrays of one or two boxes per row.

A shape spans some width of right ascension, eastwards from a start, and a range of declinations; shapes that hold a pole
span the whole circle.  Where the span passes the 0/360 line there are two boxes, the part right of the line first.
Every point of a shape lies in its boxes: circles widen with the convergence of meridians, and great-circle edges count
with the point nearest to the pole that they pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sphere
from ._args import col, num
from .regions import _bind

BOX_TYPE = "struct<ra_min:double,dec_min:double,ra_max:double,dec_max:double>"
_TINY = 1e-10


def _box(ra_min, dec_min, ra_max, dec_max) -> Column:
    names = ("ra_min", "dec_min", "ra_max", "dec_max")
    return F.struct(*(num(v).cast("double").alias(n) for v, n in zip((ra_min, dec_min, ra_max, dec_max), names)))


def span_boxes(start, width, dec_min, dec_max) -> Column:
    """The boxes of a span of ``width`` degrees eastwards from ``start``."""
    span = F.struct(F.pmod(num(start), F.lit(360.0)).alias("a"), num(width).alias("w"), num(dec_min).alias("lo"), num(dec_max).alias("hi"))

    def boxes(s):
        end = s["a"] + s["w"]
        return F.when(s["w"] >= 360 - _TINY, F.array(_box(0.0, s["lo"], 360.0, s["hi"]))).when(
            end > 360, F.array(_box(0.0, s["lo"], end - 360, s["hi"]), _box(s["a"], s["lo"], 360.0, s["hi"]))).otherwise(
            F.array(_box(s["a"], s["lo"], end, s["hi"])))

    return _bind(span, boxes)


def split_boxes(ra_min, dec_min, ra_max, dec_max) -> Column:
    """Boxes of limits that may pass the 0/360 line or a pole; behind a pole the span goes on at all right ascensions."""
    limits = F.struct(num(ra_min).alias("a"), num(ra_max).alias("b"), num(dec_min).alias("lo"), num(dec_max).alias("hi"))

    def boxes(s):
        south, north = s["lo"] < -90, s["hi"] > 90
        eastwards = s["b"] - s["a"]
        width = F.when(south | north, 360.0).when(eastwards < 0, eastwards + 360).otherwise(F.least(eastwards, F.lit(360.0)))
        lowest = F.when(south, -90.0).when(north, F.least(s["lo"], 180 - s["hi"])).otherwise(s["lo"])
        highest = F.when(north, 90.0).when(south, F.greatest(s["hi"], -180 - s["lo"])).otherwise(s["hi"])
        return span_boxes(s["a"], width, lowest, highest)

    return _bind(limits, boxes)


def circle_boxes(ra, dec, radius) -> Column:
    ra, dec, radius = num(ra), num(dec), num(radius)
    # the meridian that touches the circle
    touching = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(radius)) / F.cos(F.radians(dec)))))
    half = F.when(F.abs(dec) + radius >= 90, 180.0).otherwise(touching)
    return span_boxes(ra - half, 2 * half, F.greatest(dec - radius, F.lit(-90.0)), F.least(dec + radius, F.lit(90.0)))


def ellipse_boxes(ra, dec, semi_major) -> Column:
    """The boxes of the circle around an ellipse, whatever its orientation."""
    return circle_boxes(ra, dec, semi_major)


def interval_boxes(ra_min=None, dec_min=None, ra_max=None, dec_max=None) -> Column:
    """Boxes of coordinate intervals; open ends go to the whole sky."""
    whole = {"ra_min": 0.0, "dec_min": -90.0, "ra_max": 360.0, "dec_max": 90.0}
    given = dict(zip(whole, (ra_min, dec_min, ra_max, dec_max)))
    limits = {k: F.lit(whole[k]) if v is None else F.coalesce(num(v), F.lit(whole[k])) for k, v in given.items()}
    return split_boxes(*limits.values())


def all_sky_boxes() -> Column:
    return F.array(_box(0.0, -90.0, 360.0, 90.0))


# --- great-circle edges ----------------------------------------------------

def _vector(ra, dec) -> Column:
    """Unit vector, with longitude and latitude (degrees) folded to the sphere."""
    a, d = F.radians(ra), F.radians(dec)
    v = F.struct((F.cos(d) * F.cos(a)).alias("x"), (F.cos(d) * F.sin(a)).alias("y"), F.sin(d).alias("z"))
    return _bind(v, lambda u: F.struct(
        u["x"].alias("x"), u["y"].alias("y"), u["z"].alias("z"),
        F.pmod(F.degrees(F.atan2(u["y"], u["x"])), F.lit(360.0)).alias("lon"),
        F.degrees(F.atan2(u["z"], F.sqrt(u["x"] * u["x"] + u["y"] * u["y"]))).alias("lat")))


def _edge(a: Column, b: Column) -> Column:
    """What an edge between two vectors spans: ``turn`` (signed degrees eastwards, the shorter way), ``lo``, ``hi`` and
    ``pole``, whether it passes one."""
    normal = F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"),
                      (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))

    def spanned(n):
        # northward part of the way at either end: the circle's summit lies between if it rises first and falls then
        rise_a = n["x"] * a["y"] - n["y"] * a["x"]
        rise_b = n["x"] * b["y"] - n["y"] * b["x"]
        summit = F.degrees(F.atan2(F.sqrt(n["x"] * n["x"] + n["y"] * n["y"]), F.abs(n["z"])))
        turn = F.pmod(b["lon"] - a["lon"] + 540, F.lit(360.0)) - 180
        at_pole = F.greatest(F.abs(a["lat"]), F.abs(b["lat"])) > 90 - _TINY
        low, high = F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])
        return F.struct(
            turn.alias("turn"),
            F.when((rise_a < -1e-15) & (rise_b > 1e-15), -summit).otherwise(low).alias("lo"),
            F.when((rise_a > 1e-15) & (rise_b < -1e-15), summit).otherwise(high).alias("hi"),
            (at_pole | (F.abs(F.abs(turn) - 180) < 1e-9)).alias("pole"))

    return _bind(normal, spanned)


def segment_boxes(lon1, lat1, lon2, lat2) -> Column:
    """One or two boxes of a great-circle segment shorter than 180 degrees; empty for a segment without length."""
    ends = F.struct(_vector(num(lon1), num(lat1)).alias("a"), _vector(num(lon2), num(lat2)).alias("b"))

    def boxes(s):
        a, b = s["a"], s["b"]
        apart = F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]) + F.abs(a["z"] - b["z"])
        found = _bind(_edge(a, b), lambda e: span_boxes(
            F.when(e["turn"] < 0, b["lon"]).otherwise(a["lon"]), F.when(e["pole"], 360.0).otherwise(F.abs(e["turn"])), e["lo"], e["hi"]))
        return F.when(apart < 1e-12, F.array().cast(f"array<{BOX_TYPE}>")).otherwise(found)

    return _bind(ends, boxes)


def join_boxes(boxes) -> Column:
    """The box around an array of boxes; NULL for an empty array."""
    boxes = col(boxes)
    low = lambda f: F.array_min(F.transform(boxes, lambda b: b[f]))
    high = lambda f: F.array_max(F.transform(boxes, lambda b: b[f]))
    return F.when(F.size(boxes) > 0, _box(low("ra_min"), low("dec_min"), high("ra_max"), high("dec_max")))


def polygon_boxes(vertices) -> Column:
    """Boxes of a polygon with great-circle edges, closed or not, that fits into half of the sky.

    Longitudes are unwound along the edges; a way round the whole circle, or an edge over a pole, means that the pole on
    the vertices' side belongs to the polygon.
    """
    vectors = F.transform(col(vertices), lambda v: _vector(v["ra"], v["dec"]))

    def boxes(vs):
        following = F.concat(F.slice(vs, F.lit(2), F.size(vs) - 1), F.slice(vs, 1, 1))
        edges = F.zip_with(vs, following, _edge)

        def unwound(es):
            start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("west"), F.lit(0.0).alias("east"))

            def step(s, e):
                at = s["at"] + e["turn"]
                return F.struct(at.alias("at"), F.least(s["west"], at).alias("west"), F.greatest(s["east"], at).alias("east"))

            way = F.aggregate(es, start, step)
            lo = F.array_min(F.transform(es, lambda e: e["lo"]))
            hi = F.array_max(F.transform(es, lambda e: e["hi"]))
            over = F.exists(es, lambda e: e["pole"])
            side = F.aggregate(vs, F.lit(0.0), lambda total, v: total + v["z"])

            def result(w):
                round_ = over | (F.abs(w["at"]) > 180)
                return span_boxes(F.element_at(vs, 1)["lon"] + w["west"], F.when(round_, 360.0).otherwise(w["east"] - w["west"]),
                                  F.when(round_ & (side < 0), -90.0).otherwise(lo), F.when(round_ & (side > 0), 90.0).otherwise(hi))

            return _bind(way, result)

        return _bind(edges, unwound)

    return _bind(vectors, boxes)


def box_boxes(ra, dec, half_width, half_height) -> Column:
    """Boxes of a box whose upper and lower sides are great circles (parallels, where it spans half of the sky or more)."""
    ra, dec, dx, dy = num(ra), num(dec), num(half_width), num(half_height)
    top, bottom = sphere.clamp_dec(dec + dy), sphere.clamp_dec(dec - dy)

    def middle(lat):  # of the great circle between the corners at this latitude
        return F.degrees(F.atan(F.tan(F.radians(lat)) / F.cos(F.radians(dx))))

    at_pole = (top > 90 - _TINY) | (bottom < -90 + _TINY)
    narrow = (dx < 90) & ~at_pole
    highest = F.when(narrow & (top > 0), middle(top)).otherwise(top)
    lowest = F.when(narrow & (bottom < 0), middle(bottom)).otherwise(bottom)
    return span_boxes(ra - dx, F.when(at_pole, 360.0).otherwise(2 * dx), lowest, highest)


def union_boxes(*parts) -> Column:
    return F.concat(*map(col, parts))


def intersection_boxes(first, second) -> Column:
    """The non-empty intersections of each box of one array with each of the other."""
    def cut(a, b):
        return _box(F.greatest(a["ra_min"], b["ra_min"]), F.greatest(a["dec_min"], b["dec_min"]),
                    F.least(a["ra_max"], b["ra_max"]), F.least(a["dec_max"], b["dec_max"]))

    pairs = F.flatten(F.transform(col(first), lambda a: F.transform(col(second), lambda b: cut(a, b))))
    return F.filter(pairs, lambda b: (b["ra_min"] < b["ra_max"]) & (b["dec_min"] < b["dec_max"]))


def difference_boxes(first, _second=None) -> Column:
    """Boxes of the first operand; what is cut out does not count."""
    return col(first)


def not_boxes(_operand=None) -> Column:
    return all_sky_boxes()


def planar_box(points) -> Column:
    """Struct (x0, y0, x1, y1) around an array of (x, y) points."""
    points = col(points)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
