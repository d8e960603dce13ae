"""Shapes on the sphere as columns, and tests between them.

A point is ``struct<ra,dec>``, a circle ``struct<ra,dec,radius>``, a polygon
``array<struct<ra,dec>>``, a box ``struct<ra_min,dec_min,ra_max,dec_max>``;
everything in degrees.  Polygons must fit into a half sphere; they need not
be convex.  Edges belong to the shapes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import frames, sphere
from ._args import col, num

_EDGE = 1e-11


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- constructors ----------------------------------------------------------

point = sphere.point


def circle(ra, dec, radius) -> Column:
    return F.struct(*(num(v).cast("double").alias(n) for v, n in zip((ra, dec, radius), ("ra", "dec", "radius"))))


def polygon(*coordinates) -> Column:
    """Polygon of alternating ra and dec values, at least three pairs."""
    if len(coordinates) < 6 or len(coordinates) % 2:
        raise ValueError("polygons need at least three coordinate pairs")
    return F.array(*(point(coordinates[i], coordinates[i + 1]) for i in range(0, len(coordinates), 2)))


def box(ra, dec, width, height) -> Column:
    """Box around a centre, as a polygon with corners at half the sizes."""
    ra, dec, dx, dy = num(ra), num(dec), num(width) / 2, num(height) / 2
    return polygon(ra - dx, dec - dy, ra - dx, dec + dy, ra + dx, dec + dy, ra + dx, dec - dy)


def interval_box(ra_min, dec_min, ra_max, dec_max) -> Column:
    names = ("ra_min", "dec_min", "ra_max", "dec_max")
    return F.struct(*(num(v).cast("double").alias(n) for v, n in zip((ra_min, dec_min, ra_max, dec_max), names)))


def box_to_polygon(b) -> Column:
    """The four corners of a box, starting lower left, then upper left."""
    b = col(b)
    lo_ra, hi_ra = F.least(b["ra_min"], b["ra_max"]), F.greatest(b["ra_min"], b["ra_max"])
    lo_dec, hi_dec = F.least(b["dec_min"], b["dec_max"]), F.greatest(b["dec_min"], b["dec_max"])
    return polygon(lo_ra, lo_dec, lo_ra, hi_dec, hi_ra, hi_dec, hi_ra, lo_dec)


def circle_to_polygon(c, corners: int = 32) -> Column:
    """Points on a circle, as a polygon."""
    c = col(c)

    def vertex(step):
        angle = step * (2 * math.pi / corners)
        r, dec = F.radians(c["radius"]), F.radians(c["dec"])
        across, along, out = F.sin(r) * F.sin(angle), F.sin(r) * F.cos(angle), F.cos(r)
        x = out * F.cos(dec) - along * F.sin(dec)
        z = out * F.sin(dec) + along * F.cos(dec)
        return F.struct(
            sphere.fold_ra(c["ra"] + F.degrees(F.atan2(across, x))).alias("ra"),
            F.degrees(F.atan2(z, F.sqrt(x * x + across * across))).alias("dec"))

    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), vertex)


# --- parts -----------------------------------------------------------------

def coord1(p) -> Column:
    return col(p)["ra"]


def coord2(p) -> Column:
    return col(p)["dec"]


def coordsys(df, name: str) -> str:
    """The frame kept in the metadata of a geometry column."""
    return df.schema[name].metadata.get("frame", "UNKNOWN")


def centroid(shape, kind: str) -> Column:
    """Centre of a point or circle; other shapes have none here."""
    if kind not in ("point", "circle"):
        raise ValueError(f"no centroid for a {kind}")
    return point(col(shape)["ra"], col(shape)["dec"])


def polygon_vectors(vertices) -> Column:
    """The corners of a polygon as unit vectors."""
    return F.transform(col(vertices), lambda v: sphere.unit_vector(v["ra"], v["dec"]))


def _rotated(items: Column) -> Column:
    return F.concat(F.slice(items, F.lit(2), F.size(items) - 1), F.slice(items, 1, 1))



def _zip_edges(vectors: Column) -> Column:
    return F.zip_with(vectors, _rotated(vectors), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _dot(a, b) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _cross(a, b) -> Column:
    return F.struct(
        (a["y"] * b["z"] - a["z"] * b["y"]).alias("x"),
        (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"),
        (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def _triple(a, b, c) -> Column:
    """(a x b) . c"""
    return ((a["y"] * b["z"] - a["z"] * b["y"]) * c["x"]
            + (a["z"] * b["x"] - a["x"] * b["z"]) * c["y"]
            + (a["x"] * b["y"] - a["y"] * b["x"]) * c["z"])


def _norm(a) -> Column:
    return F.sqrt(_dot(a, a))


def area_circle(c) -> Column:
    """Square degrees of a circle."""
    return 2 * math.pi * (1 - F.cos(F.radians(col(c)["radius"]))) * (180 / math.pi) ** 2


def area_polygon(vertices) -> Column:
    """Square degrees of a polygon, by the signed triangles from its first vertex."""
    vectors = polygon_vectors(vertices)

    def excess(v):
        first = F.element_at(v, 1)
        triangles = F.transform(_zip_edges(v), lambda e: 2 * F.atan2(
            _triple(first, e["a"], e["b"]),
            1 + _dot(first, e["a"]) + _dot(e["a"], e["b"]) + _dot(e["b"], first)))
        return F.abs(F.aggregate(triangles, F.lit(0.0), lambda total, t: total + t)) * (180 / math.pi) ** 2

    return _bind(vectors, excess)


# --- tests against columns of shapes ---------------------------------------

def point_in_circle(p, c) -> Column:
    p, c = col(p), col(c)
    return sphere.within(p["ra"], p["dec"], c["ra"], c["dec"], c["radius"])


def _vector_in_polygon(p: Column, vectors: Column) -> Column:
    """Winding test; points on an edge count as inside."""
    angles = F.transform(_zip_edges(vectors), lambda e: F.atan2(
        _triple(e["a"], e["b"], p),
        _dot(e["a"], e["b"]) - _dot(e["a"], p) * _dot(e["b"], p)))
    same_side = F.exists(vectors, lambda v: _dot(v, p) > 0)
    at_vertex = F.exists(vectors, lambda v: _dot(v, p) > 1 - 1e-15)
    winding = F.abs(F.aggregate(angles, F.lit(0.0), lambda total, a: total + a)) > math.pi
    on_edge = F.exists(angles, lambda a: F.abs(a) > math.pi - 1e-9)
    return same_side & (at_vertex | on_edge | winding)


def point_in_polygon(p, vertices) -> Column:
    """Whether a point lies in a polygon, convex or not."""
    p = col(p)
    return vector_in_polygon(sphere.unit_vector(p["ra"], p["dec"]), polygon_vectors(vertices))


def vector_in_polygon(p, vectors) -> Column:
    """As :func:`point_in_polygon`, for a point and corners that are unit vectors already."""
    both = F.struct(col(p).alias("p"), col(vectors).alias("v"))
    return _bind(both, lambda s: _vector_in_polygon(s["p"], s["v"]))


def point_in_box(p, b) -> Column:
    """Whether a point lies in a box; boxes over the 0/360 line have ra limits outside [0, 360)."""
    p, b = col(p), col(b)
    return p["dec"].between(b["dec_min"], b["dec_max"]) & (
        F.pmod(p["ra"] - b["ra_min"], F.lit(360.0)) <= b["ra_max"] - b["ra_min"])


def circle_in_circle(inner, outer) -> Column:
    inner, outer = col(inner), col(outer)
    apart = sphere.distance(inner["ra"], inner["dec"], outer["ra"], outer["dec"])
    return apart + inner["radius"] <= outer["radius"]


def polygon_in_circle(vertices, c) -> Column:
    """All vertices in the circle; exact for radii up to 90 degrees."""
    c = col(c)
    return F.forall(col(vertices), lambda v: sphere.within(v["ra"], v["dec"], c["ra"], c["dec"], c["radius"]))


def _edge_distance(p: Column, e: Column) -> Column:
    """Distance in radians of a vector from a great-circle segment."""
    a, b = e["a"], e["b"]
    normal_size = _norm(_cross(a, b))
    beside = (_triple(_cross(a, b), a, p) >= 0) & (_triple(b, _cross(a, b), p) >= 0)
    to_end = lambda q: F.atan2(_norm(_cross(p, q)), _dot(p, q))
    return F.when(
        (normal_size > 0) & beside, F.asin(F.least(F.lit(1.0), F.try_divide(F.abs(_triple(a, b, p)), normal_size)))
    ).otherwise(F.least(to_end(a), to_end(b)))


def circle_in_polygon(c, vertices) -> Column:
    c = col(c)
    both = F.struct(sphere.unit_vector(c["ra"], c["dec"]).alias("p"), polygon_vectors(vertices).alias("v"),
                    F.radians(c["radius"]).alias("r"))
    return _bind(both, lambda s: _vector_in_polygon(s["p"], s["v"]) & F.forall(
        _zip_edges(s["v"]), lambda e: _edge_distance(s["p"], e) >= s["r"] - _EDGE))


def _edges_cross(e: Column, f: Column) -> Column:
    """Whether two segments cross between their ends."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    acb, bda = -_triple(a, b, c), _triple(a, b, d)
    cbd, dac = -_triple(c, d, b), _triple(c, d, a)
    return (acb * bda > 0) & (acb * cbd > 0) & (acb * dac > 0)


def _any_crossing(v: Column, w: Column) -> Column:
    return F.exists(_zip_edges(v), lambda e: F.exists(_zip_edges(w), lambda f: _edges_cross(e, f)))


def polygon_in_polygon(inner, outer) -> Column:
    """All vertices inside and no edges crossing."""
    both = F.struct(polygon_vectors(inner).alias("v"), polygon_vectors(outer).alias("w"))
    return _bind(both, lambda s: F.forall(s["v"], lambda p: _vector_in_polygon(p, s["w"]))
                 & ~_any_crossing(s["v"], s["w"]))


def circles_intersect(c, d) -> Column:
    c, d = col(c), col(d)
    return sphere.distance(c["ra"], c["dec"], d["ra"], d["dec"]) <= c["radius"] + d["radius"]


def circle_intersects_polygon(c, vertices) -> Column:
    c = col(c)
    both = F.struct(sphere.unit_vector(c["ra"], c["dec"]).alias("p"), polygon_vectors(vertices).alias("v"),
                    F.radians(c["radius"]).alias("r"))
    return _bind(both, lambda s: _vector_in_polygon(s["p"], s["v"]) | F.exists(
        _zip_edges(s["v"]), lambda e: _edge_distance(s["p"], e) <= s["r"] + _EDGE))


def polygons_intersect(a, b) -> Column:
    both = F.struct(polygon_vectors(a).alias("v"), polygon_vectors(b).alias("w"))
    return _bind(both, lambda s: _vector_in_polygon(F.element_at(s["v"], 1), s["w"])
                 | _vector_in_polygon(F.element_at(s["w"], 1), s["v"]) | _any_crossing(s["v"], s["w"]))


_CONTAINS = {
    ("point", "circle"): point_in_circle, ("point", "polygon"): point_in_polygon, ("point", "box"): point_in_box,
    ("circle", "circle"): circle_in_circle, ("circle", "polygon"): circle_in_polygon,
    ("polygon", "circle"): polygon_in_circle, ("polygon", "polygon"): polygon_in_polygon,
}
_INTERSECTS = {
    ("circle", "circle"): circles_intersect, ("circle", "polygon"): circle_intersects_polygon,
    ("polygon", "polygon"): polygons_intersect,
}


def contains(inner, inner_kind: str, outer, outer_kind: str) -> Column:
    """Boolean column: the first shape lies in the second."""
    try:
        return _CONTAINS[inner_kind, outer_kind](inner, outer)
    except KeyError:
        raise ValueError(f"no containment test of a {inner_kind} in a {outer_kind}") from None


def intersects(a, a_kind: str, b, b_kind: str) -> Column:
    """Boolean column: the shapes share a point; with a point this is containment."""
    if a_kind == "point":
        return contains(a, a_kind, b, b_kind)
    if b_kind == "point":
        return contains(b, b_kind, a, a_kind)
    if (a_kind, b_kind) in _INTERSECTS:
        return _INTERSECTS[a_kind, b_kind](a, b)
    if (b_kind, a_kind) in _INTERSECTS:
        return _INTERSECTS[b_kind, a_kind](b, a)
    raise ValueError(f"no intersection test of a {a_kind} and a {b_kind}")


def as_int(predicate: Column) -> Column:
    """The 0/1 form of a predicate, for select lists."""
    return predicate.cast("int")


# --- constant shapes: everything worked out on the driver ------------------

def _cartesian(ra: float, dec: float) -> tuple[float, float, float]:
    ra, dec = math.radians(ra), math.radians(dec)
    return math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)


def _vcross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _vdot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def dec_range(vertices) -> tuple[float, float]:
    """Declination range of a constant polygon with its edges' bulges and a pole inside."""
    vectors = [_cartesian(*v) for v in vertices]
    low, high = min(v[1] for v in vertices), max(v[1] for v in vertices)
    for i, a in enumerate(vectors):
        b = vectors[(i + 1) % len(vectors)]
        n = _vcross(a, b)
        size = math.sqrt(_vdot(n, n))
        if size < 1e-15:
            continue
        n = tuple(c / size for c in n)
        flat = math.hypot(n[0], n[1])
        if flat < 1e-15:
            continue
        for sign in (1, -1):
            top = tuple(sign * c for c in (-n[0] * n[2] / flat, -n[1] * n[2] / flat, flat))
            if _vdot(_vcross(n, a), top) >= 0 and _vdot(_vcross(b, n), top) >= 0:
                lat = math.degrees(math.asin(max(-1.0, min(1.0, top[2]))))
                low, high = min(low, lat), max(high, lat)
    for pole, lat in (((0, 0, 1), 90.0), ((0, 0, -1), -90.0)):
        if _constant_winding(pole, vectors):
            low, high = min(low, lat), max(high, lat)
    return low, high


def _constant_winding(p, vectors) -> bool:
    total = 0.0
    for i, a in enumerate(vectors):
        b = vectors[(i + 1) % len(vectors)]
        total += math.atan2(_vdot(_vcross(a, b), p), _vdot(a, b) - _vdot(a, p) * _vdot(b, p))
    return abs(total) > math.pi and any(_vdot(v, p) > 0 for v in vectors)


def _is_convex(vectors) -> int:
    """1 or -1 for convex polygons by their sense, 0 otherwise."""
    signs = set()
    for i, a in enumerate(vectors):
        n = _vcross(a, vectors[(i + 1) % len(vectors)])
        for j, v in enumerate(vectors):
            if j not in (i, (i + 1) % len(vectors)):
                turn = _vdot(n, v)
                if abs(turn) > 1e-14:
                    signs.add(1 if turn > 0 else -1)
    return signs.pop() if len(signs) == 1 else 0


def in_constant_polygon(ra, dec, vertices) -> Column:
    """Point test against a polygon known on the driver.

    A declination range comes first, for Parquet pruning; convex polygons
    then need one dot product per edge.
    """
    vectors = [_cartesian(*v) for v in vertices]
    low, high = dec_range(vertices)
    band = num(dec).between(low - sphere.BAND_SLACK, high + sphere.BAND_SLACK)
    sense = _is_convex(vectors)
    if not sense:
        literal = F.array(*(point(*v) for v in vertices))
        return band & point_in_polygon(point(ra, dec), literal)
    r, d = F.radians(num(ra)), F.radians(num(dec))
    xyz = (F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d))
    test = band
    for i, a in enumerate(vectors):
        n = _vcross(a, vectors[(i + 1) % len(vectors)])
        test = test & (sum((n[k] * sense * xyz[k] for k in (1, 2)), n[0] * sense * xyz[0]) >= -_EDGE)
    return test


def in_constant_box(ra, dec, ra_min: float, dec_min: float, ra_max: float, dec_max: float) -> Column:
    """Point test against an ra/dec box known on the driver, over the 0/360 line or not."""
    test = num(dec).between(dec_min, dec_max)
    if ra_max - ra_min >= 360:
        return test
    low, width = ra_min % 360, ra_max - ra_min
    ra = sphere.fold_ra(ra)
    if low + width <= 360:
        return test & ra.between(low, low + width)
    return test & ((ra >= low) | (ra <= low + width - 360))


def _dec_at_edges(v: Column) -> Column:
    """Declination extremes (degrees) on each edge of a polygon, bulges included."""
    def extremes(e):
        a, b = e["a"], e["b"]
        n = _cross(a, b)

        def within_edge(n_):
            size = _norm(n_)
            flat = F.sqrt(n_["x"] * n_["x"] + n_["y"] * n_["y"])
            top = F.struct(F.try_divide(-n_["x"] * n_["z"], flat * size).alias("x"),
                           F.try_divide(-n_["y"] * n_["z"], flat * size).alias("y"), F.try_divide(flat, size).alias("z"))
            between = lambda t: (_triple(n_, a, t) >= 0) & (_triple(b, n_, t) >= 0)
            low_point = F.struct((-top["x"]).alias("x"), (-top["y"]).alias("y"), (-top["z"]).alias("z"))
            usable = (size > 1e-15) & (flat > 1e-15)
            high = F.when(usable & between(top), top["z"]).otherwise(F.greatest(a["z"], b["z"]))
            low = F.when(usable & between(low_point), low_point["z"]).otherwise(F.least(a["z"], b["z"]))
            to_deg = lambda z: F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))
            return F.struct(to_deg(low).alias("low"), to_deg(high).alias("high"))

        return _bind(n, within_edge)

    return F.transform(_zip_edges(v), extremes)


def polygon_in_constant_box(vertices, limits) -> Column:
    """Whether a polygon column lies in a constant ra/dec box."""
    ra_min, dec_min, ra_max, dec_max = limits
    corners = F.forall(col(vertices), lambda v: in_constant_box(v["ra"], v["dec"], *limits))

    def bulges(v):
        return F.forall(_dec_at_edges(v), lambda x: (x["low"] >= dec_min - _EDGE) & (x["high"] <= dec_max + _EDGE))

    if dec_max >= 90 or dec_min <= -90:
        return corners & _bind(polygon_vectors(vertices), bulges)
    poles = F.array(_literal_vector((0, 0, 1)), _literal_vector((0, 0, -1)))
    return corners & _bind(polygon_vectors(vertices), lambda v: bulges(v) & ~F.exists(
        poles, lambda p: _vector_in_polygon(p, v)))


def _edge_basis(e: Column) -> Column:
    """Start a of a segment, its direction w there (NULL where both ends are the same), and its length."""
    a, b = e["a"], e["b"]

    def basis(n):
        size = _norm(n)
        w = _cross(n, a)
        return F.struct(
            a["x"].alias("ax"), a["y"].alias("ay"), a["z"].alias("az"), F.try_divide(w["x"], size).alias("wx"),
            F.try_divide(w["y"], size).alias("wy"), F.try_divide(w["z"], size).alias("wz"), F.atan2(size, _dot(a, b)).alias("length"))

    return _bind(_cross(a, b), basis)


def _parallel_turns(g: Column, z0: Column) -> Column:
    """Where the great circle of a segment has the height z0: phase -+ swing along the circle."""
    radius = F.sqrt(g["az"] * g["az"] + g["wz"] * g["wz"])
    return F.struct(
        *(g[c].alias(c) for c in ("ax", "ay", "wx", "wy", "length")),
        F.atan2(g["wz"], g["az"]).alias("phase"), F.acos(F.try_divide(z0, radius)).alias("swing"),
        F.coalesce((g["length"] > 1e-15) & (radius > F.abs(z0)), F.lit(False)).alias("reaches"))


def _literal_vector(p) -> Column:
    return F.struct(*(F.lit(float(c)).alias(n) for c, n in zip(p, "xyz")))


def _meridian_sides(limits) -> Column | None:
    """The great-circle sides of a constant box, halved so that none reaches 180 degrees."""
    ra_min, dec_min, ra_max, dec_max = limits
    if ra_max - ra_min >= 360:
        return None
    middle = (dec_min + dec_max) / 2
    return F.array(*(
        F.struct(_literal_vector(_cartesian(ra, lo)).alias("a"), _literal_vector(_cartesian(ra, hi)).alias("b"))
        for ra in (ra_min, ra_max) for lo, hi in ((dec_min, middle), (middle, dec_max))))


def _box_boundary_crossed(v: Column, limits) -> Column:
    """Whether an edge of a polygon crosses a side of a constant box."""
    ra_min, dec_min, ra_max, dec_max = limits
    closed = ra_max - ra_min >= 360
    tests = []
    sides = _meridian_sides(limits)
    if sides is not None:
        tests.append(lambda e: F.exists(sides, lambda side: _edges_cross(e, side)))
    heights = [math.sin(math.radians(d)) for d in (dec_min, dec_max) if abs(d) < 90]

    def crosses_parallel(e):
        # p(t) = a cos t + w sin t on the edge; solve its z for the parallel
        def meets(s):
            def hit(turn):
                x = s["ax"] * F.cos(turn) + s["wx"] * F.sin(turn)
                y = s["ay"] * F.cos(turn) + s["wy"] * F.sin(turn)
                inside = F.lit(True) if closed else in_constant_box(
                    F.degrees(F.atan2(y, x)), F.lit(0.0), ra_min, -1, ra_max, 1)
                return (turn <= s["length"]) & inside

            turns = F.transform(F.array(F.lit(1.0), F.lit(-1.0)), lambda sign: F.pmod(
                s["phase"] + sign * s["swing"], F.lit(2 * math.pi)))
            return s["reaches"] & F.exists(turns, hit)

        return _bind(_edge_basis(e), lambda g: F.exists(
            F.transform(F.array(*map(F.lit, heights)), lambda z0: _parallel_turns(g, z0)), meets))

    if heights:
        tests.append(crosses_parallel)
    if not tests:
        return F.lit(False)
    return F.exists(_zip_edges(v), lambda e: tests[0](e) | tests[1](e) if len(tests) == 2 else tests[0](e))


def polygon_intersects_constant_box(vertices, limits) -> Column:
    """Whether a polygon column and a constant ra/dec box share a point."""
    ra_min, dec_min, ra_max, dec_max = limits
    inside = F.exists(col(vertices), lambda v: in_constant_box(v["ra"], v["dec"], *limits))
    corner = _literal_vector(_cartesian(ra_min, dec_min))
    return inside | _bind(polygon_vectors(vertices), lambda v: _vector_in_polygon(corner, v)
                          | _box_boundary_crossed(v, limits))


def polygon_covers_constant_box(vertices, limits) -> Column:
    """Whether a constant ra/dec box lies in a polygon column."""
    ra_min, dec_min, ra_max, dec_max = limits
    if ra_max - ra_min >= 360:
        corners = [(ra, dec) for ra in (0, 120, 240) for dec in (dec_min, dec_max)]
    else:
        corners = [(ra_min, dec_min), (ra_min, dec_max), (ra_max, dec_max), (ra_max, dec_min)]
    literal = F.array(*(_literal_vector(_cartesian(*corner)) for corner in corners))
    return _bind(polygon_vectors(vertices), lambda v: F.forall(literal, lambda c: _vector_in_polygon(c, v))
                 & ~_box_boundary_crossed(v, limits))


# --- regions written as text ------------------------------------------------

@dataclass(frozen=True)
class Shape:
    """A constant shape: kind, numbers in degrees, frame."""

    kind: str
    numbers: tuple[float, ...]
    frame: str = "UNKNOWN"

    @property
    def vertices(self) -> list[tuple[float, float]]:
        n = self.numbers
        if self.kind == "polygon":
            return [(n[i], n[i + 1]) for i in range(0, len(n), 2)]
        if self.kind == "box":
            ra, dec, dx, dy = n[0], n[1], n[2] / 2, n[3] / 2
            return [(ra - dx, dec - dy), (ra - dx, dec + dy), (ra + dx, dec + dy), (ra + dx, dec - dy)]
        raise ValueError(f"a {self.kind} has no vertices")

    def column(self) -> Column:
        """The shape as a literal column."""
        if self.kind == "position":
            return point(*self.numbers)
        if self.kind == "circle":
            return circle(*self.numbers)
        return F.array(*(point(*v) for v in self.vertices))

    def contains_point(self, ra, dec, frame: str = "UNKNOWN") -> Column:
        """Test for positions given in ``frame``; positions are turned when the frames differ."""
        matrix = frames.dialect_rotation(frame, self.frame)
        if matrix is not None:
            ra, dec = _rotated_position(ra, dec, matrix)
        if self.kind == "position":
            return sphere.within(ra, dec, *self.numbers, 0.0)
        if self.kind == "circle":
            return sphere.in_cone(ra, dec, *self.numbers)
        return in_constant_polygon(ra, dec, self.vertices)


def _rotated_position(ra, dec, matrix) -> tuple[Column, Column]:
    r, d = F.radians(num(ra)), F.radians(num(dec))
    xyz = (F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d))
    out = [float(m[0]) * xyz[0] + float(m[1]) * xyz[1] + float(m[2]) * xyz[2] for m in matrix]
    return sphere.vector_ra(out[0], out[1]), sphere.vector_dec(*out)


@dataclass(frozen=True)
class Combination:
    """UNION, INTERSECTION, DIFFERENCE (the first without the others) or NOT of regions; ``regionalgebra`` has their rings and areas."""

    operator: str
    parts: tuple

    def contains_point(self, ra, dec, frame: str = "UNKNOWN") -> Column:
        tests = [p.contains_point(ra, dec, frame) for p in self.parts]
        if self.operator == "NOT":
            return ~tests[0]
        result = tests[0]
        for test in tests[1:]:
            result = (result | test) if self.operator == "UNION" else (result & (~test if self.operator == "DIFFERENCE" else test))
        return result
