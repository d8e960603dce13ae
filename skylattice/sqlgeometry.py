"""Geometry, proper motion, cells and word search as SQL-bodied functions for ``spark.sql``.

A shape in SQL is a struct of its kind (point, circle, polygon), its numbers in degrees and its frame, so that one function
takes any kind.  Bodies are built from the fragments below; fragments that are used inside lambdas are text, as
functions with SQL bodies cannot be called there.  Shapes in different known frames are turned to ICRS first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import frames, healpix, sphere, text
from .functions.registry import UserFunction, register
from .functions.stemming import stem_sql
from .functions.text import STOP_WORDS

SHAPE = "STRUCT<kind: STRING, n: ARRAY<DOUBLE>, frame: STRING>"
_POSITION = "STRUCT<ra: DOUBLE, dec: DOUBLE>"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _shape(kind: str, numbers: str, frame: str = "frame") -> str:
    return f"named_struct('kind', '{kind}', 'n', {numbers}, 'frame', {frame})"


def _dot(a: str, b: str) -> str:
    return f"({a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z)"


def _triple(a: str, b: str, c: str) -> str:
    return (f"(({a}.y * {b}.z - {a}.z * {b}.y) * {c}.x + ({a}.z * {b}.x - {a}.x * {b}.z) * {c}.y + "
            f"({a}.x * {b}.y - {a}.y * {b}.x) * {c}.z)")


def _cross(a: str, b: str) -> str:
    return (f"named_struct('x', {a}.y * {b}.z - {a}.z * {b}.y, 'y', {a}.z * {b}.x - {a}.x * {b}.z, 'z', {a}.x * {b}.y - {a}.y * {b}.x)")


def _matrix(frame: str, other: str) -> str:
    """The rotation to ICRS of a frame, where the other one is known and different."""
    cases = []
    for name in sorted(frames.DIALECT_FRAMES):
        matrix = frames.dialect_rotation(name, "ICRS")
        if matrix is not None:
            numbers = ", ".join(f"{float(x)!r}D" for row in matrix for x in row)
            cases.append(f"WHEN upper({frame}) = '{name}' THEN array({numbers})")
    alike = ", ".join(f"'{name}'" for name in sorted(frames.COMPATIBLE))
    plain = "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D)"
    return (f"CASE WHEN coalesce(upper({frame}), '') IN ({alike}) OR coalesce(upper({other}), '') IN ({alike}) OR upper({frame}) = upper({other}) "
            f"THEN {plain} {' '.join(cases)} ELSE {plain} END")


def _vectors(numbers: str, matrix: str) -> str:
    """The corners (or the centre) of a shape as unit vectors, turned."""
    plain = (f"named_struct('x', cos(radians({numbers}[2 * i + 1])) * cos(radians({numbers}[2 * i])), "
             f"'y', cos(radians({numbers}[2 * i + 1])) * sin(radians({numbers}[2 * i])), 'z', sin(radians({numbers}[2 * i + 1])))")
    turned = ", ".join(f"'{c}', {matrix}[{3 * k}] * u.x + {matrix}[{3 * k + 1}] * u.y + {matrix}[{3 * k + 2}] * u.z" for k, c in enumerate("xyz"))
    return f"transform(sequence(0, size({numbers}) div 2 - 1), i -> {_bound(plain, 'u', f'named_struct({turned})')})"


def _next(v: str, at: str) -> str:
    return f"{v}[({at} + 1) % size({v})]"


def _angle(a: str, b: str) -> str:
    """Degrees between two vectors, good for small angles."""
    return (f"degrees(2 * asin(least(1D, sqrt(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2) + pow({a}.z - {b}.z, 2)) / 2)))")


def _in_polygon(p: str, v: str) -> str:
    turns = (f"transform({v}, (a, k) -> {_bound(_next(v, 'k'), 'b', f'atan2({_triple("a", "b", p)}, {_dot("a", "b")} - {_dot("a", p)} * {_dot("b", p)})')})")
    held = _bound(turns, "t", "(abs(aggregate(t, 0D, (total, x) -> total + x)) > pi() OR exists(t, x -> abs(x) > pi() - 1e-9))")
    return f"(exists({v}, c -> {_dot('c', p)} > 0) AND (exists({v}, c -> {_dot('c', p)} > 1 - 1e-15) OR {held}))"


def _edge_distance(p: str, a: str, b: str) -> str:
    """Radians from a vector to a great-circle segment."""
    to_end = lambda q: f"atan2(sqrt({_dot('n1', 'n1')}), {_dot(p, q)})"
    ends = "least(" + ", ".join(_bound(_cross(p, q), "n1", to_end(q)) for q in (a, b)) + ")"
    beside = f"{_dot('n', 'n')} > 0 AND {_triple('n', a, p)} >= 0 AND {_triple(b, 'n', p)} >= 0"
    return _bound(_cross(a, b), "n", f"CASE WHEN {beside} THEN asin(least(1D, abs({_dot('n', p)}) / sqrt({_dot('n', 'n')}))) ELSE {ends} END")


def _any_edge(v: str, test: str) -> str:
    """Whether a test of an edge a to b holds for any of a polygon's."""
    return f"exists(transform({v}, (a, k) -> named_struct('a', a, 'b', {_next(v, 'k')})), e -> {test})"


def _edges_cross(a: str, b: str, c: str, d: str) -> str:
    values = ", ".join(f"'{n}', {s}{_triple(*t)}" for n, s, t in (
        ("acb", "-", (a, b, c)), ("bda", "", (a, b, d)), ("cbd", "-", (c, d, b)), ("dac", "", (c, d, a))))
    return _bound(f"named_struct({values})", "h", "(h.acb * h.bda > 0 AND h.acb * h.cbd > 0 AND h.acb * h.dac > 0)")


_CROSSING = _any_edge("s.v", "exists(transform(s.w, (c, j) -> named_struct('c', c, 'd', s.w[(j + 1) % size(s.w)])), g -> "
                      + _edges_cross("e.a", "e.b", "g.c", "g.d") + ")")
_APART = _angle("s.v[0]", "s.w[0]")
_EDGE = "1e-11"


def _both(body: str) -> str:
    """``body`` on s: vectors v and w of the shapes a and b, their numbers and kinds."""
    turned = f"named_struct('a', a, 'b', b, 'ma', {_matrix('a.frame', 'b.frame')}, 'mb', {_matrix('b.frame', 'a.frame')})"
    values = f"named_struct('a', r.a, 'b', r.b, 'v', {_vectors('r.a.n', 'r.ma')}, 'w', {_vectors('r.b.n', 'r.mb')})"
    return _bound(turned, "r", _bound(values, "s", body))


def _by_kinds(cases: dict[tuple[str, str], str], what: str) -> str:
    tests = " ".join(f"WHEN s.a.kind = '{x}' AND s.b.kind = '{y}' THEN {test}" for (x, y), test in cases.items())
    return f"CASE WHEN s.a IS NULL OR s.b IS NULL THEN NULL {tests} ELSE raise_error(concat('no {what} test of a ', s.a.kind, ' and a ', s.b.kind)) END"


_CONTAINS = {
    ("point", "circle"): f"{_APART} <= s.b.n[2]",
    ("point", "polygon"): _in_polygon("s.v[0]", "s.w"),
    ("circle", "circle"): f"{_APART} + s.a.n[2] <= s.b.n[2]",
    ("circle", "polygon"): f"({_in_polygon('s.v[0]', 's.w')} AND NOT {_any_edge('s.w', _edge_distance('s.v[0]', 'e.a', 'e.b') + f' < radians(s.a.n[2]) - {_EDGE}')})",
    ("polygon", "circle"): f"forall(s.v, q -> {_angle('q', 's.w[0]')} <= s.b.n[2])",
    ("polygon", "polygon"): f"(forall(s.v, q -> {_in_polygon('q', 's.w')}) AND NOT {_CROSSING})",
}
_MEETS_POLYGON = f"({_in_polygon('s.v[0]', 's.w')} OR {_any_edge('s.w', _edge_distance('s.v[0]', 'e.a', 'e.b') + f' <= radians(s.a.n[2]) + {_EDGE}')})"
_MET_POLYGON = f"({_in_polygon('s.w[0]', 's.v')} OR {_any_edge('s.v', _edge_distance('s.w[0]', 'e.a', 'e.b') + f' <= radians(s.b.n[2]) + {_EDGE}')})"
_INTERSECTS = {
    ("point", "circle"): f"{_APART} <= s.b.n[2]", ("circle", "point"): f"{_APART} <= s.a.n[2]",
    ("point", "polygon"): _in_polygon("s.v[0]", "s.w"), ("polygon", "point"): _in_polygon("s.w[0]", "s.v"),
    ("circle", "circle"): f"{_APART} <= s.a.n[2] + s.b.n[2]",
    ("circle", "polygon"): _MEETS_POLYGON, ("polygon", "circle"): _MET_POLYGON,
    ("polygon", "polygon"): f"({_in_polygon('s.v[0]', 's.w')} OR {_in_polygon('s.w[0]', 's.v')} OR {_CROSSING})",
}
_AREA = ("CASE s.kind WHEN 'point' THEN 0D WHEN 'circle' THEN 2 * pi() * (1 - cos(radians(s.n[2]))) * pow(180 / pi(), 2) ELSE "
         + _bound(_vectors("s.n", "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D)"), "v", "abs(aggregate(transform(v, (a, k) -> " + _bound(
             _next("v", "k"), "b", f"2 * atan2({_triple('v[0]', 'a', 'b')}, 1 + {_dot('v[0]', 'a')} + {_dot('a', 'b')} + {_dot('b', 'v[0]')})")
             + "), 0D, (total, x) -> total + x)) * pow(180 / pi(), 2)") + " END")

# proper motion along a great circle
_MOTION = _bound("named_struct('t', sqrt(pmra * pmra + pmde * pmde), 'sr', sin(radians(ra)), 'cr', cos(radians(ra)), 'sd', sin(radians(dec)), 'cd', cos(radians(dec)))", "m", _bound(
    "named_struct('arc', radians(m.t * epdist), 'e', try_divide(pmra, m.t), 'n', try_divide(pmde, m.t))", "d", _bound(
        "named_struct('x', m.cd * m.cr * cos(d.arc) - (m.sd * m.cr * d.n + m.sr * d.e) * sin(d.arc), "
        "'y', m.cd * m.sr * cos(d.arc) - (m.sd * m.sr * d.n - m.cr * d.e) * sin(d.arc), 'z', m.sd * cos(d.arc) + m.cd * d.n * sin(d.arc))", "v",
        "CASE WHEN m.t < degrees(1e-20) THEN named_struct('ra', ra, 'dec', dec) ELSE "
        "named_struct('ra', pmod(degrees(atan2(v.y, v.x)), 360D), 'dec', degrees(atan2(v.z, sqrt(v.x * v.x + v.y * v.y)))) END")))

# the nested cell of a position, by the closed form that healpix.healpix_index has
_CELL = _bound("named_struct('s', shiftleft(1L, order), 'z', sin(radians(dec)), 'c', cos(radians(dec)), 't', pmod(ra, 360D) / 90)", "p", _bound(
    "named_struct('eq', abs(p.z) <= 2D / 3, 'q', least(3L, floor(p.t)), 'u', p.s * sqrt(3D / (1 + abs(p.z))) * abs(p.c))", "h", _bound(
        "named_struct('jp', CASE WHEN h.eq THEN floor(p.s * (0.5D + p.t - 0.75D * p.z)) ELSE least(p.s - 1, floor((p.t - h.q) * h.u)) END, "
        "'jm', CASE WHEN h.eq THEN floor(p.s * (0.5D + p.t + 0.75D * p.z)) ELSE least(p.s - 1, floor((1 - p.t + h.q) * h.u)) END)", "j", _bound(
            "named_struct('f', CASE WHEN NOT h.eq THEN CASE WHEN p.z >= 0 THEN h.q ELSE h.q + 8 END "
            "WHEN shiftright(j.jp, order) = shiftright(j.jm, order) THEN shiftright(j.jp, order) | 4L "
            "WHEN shiftright(j.jp, order) < shiftright(j.jm, order) THEN shiftright(j.jp, order) ELSE shiftright(j.jm, order) + 8 END, "
            "'x', CASE WHEN h.eq THEN j.jm & (p.s - 1) WHEN p.z >= 0 THEN p.s - j.jm - 1 ELSE j.jp END, "
            "'y', CASE WHEN h.eq THEN p.s - (j.jp & (p.s - 1)) - 1 WHEN p.z >= 0 THEN p.s - j.jp - 1 ELSE j.jm END)", "g",
            "g.f * p.s * p.s + CAST(conv(bin(g.x), 4, 10) AS BIGINT) + 2 * CAST(conv(bin(g.y), 4, 10) AS BIGINT)"))))

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_STEMS = f"transform(filter(regexp_extract_all(lower(needle), '([a-z0-9_]+)', 1), w -> w NOT IN ({_STOPS})), q -> {stem_sql('q')})"
_HASWORD = _bound(f"named_struct('q', {_STEMS}, 'w', array_distinct(regexp_extract_all(lower(haystack), '([a-z0-9_]+)', 1)))", "s",
                  f"CASE WHEN haystack IS NOT NULL THEN size(s.q) > 0 AND forall(s.q, t -> exists(s.w, c -> startswith(c, left(t, greatest(1, length(t) - 2))) "
                  f"AND {stem_sql('c')} = t)) END")


def _register(name: str, signature: str, returns: str, doc: str, sql: str, column=None, **more) -> None:
    register(UserFunction(name, signature, returns, doc, sql=sql, column=column, **more))


_CORNERS = "array(ra - w / 2, dec - h / 2, ra - w / 2, dec + h / 2, ra + w / 2, dec + h / 2, ra + w / 2, dec - h / 2)"
_register("point", "frame STRING, ra DOUBLE, dec DOUBLE", SHAPE, "A position.", _shape("point", "array(ra, dec)"))
_register("circle", "frame STRING, ra DOUBLE, dec DOUBLE, r DOUBLE", SHAPE, "A circle around a position.", _shape("circle", "array(ra, dec, r)"))
_register("box", "frame STRING, ra DOUBLE, dec DOUBLE, w DOUBLE, h DOUBLE", SHAPE, "The polygon with corners at half the sizes from a centre.", _shape("polygon", _CORNERS))
_register("polygon", "frame STRING, corners ARRAY<DOUBLE>", SHAPE, "A polygon of alternating longitudes and latitudes, three pairs at least.",
          f"CASE WHEN size(corners) >= 6 AND size(corners) % 2 = 0 THEN {_shape('polygon', 'corners')} ELSE raise_error('polygons need at least three coordinate pairs') END")
_register("sky_contains", f"a {SHAPE}, b {SHAPE}", "INT", "1 if the first shape lies in the second, else 0.", f"CAST({_both(_by_kinds(_CONTAINS, 'containment'))} AS INT)", predicate=True)
_register("intersects", f"a {SHAPE}, b {SHAPE}", "INT", "1 if two shapes share a point, else 0.", f"CAST({_both(_by_kinds(_INTERSECTS, 'intersection'))} AS INT)", predicate=True)
_register("distance", f"a {SHAPE}, b {SHAPE}", "DOUBLE", "Degrees between two points.", _both(
    f"CASE WHEN s.a IS NULL OR s.b IS NULL THEN NULL WHEN s.a.kind = 'point' AND s.b.kind = 'point' THEN {_APART} ELSE raise_error('distances are between points') END"), unit="deg")
_register("area", f"s {SHAPE}", "DOUBLE", "Square degrees of a shape.", f"CASE WHEN s IS NOT NULL THEN {_AREA} END", unit="deg**2")
_register("centroid", f"s {SHAPE}", SHAPE, "The centre of a point or circle.",
          f"CASE WHEN s IS NULL THEN NULL WHEN s.kind IN ('point', 'circle') THEN {_shape('point', 'slice(s.n, 1, 2)', 's.frame')} ELSE raise_error(concat('no centroid for a ', s.kind)) END")
for _name, _at, _doc in (("coord1", 0, "First coordinate"), ("coord2", 1, "Second coordinate")):
    _register(_name, f"s {SHAPE}", "DOUBLE", f"{_doc} of a point.", f"CASE WHEN s.kind = 'point' THEN s.n[{_at}] WHEN s IS NOT NULL THEN raise_error('coordinates are those of points') END")
_register("coordsys", f"s {SHAPE}", "STRING", "The frame of a shape.", "s.frame")
_register("apply_pm", "ra DOUBLE, dec DOUBLE, pmra DOUBLE, pmde DOUBLE, epdist DOUBLE", _POSITION, "Position after proper motion (degrees a unit of epdist).",
          _MOTION, sphere.move)
_register("healpix_index", "order INT, ra DOUBLE, dec DOUBLE", "BIGINT", "Nested cell of a position.",
          f"CASE WHEN ra IS NOT NULL AND dec IS NOT NULL THEN {_CELL} END", healpix.healpix_index)
_register("hasword", "haystack STRING, needle STRING", "BOOLEAN", "Whether a text holds all words of a query, by their stems.", _HASWORD, text.has_words, predicate=True)


def as_shape(column, kind: str, frame: str = "ICRS"):
    """A shape column of ``regions`` (point, circle or polygon) as the struct the SQL functions take."""
    c = F.col(column) if isinstance(column, str) else column
    if kind not in ("point", "circle", "polygon"):
        raise ValueError(f"no SQL shape for a {kind}")
    if kind == "polygon":
        numbers = F.flatten(F.transform(c, lambda v: F.array(v["ra"], v["dec"])))
    else:
        numbers = F.array(*(c[n] for n in (("ra", "dec") if kind == "point" else ("ra", "dec", "radius"))))
    return F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), numbers.alias("n"), F.lit(frame).alias("frame")))

