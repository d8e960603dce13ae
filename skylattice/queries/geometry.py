"""Shapes, tests, searches."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions import footprint, regions as rg, sphere, stctext
from ..operators import coverage, crossmatch, rangelist
from ..plans import images as im
from ..schema import with_metadata
from ..session import scratch_path
from .registry import dist_sql, query


@query("g1_constructors", "SELECT p_partkey, ra AS p_ra, ra - 0.5 AS v0_ra, dec + 1.0 AS v1_dec, p_size / 1e1 AS radius FROM {sky_part} s")
def g1_constructors(t):
    made = t.images.select("p_partkey", rg.point("ra", "dec").alias("p"), rg.circle("ra", "dec", "size").alias("c"),
                           rg.box("ra", "dec", 1.0, 2.0).alias("b"))
    return made.select("p_partkey", F.col("p.ra").alias("p_ra"), F.col("b")[0]["ra"].alias("v0_ra"),
                       F.col("b")[1]["dec"].alias("v1_dec"), F.col("c.radius").alias("radius"))


@query("g2_region_text", f"SELECT c_custkey FROM {{sky_a}} s WHERE ({dist_sql('ra', 'dec', '10.0', '20.0')} <= 30 OR "
                         f"{dist_sql('ra', 'dec', '200.0', '-60.0')} <= 25) AND NOT {dist_sql('ra', 'dec', '10.0', '20.0')} <= 8")
def g2_region_text(t):
    region = stctext.make_region("Intersection ICRS (Union (Circle 10 20 30 Circle ICRS 200 -60 25) NOT (Circle 10 20 8))")
    return t.sky_a.filter(region.contains_point("ra", "dec", "ICRS")).select("c_custkey")


@query("g3_distance", f"SELECT c_custkey, round({dist_sql('ra', 'dec', '0.0', '0.0')}, 6) AS d FROM {{sky_a}} s")
def g3_distance(t):
    return t.sky_a.select("c_custkey", F.round(sphere.distance("ra", "dec", 0.0, 0.0), 6).alias("d"))


@query("g4_point_in_circle", f"SELECT p_partkey FROM {{sky_part}} s WHERE {dist_sql('ra', 'dec', '75.0', '5.0')} <= 2.0 * p_size")
def g4_point_in_circle(t):
    test = rg.contains(rg.point("ra", "dec"), "point", rg.circle(75.0, 5.0, F.col("p_size") * 2.0), "circle")
    return t.images.filter(test).select("p_partkey")


def _inside_sql(vertices, ra="ra", dec="dec") -> str:
    """Half-plane tests of a convex polygon with vertices in mathematical order."""
    import math

    vectors = [(math.cos(math.radians(d)) * math.cos(math.radians(a)), math.cos(math.radians(d)) * math.sin(math.radians(a)),
                math.sin(math.radians(d))) for a, d in vertices]
    tests = []
    for i, a in enumerate(vectors):
        b = vectors[(i + 1) % len(vectors)]
        n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        tests.append(f"({n[0]!r}::DOUBLE * cos(radians({dec})) * cos(radians({ra})) + {n[1]!r}::DOUBLE * cos(radians({dec})) * "
                     f"sin(radians({ra})) + {n[2]!r}::DOUBLE * sin(radians({dec})) >= 0)")
    return "(" + " AND ".join(tests) + ")"


def _corner_sql(ra: str, dec: str) -> tuple[str, str, str]:
    return f"cos(radians({dec})) * cos(radians({ra}))", f"cos(radians({dec})) * sin(radians({ra}))", f"sin(radians({dec}))"


def _point_in_box_sql(ra0: float, dec0: float) -> str:
    """Whether a constant point lies inside the four great circles through the corners of an image."""
    corners = [_corner_sql(f"(ra {a} p_size / 2e1)", f"(dec {d} p_size / 2e1)") for a, d in ("--", "-+", "++", "+-")]
    p = _corner_sql(f"{ra0}", f"{dec0}")
    tests = []
    for i, a in enumerate(corners):
        b = corners[(i + 1) % 4]
        turn = " + ".join(f"({a[j]} * {b[k]} - {a[k]} * {b[j]}) * {p[m]}" for j, k, m in ((1, 2, 0), (2, 0, 1), (0, 1, 2)))
        tests.append(f"({turn}) <= 0")
    return "(" + " AND ".join(tests) + f") AND {dist_sql('ra', 'dec', str(ra0), str(dec0))} < 90"


def _circle_meets_box_sql(ra0: float, dec0: float, radius: float) -> str:
    """Whether a constant circle touches the four great circles through the corners of an image."""
    corners = [_corner_sql(f"(ra {a} p_size / 2e1)", f"(dec {d} p_size / 2e1)") for a, d in ("--", "-+", "++", "+-")]
    p = _corner_sql(f"{ra0}", f"{dec0}")
    dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"
    near = []
    for i, a in enumerate(corners):
        b = corners[(i + 1) % 4]
        ab, ap, bp = dot(a, b), dot(a, p), dot(b, p)
        turn = " + ".join(f"({a[j]} * {b[k]} - {a[k]} * {b[j]}) * {p[m]}" for j, k, m in ((1, 2, 0), (2, 0, 1), (0, 1, 2)))
        near.append(f"acos(greatest(-1, least(1, {ap}))) <= radians({radius})")
        near.append(f"({bp} - {ab} * {ap} >= 0 AND {ap} - {ab} * {bp} >= 0 AND "
                    f"asin(least(1, abs({turn}) / sqrt(1 - {ab} * {ab}))) <= radians({radius}))")
    return "(" + " OR ".join(near) + f" OR ({_point_in_box_sql(ra0, dec0)}))"


# corners, edges and edge circles of the images: x, y, z of corners, n normal, w direction at the start, l length
_EDGES = ("s AS (SELECT * FROM {sky_part} q), v AS (SELECT p_partkey, ra, dec, p_size / 2e1 AS h, unnest([0, 1, 2, 3]) AS k FROM s), "
          "c AS (SELECT p_partkey, k, a, d, cos(radians(d)) * cos(radians(a)) AS x, cos(radians(d)) * sin(radians(a)) AS y, sin(radians(d)) AS z FROM ("
          "SELECT *, ra + CASE WHEN k < 2 THEN -h ELSE h END AS a, dec + CASE WHEN k IN (0, 3) THEN -h ELSE h END AS d FROM v) q), "
          "e AS (SELECT p.*, q.x AS bx, q.y AS by_, q.z AS bz FROM c p JOIN c q ON p.p_partkey = q.p_partkey AND q.k = (p.k + 1) % 4), "
          "n AS (SELECT *, y * bz - z * by_ AS nx, z * bx - x * bz AS ny, x * by_ - y * bx AS nz, x * bx + y * by_ + z * bz AS ab FROM e), "
          "f AS (SELECT *, (ny * z - nz * y) / nl AS wx, (nz * x - nx * z) / nl AS wy, (nx * y - ny * x) / nl AS wz, atan2(nl, ab) AS l FROM ("
          "SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS nl FROM n) q)")


def _vector(ra: float, dec: float) -> tuple[float, float, float]:
    import math

    return (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))


def _crosses_sql(p: tuple[float, float], q: tuple[float, float]) -> str:
    """Whether an edge in f crosses that of two constant points: either's ends lie on two sides of the other, on one half of the sky."""
    c, d = _vector(*p), _vector(*q)
    n = (c[1] * d[2] - c[2] * d[1], c[2] * d[0] - c[0] * d[2], c[0] * d[1] - c[1] * d[0])
    of = lambda v, x, y, z: f"({v[0]!r}::DOUBLE * {x} + {v[1]!r}::DOUBLE * {y} + {v[2]!r}::DOUBLE * {z})"
    half = tuple(u + w for u, w in zip(c, d))
    return (f"({of(c, 'nx', 'ny', 'nz')} * {of(d, 'nx', 'ny', 'nz')} < 0 AND {of(n, 'x', 'y', 'z')} * {of(n, 'bx', 'by_', 'bz')} < 0 AND "
            f"{of(half, '(x + bx)', '(y + by_)', '(z + bz)')} > 0)")


def _polygon_hits_sql(inside: str, vertices) -> str:
    """Keys of images that meet a constant polygon; ``inside`` tells whether the position a, d lies in it."""
    crossed = " OR ".join(_crosses_sql(v, vertices[(i + 1) % len(vertices)]) for i, v in enumerate(vertices))
    held = " OR ".join(f"({_point_in_box_sql(*v)})" for v in vertices)
    return f"SELECT p_partkey FROM f WHERE {inside} OR {crossed} UNION SELECT p_partkey FROM s WHERE {held}"


def _box_hits_sql(ra_min: float, ra_max: float, dec_min: float, dec_max: float) -> str:
    """Keys of images that meet a box between meridians and parallels."""
    within = lambda a: f"(({a} - {ra_min}) % 360 + 360) % 360 <= {ra_max - ra_min}"
    tests = [f"({within('a')} AND d BETWEEN {dec_min} AND {dec_max})"]
    tests += [_crosses_sql((ra, dec_min), (ra, dec_max)) for ra in (ra_min, ra_max)]
    for dec in (dec_min, dec_max):
        for sign in "+-":
            turn = f"((atan2(wz, z) {sign} acos(sin(radians({dec})) / sqrt(z * z + wz * wz))) + 4 * pi()) % (2 * pi())"
            at = f"degrees(atan2(y * cos({turn}) + wy * sin({turn}), x * cos({turn}) + wx * sin({turn})))"
            tests.append(f"(CASE WHEN sqrt(z * z + wz * wz) > abs(sin(radians({dec}))) THEN {turn} <= l AND {within(at)} ELSE FALSE END)")
    held = " OR ".join(f"({_point_in_box_sql(a, d)})" for a in (ra_min, ra_max) for d in (dec_min, dec_max))
    return f"SELECT p_partkey FROM f WHERE {' OR '.join(tests)} UNION SELECT p_partkey FROM s WHERE {held}"


_POLYGON = [(340.0, -20.0), (40.0, -25.0), (30.0, 35.0), (350.0, 30.0)]
_NOTCHED = [(340.0, -20.0), (40.0, -25.0), (10.0, 0.0), (30.0, 35.0), (350.0, 30.0)]


@query("g5_point_in_polygon", f"SELECT c_custkey FROM {{sky_a}} s WHERE {_inside_sql(_POLYGON)}")
def g5_point_in_polygon(t):
    return t.sky_a.filter(rg.in_constant_polygon("ra", "dec", _POLYGON)).select("c_custkey")


@query("g5_non_convex", f"SELECT c_custkey FROM {{sky_a}} s WHERE {_inside_sql(_POLYGON)} AND NOT "
                        f"{_inside_sql([(40.0, -25.0), (30.0, 35.0), (10.0, 0.0)])}")
def g5_non_convex(t):
    return t.sky_a.filter(rg.in_constant_polygon("ra", "dec", _NOTCHED)).select("c_custkey")


@query("g5_polygon_column", f"SELECT p_partkey FROM {{sky_part}} s WHERE {_point_in_box_sql(264.5, 0.0)}")
def g5_polygon_column(t):
    return t.images.filter(rg.point_in_polygon(rg.point(264.5, 0.0), "coverage")).select("p_partkey")


@query("g6_shape_in_shape", f"SELECT p_partkey, {dist_sql('ra', 'dec', '100.0', '-30.0')} + p_size / 1e1 <= 40 AS in_circle, "
                            f"{_inside_sql(_POLYGON)} AND FALSE AS never FROM {{sky_part}} s")
def g6_shape_in_shape(t):
    big = rg.circle(100.0, -30.0, 40.0)
    return t.images.select("p_partkey", rg.contains(rg.circle("ra", "dec", "size"), "circle", big, "circle").alias("in_circle"),
                           (rg.contains(rg.point("ra", "dec"), "point", F.col("coverage"), "polygon") & F.lit(False)).alias("never"))


@query("g6_polygon_in_circle", "SELECT p_partkey FROM {sky_part} s WHERE " + " AND ".join(
    dist_sql(f"ra {a} p_size / 2e1", f"dec {b} p_size / 2e1", "100.0", "-30.0") + " <= 20" for a in "+-" for b in "+-"))
def g6_polygon_in_circle(t):
    test = rg.contains(F.col("coverage"), "polygon", rg.circle(100.0, -30.0, 20.0), "circle")
    return t.images.filter(test).select("p_partkey")


@query("g7_circles_intersect", f"SELECT p_partkey FROM {{sky_part}} s WHERE {dist_sql('ra', 'dec', '250.0', '40.0')} <= p_size / 1e1 + 12")
def g7_circles_intersect(t):
    test = rg.intersects(rg.circle("ra", "dec", "size"), "circle", rg.circle(250.0, 40.0, 12.0), "circle")
    return t.images.filter(test).select("p_partkey")


_IN_NOTCHED = f"({_inside_sql(_POLYGON, 'a', 'd')} AND NOT {_inside_sql([(40.0, -25.0), (30.0, 35.0), (10.0, 0.0)], 'a', 'd')})"


def _segment_near_sql(p, q, radius: str) -> str:
    """Whether the circle of an image touches the constant great-circle segment p to q."""
    c, d = _vector(*p), _vector(*q)
    n = (c[1] * d[2] - c[2] * d[1], c[2] * d[0] - c[0] * d[2], c[0] * d[1] - c[1] * d[0])
    size = sum(x * x for x in n) ** 0.5
    cd = sum(x * y for x, y in zip(c, d))
    m = _corner_sql("ra", "dec")
    dot = lambda v: "(" + " + ".join(f"{x!r}::DOUBLE * {y}" for x, y in zip(v, m)) + ")"
    beside = f"{dot(d)} - {cd!r} * {dot(c)} >= 0 AND {dot(c)} - {cd!r} * {dot(d)} >= 0"
    return (f"({dist_sql('ra', 'dec', repr(p[0]), repr(p[1]))} <= {radius} OR ({beside} AND degrees(asin(least(1, abs({dot(n)}) / {size!r}))) <= {radius}))")


_CIRCLE_TOO = " OR ".join([f"({_inside_sql(_POLYGON)} AND NOT {_inside_sql([(40.0, -25.0), (30.0, 35.0), (10.0, 0.0)])})"] + [
    _segment_near_sql(v, _NOTCHED[(i + 1) % 5], "p_size / 1e1") for i, v in enumerate(_NOTCHED)])


@query("g7_polygons_intersect", f"WITH {_EDGES}, hits AS ({_polygon_hits_sql(_IN_NOTCHED, _NOTCHED)}) "
                                f"SELECT p_partkey, ({_CIRCLE_TOO}) AS circle_too FROM s JOIN hits USING (p_partkey)")
def g7_polygons_intersect(t):
    wanted = F.array(*(rg.point(a, d) for a, d in _NOTCHED))
    both = t.images.filter(rg.intersects(F.col("coverage"), "polygon", wanted, "polygon"))
    return both.select("p_partkey", rg.intersects(rg.circle("ra", "dec", "size"), "circle", wanted, "polygon").alias("circle_too"))


@query("g7_circle_meets_polygon", f"SELECT p_partkey FROM {{sky_part}} s WHERE {_circle_meets_box_sql(240.0, 50.0, 9.0)}")
def g7_circle_meets_polygon(t):
    return t.images.filter(rg.intersects(F.col("coverage"), "polygon", rg.circle(240.0, 50.0, 9.0), "circle")).select("p_partkey")


@query("g7_point_swapped", f"SELECT c_custkey FROM {{sky_a}} s WHERE {dist_sql('ra', 'dec', '10.0', '80.0')} <= 15")
def g7_point_swapped(t):
    test = rg.intersects(rg.circle(10.0, 80.0, 15.0), "circle", rg.point("ra", "dec"), "point")
    return t.sky_a.filter(test).select("c_custkey")


@query("g8_as_int", f"SELECT c_custkey, CAST({dist_sql('ra', 'dec', '10.0', '80.0')} <= 15 AS INT) AS inside FROM {{sky_a}} s")
def g8_as_int(t):
    return t.sky_a.select("c_custkey", rg.as_int(rg.contains(
        rg.point("ra", "dec"), "point", rg.circle(10.0, 80.0, 15.0), "circle")).alias("inside"))


@query("g10_coordinates", "SELECT c_custkey, ra AS c1, dec AS c2, 'ICRS' AS sys FROM {sky_a} s")
def g10_coordinates(t):
    rows = with_metadata(t.sky_a.withColumn("pos", rg.point("ra", "dec")), "pos", frame="ICRS")
    return rows.select("c_custkey", rg.coord1("pos").alias("c1"), rg.coord2("pos").alias("c2"),
                       F.lit(rg.coordsys(rows, "pos")).alias("sys"))


@query("g11_centroid", "SELECT p_partkey, ra AS c_ra, dec AS c_dec FROM {sky_part} s")
def g11_centroid(t):
    center = rg.centroid(rg.circle("ra", "dec", "size"), "circle")
    return t.images.select("p_partkey", center.alias("c")).select("p_partkey", F.col("c.ra").alias("c_ra"), F.col("c.dec").alias("c_dec"))


@query("g12_area", "SELECT p_partkey, round(2 * pi() * (1 - cos(radians(p_size / 1e1))) * pow(180 / pi(), 2), 5) AS area FROM {sky_part} s")
def g12_area(t):
    return t.images.select("p_partkey", F.round(rg.area_circle(rg.circle("ra", "dec", "size")), 5).alias("area"))


@query("g12_polygon_area", "SELECT c_custkey, round(90.0 * (180 / pi()) * (180 / pi()) * radians(1.0) * (c_custkey % 80 + 1) / 90.0, 4) AS area "
                           "FROM customer")
def g12_polygon_area(t):
    # a triangle from the pole to two points on the equator has its angle as area
    angle = (F.col("c_custkey") % 80 + 1).cast("double")
    triangle = rg.polygon(0.0, 0.0, angle, 0.0, 0.0, 90.0)
    return t.customer.select("c_custkey", F.round(rg.area_polygon(triangle), 4).alias("area"))


_CONE = dist_sql("ra", "dec", "120.0", "10.0")


@query("g13_cone_search", f"SELECT c_custkey, c_name, ra, dec, round({_CONE}, 6) AS dist FROM {{sky_a}} s WHERE {_CONE} <= 20 "
                          f"ORDER BY {_CONE}, c_custkey")
def g13_cone_search(t):
    found = crossmatch.cone_search(t.sky_a, 120.0, 10.0, 20.0, folded=True, ties=["c_custkey"])
    return found.select("c_custkey", "c_name", "ra", "dec", F.round("dist", 6).alias("dist"))


@query("g13_polar_cone", f"SELECT c_custkey, round({dist_sql('ra', 'dec', '10.0', '85.0')}, 6) AS dist FROM {{sky_a}} s "
                         f"WHERE {dist_sql('ra', 'dec', '10.0', '85.0')} <= 12")
def g13_polar_cone(t):
    found = crossmatch.cone_search(t.sky_a, 10.0, 85.0, 12.0, folded=True, sort=False)
    return found.select("c_custkey", F.round("dist", 6).alias("dist"))


@query("g14_multi_cone", f"SELECT c_custkey FROM {{sky_a}} s WHERE {dist_sql('ra', 'dec', '10.0', '12.0')} < 9 OR "
                         f"{dist_sql('ra', 'dec', '-10.0', '13.0')} < 9 OR {dist_sql('ra', 'dec', '200.0', '-85.0')} < 9")
def g14_multi_cone(t):
    test = rangelist.cone_filter("ra", "dec", "10,12,-10,13,200,-85;ICRS", 9.0)
    return t.sky_a.filter(test).select("c_custkey")


@query("g15_image_center", f"SELECT p_partkey FROM {{sky_part}} s WHERE {_point_in_box_sql(264.5, 0.0)}")
def g15_image_center(t):
    return t.images.filter(im.box_search(264.5, 0.0, (1.0, 1.0), "CENTER")).select("p_partkey")


_SPAN = 7.0 / 0.9396926207859084  # half of 14 degrees at declination -20
_BOX = (100.0 - _SPAN, 100.0 + _SPAN, -24.0, -16.0)
_BULGE = "degrees(atan(tan(radians(dec - p_size / 2e1)) / cos(radians(p_size / 2e1))))"


# images are smaller than the box, so none covers it; edges south of the equator bulge towards the pole
@query("g15_image_modes", f"WITH {_EDGES}, hits AS ({_box_hits_sql(*_BOX)}) SELECT p_partkey, 'OVERLAPS' AS mode FROM hits UNION ALL "
                          f"SELECT p_partkey, 'CENTER' FROM s WHERE {_point_in_box_sql(100.0, -20.0)} UNION ALL "
                          f"SELECT p_partkey, 'ENCLOSED' FROM s WHERE ra - p_size / 2e1 >= {_BOX[0]} AND ra + p_size / 2e1 <= {_BOX[1]} AND "
                          f"{_BULGE} >= -24 AND dec + p_size / 2e1 <= -16")
def g15_image_modes(t):
    images = t.images.withColumn("reach", F.col("size"))
    params = {"POS": "100,-20", "SIZE": "14,8"}
    near = im.search_images(images, {**params, "INTERSECT": "OVERLAPS"}, center=("ra", "dec"), reach="reach")
    tests = (F.when(im.box_search(100.0, -20.0, (14.0, 8.0), mode), F.lit(mode)) for mode in im.INTERSECT_MODES)
    hits = near.select("p_partkey", F.explode(F.array(*tests)).alias("mode"))
    return hits.filter("mode IS NOT NULL")


@query("g15_enclosed", "SELECT p_partkey FROM {sky_part} s WHERE ra - p_size / 2e1 >= 140 AND ra + p_size / 2e1 <= 160 AND abs(dec) < 30 AND "
                       "degrees(atan(tan(radians(abs(dec) + p_size / 2e1)) / cos(radians(p_size / 2e1)))) <= 10")
def g15_enclosed(t):
    return t.images.filter(im.box_search(150.0, 0.0, (20.0, 20.0), "ENCLOSED")).select("p_partkey")


@query("g16_circle_search", f"SELECT p_partkey FROM {{sky_part}} s WHERE {_circle_meets_box_sql(100.0, -20.0, 6.0)}")
def g16_circle_search(t):
    # the corners of an image lie within its size around the centre
    return t.images.filter(im.shape_search("CIRCLE 100 -20 6", center=("ra", "dec"), reach="size")).select("p_partkey")


_TRIANGLE = [(95.0, -25.0), (105.0, -25.0), (100.0, -10.0)]


@query("g16_shape_search", f"WITH {_EDGES}, r AS ({_box_hits_sql(90.0, 110.0, -25.0, -15.0)}), "
                           f"p AS ({_polygon_hits_sql(_inside_sql(_TRIANGLE, 'a', 'd'), _TRIANGLE)}) "
                           f"SELECT p_partkey, 'CIRCLE' AS shape FROM s WHERE {_circle_meets_box_sql(100.0, -20.0, 6.0)} UNION ALL "
                           f"SELECT p_partkey, 'RANGE' FROM r UNION ALL SELECT p_partkey, 'POLYGON' FROM p")
def g16_shape_search(t):
    shapes = ("CIRCLE 100 -20 6", "RANGE 90 110 -25 -15", "POLYGON 95 -25 105 -25 100 -10")
    # the corners of an image lie within its size around the centre
    images = coverage.write_footprints(t.images.select("p_partkey", "ra", "dec", "size", "coverage"), scratch_path(t.spark, "footprints"), reach="size")
    near = reduce(lambda a, b: a | b, map(coverage.near_shape, shapes))
    tests = (F.when(im.shape_search(text), F.lit(text.split()[0])) for text in shapes)
    return images.filter(near).select("p_partkey", F.explode(F.array(*tests)).alias("shape")).filter("shape IS NOT NULL")


# spans as SQL: start, width, lowest and highest declination of each kind of shape, from spherical trigonometry
_HALF = "CASE WHEN abs(dec) + {r} >= 90 THEN 180.0 ELSE degrees(asin(least(1.0, sin(radians({r})) / cos(radians(dec))))) END"
_SIDE = "degrees(atan(tan(radians({lat})) / cos(radians({dx}))))"


def _circle_span_sql(kind: str, r: str) -> str:
    half = _HALF.format(r=r)
    return (f"SELECT p_partkey, '{kind}' AS kind, ra - {half} AS a, 2 * {half} AS w, greatest(dec - {r}, -90) AS lo, "
            f"least(dec + {r}, 90) AS hi FROM s")


def _box_span_sql(kind: str, dx: str) -> str:
    top, bottom = f"(dec + {dx})", f"(dec - {dx})"
    return (f"SELECT p_partkey, '{kind}', ra - {dx}, CASE WHEN {top} >= 90 OR {bottom} <= -90 THEN 360 ELSE 2 * {dx} END, "
            f"CASE WHEN {bottom} <= -90 THEN -90 WHEN {top} >= 90 THEN {'least(' + bottom + ', 180 - ' + top + ')' if kind == 'polygon' else bottom} "
            f"WHEN {bottom} < 0 THEN {_SIDE.format(lat=bottom, dx=dx)} ELSE {bottom} END, "
            f"CASE WHEN {top} >= 90 THEN 90 WHEN {bottom} <= -90 THEN {'greatest(' + top + ', -180 - ' + bottom + ')' if kind == 'polygon' else top} "
            f"WHEN {top} > 0 THEN {_SIDE.format(lat=top, dx=dx)} ELSE {top} END FROM s")


_BOXES_SQL = (
    "WITH s AS (SELECT *, p_size / 1e1 AS size FROM {sky_part} q), spans AS (" + " UNION ALL ".join((
        _circle_span_sql("ellipse", "size"), _box_span_sql("box", "size"), _box_span_sql("polygon", "(size / 2)"),
        "SELECT p_partkey, 'interval', ra - 1, CASE WHEN dec - 1 < -90 THEN 360 ELSE 2 END, greatest(dec - 1, -90), 90 FROM s",
        _circle_span_sql("union", "size"), "SELECT p_partkey, 'union', 0, 360, -90, 90 FROM s",
        _circle_span_sql("intersection", "size"), _circle_span_sql("difference", "1.0"))) + "), "
    "f AS (SELECT p_partkey, kind, (a % 360 + 360) % 360 AS a, w, lo, hi FROM spans), boxes AS ("
    "SELECT p_partkey, kind, CASE WHEN w >= 360 THEN 0 ELSE a END AS ra_min, lo, CASE WHEN w >= 360 OR a + w > 360 THEN 360 ELSE a + w END AS ra_max, "
    "hi FROM f UNION ALL SELECT p_partkey, kind, 0, lo, a + w - 360, hi FROM f WHERE w < 360 AND a + w > 360) ")


@query("g17_circle_boxes", _BOXES_SQL + "SELECT p_partkey, count(*) AS n_boxes, round(min(lo), 7) AS lowest, round(sum(ra_max - ra_min), 7) AS width "
                           "FROM boxes WHERE kind = 'ellipse' GROUP BY 1")
def g17_circle_boxes(t):
    rows = t.images.select("p_partkey", footprint.circle_boxes("ra", "dec", "size").alias("b"))
    width = F.aggregate("b", F.lit(0.0), lambda total, b: total + b["ra_max"] - b["ra_min"])
    return rows.select("p_partkey", F.size("b").cast("bigint").alias("n_boxes"),
                       F.round(F.element_at("b", 1)["dec_min"], 7).alias("lowest"), F.round(width, 7).alias("width"))


@query("g17_footprint_boxes", _BOXES_SQL + "SELECT p_partkey, kind, round(ra_min, 7) AS ra_min, round(lo, 7) AS dec_min, round(ra_max, 7) AS ra_max, "
                              "round(hi, 7) AS dec_max FROM boxes")
def g17_footprint_boxes(t):
    images = t.images
    parts = {"ellipse": footprint.ellipse_boxes("ra", "dec", "size"), "box": footprint.box_boxes("ra", "dec", F.col("size"), F.col("size")),
             "polygon": footprint.polygon_boxes("coverage"),
             "interval": footprint.interval_boxes(F.col("ra") - 1, F.col("dec") - 1, F.col("ra") + 1, None),
             "union": footprint.union_boxes(footprint.circle_boxes("ra", "dec", "size"), footprint.all_sky_boxes()),
             "intersection": footprint.intersection_boxes(footprint.circle_boxes("ra", "dec", "size"), footprint.not_boxes()),
             "difference": footprint.difference_boxes(footprint.circle_boxes("ra", "dec", 1.0), None)}
    kinds = F.explode(F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*parts.values()))).alias("kind", "boxes")
    rows = images.select("p_partkey", kinds).select("p_partkey", "kind", F.explode("boxes").alias("b"))
    return rows.select("p_partkey", "kind", *(F.round(F.col("b")[c], 7).alias(c) for c in ("ra_min", "dec_min", "ra_max", "dec_max")))


@query("g18_planar_box", "SELECT p_partkey, ra - p_size / 2e1 AS x0, dec - p_size / 2e1 AS y0, ra + p_size / 2e1 AS x1, dec + p_size / 2e1 AS y1 "
                         "FROM {sky_part} s")
def g18_planar_box(t):
    points = F.transform("coverage", lambda v: F.struct(v["ra"].alias("x"), v["dec"].alias("y")))
    return t.images.select("p_partkey", footprint.planar_box(points).alias("b")).select("p_partkey", "b.*")


@query("g19_circle_polygon", f"SELECT p_partkey, 32 AS corners, TRUE AS on_circle FROM {{sky_part}} s")
def g19_circle_polygon(t):
    rows = t.images.withColumn("v", rg.circle_to_polygon(F.struct("ra", "dec", F.col("size").alias("radius"))))
    on_circle = F.forall("v", lambda q: F.abs(sphere.distance(q["ra"], q["dec"], F.col("ra"), F.col("dec")) - F.col("size")) < 1e-6)
    return rows.select("p_partkey", F.size("v").alias("corners"), on_circle.alias("on_circle"))


@query("g20_box_polygon", "SELECT p_partkey, ra AS a0, dec AS d0, ra + 1 AS a2, dec + 2 AS d2, 4 AS n FROM {sky_part} s")
def g20_box_polygon(t):
    rows = t.images.select("p_partkey", rg.box_to_polygon(rg.interval_box("ra", "dec", F.col("ra") + 1, F.col("dec") + 2)).alias("v"))
    return rows.select("p_partkey", F.col("v")[0]["ra"].alias("a0"), F.col("v")[0]["dec"].alias("d0"), F.col("v")[2]["ra"].alias("a2"),
                       F.col("v")[2]["dec"].alias("d2"), F.size("v").alias("n"))


@query("g22_region_column", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 32 ELSE 4 END AS corners, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE "
                            "round(ra - p_size / 2e1, 9) END AS first_ra FROM {sky_part} s")
def g22_region_column(t):
    from ..functions import formats

    kind = F.col("p_partkey") % 3
    circle = formats.stc_circle(F.struct("ra", "dec", F.col("size").alias("radius")))
    box = F.concat_ws(" ", F.lit("BOX ICRS"), "ra", "dec", "size", "size")
    text = F.when(kind == 0, circle).when(kind == 1, box).otherwise(formats.stc_polygon("coverage"))
    rows = t.images.select("p_partkey", stctext.region_polygon(text).alias("v"))
    return rows.select("p_partkey", F.size("v").alias("corners"),
                       F.when(kind != 0, F.round(F.col("v")[0]["ra"], 9)).alias("first_ra"))
