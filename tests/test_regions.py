"""Shapes, bounding boxes, image searches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.functions import footprint as fp
from skylattice.functions import regions as rg
from skylattice.functions import stctext
from skylattice.plans import images as im

def _point_at(ra1, dec1, ra2, dec2, share):
    """A point of the great circle between two points, by spherical interpolation."""
    def vec(a, d):
        a, d = math.radians(a), math.radians(d)
        return (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d))

    u, v = vec(ra1, dec1), vec(ra2, dec2)
    angle = math.acos(max(-1, min(1, sum(x * y for x, y in zip(u, v)))))
    p = u if angle < 1e-12 else tuple((math.sin((1 - share) * angle) * x + math.sin(share * angle) * y) / math.sin(angle) for x, y in zip(u, v))
    return math.degrees(math.atan2(p[1], p[0])) % 360, math.degrees(math.atan2(p[2], math.hypot(p[0], p[1])))


def _holds(boxes, ra, dec, slack=1e-7):
    return any(b["dec_min"] - slack <= dec <= b["dec_max"] + slack and (
        b["ra_min"] - slack <= ra <= b["ra_max"] + slack or b["ra_min"] - slack <= ra - 360 or ra + 360 <= b["ra_max"] + slack) for b in boxes)


def _width(boxes):
    return sum(b["ra_max"] - b["ra_min"] for b in boxes)


SEGMENTS = [(200, 10, 250, 20), (250, 20, 200, 10), (5, 10, 350, 20), (350, -10, 5, -20), (0, 5, 90, 5), (359, 0, 1, 0), (30, 60, 120, 55),
            (30, -60, 120, -55), (170, 80, 200, -3), (10, 0, 10, 40), (77, 3, 78, 2.5), (179, 1, 181, -1), (300, 45, 60, 45)]


@pytest.mark.parametrize("segment", SEGMENTS)
def test_segments_lie_in_their_boxes(value, segment):
    boxes = value(fp.segment_boxes(*segment))
    points = [_point_at(*segment, k / 200) for k in range(201)]
    assert all(_holds(boxes, *p) for p in points)
    shorter = abs((segment[2] - segment[0] + 180) % 360 - 180)
    assert _width(boxes) == pytest.approx(shorter)  # the short way round, and no wider
    assert min(b["dec_min"] for b in boxes) == pytest.approx(min(p[1] for p in points), abs=1e-2)
    assert max(b["dec_max"] for b in boxes) == pytest.approx(max(p[1] for p in points), abs=1e-2)


def test_segments_over_poles(value):
    assert [tuple(b) for b in value(fp.segment_boxes(20, 80, 200, 85))][0][0::2] == (0.0, 360.0)
    assert value(fp.segment_boxes(20, 80, 20, 80)) == []


@pytest.mark.parametrize("ra,dec,radius", [(225, 0, 10), (3, 80, 5), (359.5, -30, 2), (100, 88, 3), (0, 0, 1), (12, -90, 4)])
def test_circles_lie_in_their_boxes(value, ra, dec, radius):
    boxes = value(fp.circle_boxes(ra, dec, radius))
    edge = value(rg.circle_to_polygon(F.struct(F.lit(float(ra)).alias("ra"), F.lit(float(dec)).alias("dec"), F.lit(float(radius)).alias("radius")), 400))
    assert all(_holds(boxes, p["ra"], p["dec"]) for p in edge)
    if abs(dec) + radius < 90:
        east = max((p["ra"] - ra + 180) % 360 - 180 for p in edge)
        assert _width(boxes) == pytest.approx(2 * east, rel=1e-3)


@pytest.mark.parametrize("ra,dec,dx,dy", [(225, 0, 10, 10), (2, 40, 15, 5), (355, -60, 10, 8), (10, 85, 20, 6), (90, -88, 5, 4)])
def test_boxes_lie_in_their_boxes(value, ra, dec, dx, dy):
    boxes = value(fp.box_boxes(ra, dec, dx, dy))
    for lat in (min(90, dec + dy), max(-90, dec - dy)):
        for k in range(101):
            assert _holds(boxes, *_point_at(ra - dx, lat, ra + dx, lat, k / 100))
    assert _width(boxes) == pytest.approx(360 if abs(dec) + dy >= 90 else 2 * dx)


def test_polygons_lie_in_their_boxes(value):
    rng = random.Random(5)
    for _ in range(12):
        ra, dec = rng.uniform(0, 360), rng.uniform(-75, 75)
        corners = [(ra + 8 * math.cos(t) / math.cos(math.radians(dec)), dec + 8 * math.sin(t)) for t in sorted(rng.uniform(0, 2 * math.pi) for _ in range(5))]
        numbers = [x for c in corners for x in c]
        boxes = value(fp.polygon_boxes(rg.polygon(*numbers)))
        closed = corners + corners[:1]
        assert all(_holds(boxes, *_point_at(*a, *b, k / 50)) for a, b in zip(closed, closed[1:]) for k in range(51))
        east = [x for x, _ in corners]
        assert _width(boxes) <= max(east) - min(east) + 1e-6
        assert value(fp.polygon_boxes(rg.polygon(*numbers, *corners[0]))) == boxes
    around = value(fp.polygon_boxes(rg.polygon(0, 70, 120, 75, 240, 80)))
    assert [tuple(b) for b in around] == [pytest.approx((0, 70, 360, 90))] or around[0]["dec_max"] == 90.0


def test_interval_boxes(value):
    assert [tuple(b) for b in value(fp.interval_boxes(100, -20, 140, 5))] == [(100, -20, 140, 5)]
    assert [tuple(b) for b in value(fp.interval_boxes(200, 15))] == [(200, 15, 360, 90)]
    assert [tuple(b) for b in value(fp.interval_boxes(-4, 1, 7, 2))] == [(0, 1, 7, 2), (356, 1, 360, 2)]
    assert [tuple(b) for b in value(fp.interval_boxes(350, 1, 7, 2))] == [(0, 1, 7, 2), (350, 1, 360, 2)]
    assert [tuple(b) for b in value(fp.interval_boxes(10, 70, 20, 95))] == [(0, 70, 360, 90)]


def test_combined_boxes(value):
    sky, small = fp.all_sky_boxes(), fp.circle_boxes(80, 0, 20)
    only = [pytest.approx((60, -20, 100, 20))]
    assert [tuple(b) for b in value(fp.intersection_boxes(sky, small))] == only
    assert [tuple(b) for b in value(fp.union_boxes(small, sky))] == [*only, (0, -90, 360, 90)]
    assert [tuple(b) for b in value(fp.difference_boxes(small, sky))] == only


IMAGES = [((0, 0), (10, 10)), ((0, 90), (1, 1)), ((45, -45), (1, 1)), ((0, 45), (2.1, 1.1)), ((1, 45), (4.1, 1.1)),
          ((2, 45), (2.1, 1.1)), ((160, 45), (2.1, 1.1)), ((161, 45), (4.1, 1.1)), ((162, 45), (2.1, 1.1))]
# search centre, size, hits for COVERS, ENCLOSED, CENTER, OVERLAPS
SEARCHES = [("0,0", "1", (1, 0, 1, 1)), ("45,-45.6", "1", (0, 0, 0, 1)), ("1,45", "3,1", (1, 0, 3, 3)),
            ("1,46", "1.1", (0, 0, 0, 3)), ("161,45", "3,1", (1, 0, 3, 3)), ("161,46", "1.1", (0, 0, 0, 3)),
            ("0,90", "360,2", (0, 1, 1, 1))]


@pytest.fixture(scope="module")
def image_table(spark):
    rows = [(i, "RA---TAN", 1000, 1000, 500.0, 500.0, float(p[0]), float(p[1]), s[0] / 1000, 0.0, 0.0, s[1] / 1000)
            for i, (p, s) in enumerate(IMAGES)]
    headers = spark.createDataFrame(rows, "id int, CTYPE1 string, NAXIS1 int, NAXIS2 int, CRPIX1 double, CRPIX2 double, "
                                          "CRVAL1 double, CRVAL2 double, CD1_1 double, CD1_2 double, CD2_1 double, CD2_2 double")
    return im.with_image_metadata(headers).cache()


def test_image_searches(image_table):
    tests, names, wanted = [], [], []
    for pos, size, hits in SEARCHES:
        ra, dec = im.parse_position(pos)
        sizes = [float(s) for s in size.split(",")]
        for mode, expected in zip(im.INTERSECT_MODES, hits):
            test = im.box_search(ra, dec, tuple(sizes * 2 if len(sizes) == 1 else sizes), mode)
            tests.append(F.count_if(test).alias(f"t{len(tests)}"))
            names.append((pos, size, mode))
            wanted.append(expected)
    found = list(image_table.agg(*tests).first())
    assert dict(zip(names, found)) == dict(zip(names, wanted))


def test_image_metadata(image_table):
    row = image_table.filter("id = 4").first()
    assert row["centerAlpha"] == pytest.approx(1.0, abs=0.01)
    assert row["pixelScale"] == pytest.approx([0.0041, 0.0011])
    assert len(row["coverage"]) == 4


def test_pixels_and_sky(image_table):
    both = image_table.withColumn("sky", im.pixel_to_sky(123.0, 877.5))
    back = both.select(im.sky_to_pixel(F.col("sky.ra"), F.col("sky.dec")).alias("p")).collect()
    for row in back:
        assert tuple(row["p"]) == pytest.approx((123.0, 877.5), abs=1e-6)


def test_positions_with_lost_comma():
    assert im.parse_position("10,12") == (10.0, 12.0)
    assert im.parse_position("10+12") == (10.0, 12.0)
    with pytest.raises(ValueError):
        im.parse_position("nowhere")


def _inside(ra, dec, vertices):
    """Winding number by brute force."""
    def vec(a, d):
        a, d = math.radians(a), math.radians(d)
        return (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d))

    def cross(a, b):
        return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    p, vs = vec(ra, dec), [vec(*v) for v in vertices]
    if not any(dot(p, v) > 0 for v in vs):
        return False
    total = sum(math.atan2(dot(cross(a, b), p), dot(a, b) - dot(a, p) * dot(b, p)) for a, b in zip(vs, vs[1:] + vs[:1]))
    return abs(total) > math.pi


@pytest.mark.parametrize("vertices", [
    [(350.0, -10.0), (20.0, -10.0), (20.0, 25.0), (350.0, 25.0)],
    [(350.0, -10.0), (20.0, -10.0), (5.0, 0.0), (20.0, 25.0), (350.0, 25.0)],
    [(0.0, 70.0), (120.0, 75.0), (240.0, 60.0)],
])
def test_polygons_against_brute_force(spark, vertices):
    rng = random.Random(7)
    points = [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(3000)]
    df = spark.createDataFrame(points, "ra double, dec double")
    literal = F.array(*(rg.point(*v) for v in vertices))
    rows = df.select("ra", "dec", rg.in_constant_polygon("ra", "dec", vertices).alias("a"),
                     rg.point_in_polygon(rg.point("ra", "dec"), literal).alias("b")).collect()
    for row in rows:
        want = _inside(row["ra"], row["dec"], vertices)
        assert (row["a"], row["b"]) == (want, want), row


def test_shape_relations(values):
    c = rg.circle(0, 0, 5)
    square = rg.polygon(350, -10, 10, -10, 10, 10, 350, 10)
    assert values(
        rg.contains(rg.circle(1, 1, 1), "circle", c, "circle"), rg.contains(c, "circle", square, "polygon"),
        rg.contains(rg.circle(0, 0, 10.5), "circle", square, "polygon"), rg.contains(square, "polygon", c, "circle"),
        rg.intersects(rg.polygon(5.1, 0, 7, 0, 7, 2), "polygon", c, "circle"),
        rg.intersects(rg.polygon(4.9, 0, 7, 0, 7, 2), "polygon", c, "circle"),
        rg.polygons_intersect(rg.polygon(0, -1, 0, 1, 20, 1, 20, -1), rg.polygon(9, -5, 11, -5, 11, 5, 9, 5)),
        rg.polygon_in_polygon(rg.polygon(1, 1, 2, 1, 2, 2), square),
        rg.polygons_intersect(rg.polygon(100, 0, 101, 0, 101, 1), square),
    ) == (True, True, False, False, False, True, True, True, False)


def test_region_text(value):
    region = stctext.parse_region("Union ICRS (Circle 10 20 2 Box 50 50 4 4 Not (Polygon 0 0 10 0 10 10))")
    assert region.operator == "UNION" and len(region.parts) == 3
    with pytest.raises(stctext.RegionError):
        stctext.parse_region("Circle ICRS 10 20")
    with pytest.raises(stctext.RegionError):
        stctext.parse_region("Blob ICRS 10 20")
    assert stctext.parse_region("  ") is None
    assert value(stctext.region_polygon(F.lit("no region"))) is None
    with pytest.raises(stctext.RegionError):
        stctext.parse_search_shape("RANGE 10 5 1 2")


def test_boxes_meet_polygons_with_repeated_corners_and_edges_on_the_equator(spark):
    """An edge between equal corners and one along the equator once divided by zero."""
    rows = [(1, [(10.0, 5.0), (10.0, 5.0), (14.0, 5.0), (12.0, 9.0)]), (2, [(10.0, 0.0), (14.0, 0.0), (12.0, 4.0)]),
            (3, [(10.0, 90.0), (20.0, 90.0), (15.0, 2.0)]), (4, [(100.0, 0.0), (104.0, 0.0), (104.0, 0.0), (102.0, 4.0)])]
    df = spark.createDataFrame(rows, "k int, v array<struct<ra: double, dec: double>>")
    hits = lambda box: {r.k for r in df.filter(rg.polygon_intersects_constant_box("v", box)).collect()}
    assert hits((11.0, -2.0, 13.0, 1.0)) == {2}
    assert hits((11.0, 4.5, 13.0, 6.0)) == {1} and hits((14.5, 4.5, 15.5, 6.0)) == {3}
    assert hits((11.0, 0.5, 13.0, 6.0)) == {1, 2}
    inside = df.filter("k <> 3").select("k", rg.polygon_in_constant_box("v", (5.0, -1.0, 20.0, 10.0)).alias("x")).collect()
    assert {r.k for r in inside if r.x} == {1, 2}
