import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import regionalgebra as ra
from skylattice.functions import regions, stctext

SQUARE_DEGREES = (180 / math.pi) ** 2


def grid(n=60_000):
    """Points spread evenly over the sphere."""
    k = np.arange(n) + 0.5
    z = 1 - 2 * k / n
    phi = k * math.pi * (3 - math.sqrt(5))
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(phi), r * np.sin(phi), z], axis=-1)


def crossings(rings, p, reference, held):
    """Membership by counting the borders between a point and one that is known: another way than the expression's."""
    inside = np.full(len(p), held)
    for ring in rings:
        for a, b in zip(ring, np.roll(ring, -1, axis=0)):
            n1, n2 = np.cross(a, b), np.cross(p, reference)
            apart = (p @ n1) * (reference @ n1) < 0
            between = (n2 @ a) * (n2 @ b) < 0
            same_half = np.sum((p + reference) * (a + b), axis=1) > 0
            inside ^= apart & between & same_half
    return inside


CASES = [
    "UNION (CIRCLE 10 20 5 CIRCLE 14 20 5)",
    "INTERSECTION (CIRCLE 10 20 5 CIRCLE 14 20 5)",
    "DIFFERENCE (CIRCLE 10 20 5 CIRCLE 14 20 5)",
    "DIFFERENCE (BOX 10 0 10 10 BOX 10 0 4 4)",
    "DIFFERENCE (CIRCLE 100 -40 9 CIRCLE 97 -40 2 CIRCLE 103 -40 2 BOX 100 -31 4 4)",
    "UNION (BOX 10 0 10 10 BOX 40 0 10 10)",
    "UNION (BOX 10 0 10 10 BOX 20 0 10 10)",
    "UNION (CIRCLE 10 0 5 CIRCLE 10 0 5)",
    "UNION (CIRCLE 359 88 5 POLYGON 0 80 90 85 180 80 270 85)",
    "INTERSECTION (POLYGON 10 10 30 10 20 20 30 30 10 30 BOX 24 20 10 4)",
    "UNION (INTERSECTION (BOX 0 0 20 20 CIRCLE 0 0 9) DIFFERENCE (BOX 15 0 20 8 CIRCLE 15 0 2))",
    "INTERSECTION (CIRCLE 10 20 30 NOT (CIRCLE 10 20 8) NOT (BOX 20 20 30 2))",
    "NOT (UNION (CIRCLE 10 20 20 CIRCLE 200 -60 25))",
    "UNION (BOX 10 0 10 10 POLYGON 15 -5 25 -5 25 0 15 0 POLYGON 15 0 25 0 25 5 15 5)",
]


@pytest.mark.parametrize("text", CASES)
def test_area_and_membership_against_a_point_grid(text):
    region, points = ra.composed(text), grid()
    held = region.holds(points)
    rings = region.rings()
    share = held.mean()
    assert abs(region.area() / SQUARE_DEGREES / (4 * math.pi) - share) < 2e-4 + 0.004 * share
    rng = np.random.default_rng(1)
    some = np.concatenate([rng.permutation(len(points))[:3000], np.flatnonzero(held)[:: max(1, int(held.sum()) // 1000)]])
    for k, reference in enumerate(points[rng.permutation(len(points))[:40]]):
        near = some[(points[some] @ reference) > -0.9]
        assert (crossings(rings, points[near], reference, region.holds(reference[None])[0]) == held[near]).mean() > 0.999
        if k > 2:
            break


def test_numbers_of_rings():
    counts = {text: len(ra.composed(text).rings()) for text in CASES}
    assert [counts[t] for t in CASES] == [1, 1, 1, 2, 3, 2, 1, 1, 1, 1, 2, 2, 2, 1]
    whole = ra.composed("UNION (CIRCLE 0 0 40 NOT (CIRCLE 0 0 40))")
    assert whole.rings() == [] and abs(whole.area() - 4 * math.pi * SQUARE_DEGREES) < 1e-6
    assert ra.composed("INTERSECTION (CIRCLE 0 0 4 CIRCLE 90 0 4)").area() == 0
    # sides that two boxes share go, and so do the corners on them
    ring = ra.composed("UNION (BOX 10 0 10 10 POLYGON 15 -5 25 -5 25 5 15 5)").rings()[0]
    assert len(ring) == 6 or len(ring) == 4


def test_frames_and_refusals():
    same = ra.composed("UNION (CIRCLE GALACTIC 120 10 3 CIRCLE GALACTIC 121 10 3)", "ICRS")
    plain = ra.composed("UNION (CIRCLE 120 10 3 CIRCLE 121 10 3)")
    assert abs(same.area() - plain.area()) < 1e-9 and abs(same.rings()[0][0] @ plain.rings()[0][0]) < 0.999
    assert ra.composed("  ") is None
    with pytest.raises(stctext.RegionError):
        ra.composed("UNION (POSITION 1 2 CIRCLE 1 2 3)")
    with pytest.raises(stctext.RegionError):
        ra.composed("UNION (CIRCLE 1 2 120 CIRCLE 1 2 3)")


def test_columns(spark):
    texts = ["CIRCLE 10 20 1", "POLYGON 1 1 3 1 3 3 1 3", *CASES[:6], "no region", None, "", "POSITION 1 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", F.size(ra.region_rings("t")).alias("n"), ra.region_area("t").alias("area"), ra.region_polygon("t").alias("p")).collect()
    assert [r["n"] for r in rows] == [1, 1, 1, 1, 1, 2, 3, 2, None, None, None, None]
    assert [r["p"] is not None for r in rows] == [True, True, True, True, True, False, False, False, False, False, False, False]
    areas = df.select(regions.area_polygon(ra.region_polygon("t")).alias("a")).collect()
    for row, a in zip(rows, areas):
        if a["a"] is not None:
            assert abs(a["a"] - row["area"]) < 1e-6
    assert regions.Combination("DIFFERENCE", (stctext.parse_region("CIRCLE 0 0 3"), stctext.parse_region("CIRCLE 0 0 1"))).operator == "DIFFERENCE"
    points = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (5.0, 0.0)], "ra double, dec double")
    test = stctext.parse_region("DIFFERENCE (CIRCLE 0 0 3 CIRCLE 0 0 1)").contains_point("ra", "dec")
    assert [r[0] for r in points.select(test).collect()] == [False, True, False]
