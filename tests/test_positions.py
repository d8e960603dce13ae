"""Frames, distances, cells, motion: against published values."""

import math

import pytest
from pyspark.sql import functions as F

from skylattice.functions import frames as fr
from skylattice.functions import healpix, sphere

POSITIONS = [
    (fr.fk5(1980), fr.FK5, (0.0, 0.0), (0.2562312606, 0.1113549748)),
    (fr.fk5(1980), fr.FK5, (359.9, -30.0), (0.1561995638, -29.8886447602)),
    (fr.FK5, fr.fk5(1974), (45.0, 45.0), (44.5651142075, 44.8972488594)),
    (fr.FK5, fr.fk5(2057), (181.0, -30.0), (181.7348299633, -30.3172182119)),
    (fr.fk5(2050), fr.fk5(2025), (0.0, 90.0), (359.8398164025, 89.8608341479)),
    (fr.FK4, fr.fk4(2000), (45.0, 45.0), (45.8392913880, 45.1953686642)),
    (fr.ecliptic(2451545.0), fr.FK5, (0.1, -0.1), (0.1315258849, -0.0519705319)),
    (fr.ecliptic(71520.7 + 2400000.5), fr.FK5, (45.0, 45.0), (18.6932317901, 57.6665500220)),
    (fr.FK5, fr.ecliptic(32110.2 + 2400000.5), (0.0, 0.0), (359.2567838899, -0.0006050987)),
    (fr.GALACTIC, fr.ICRS, (4.0, 40.0), (234.99533124940731, -2.1043398500407746)),
]


@pytest.mark.parametrize("source,target,given,expected", POSITIONS)
def test_frame_positions(spark, source, target, given, expected):
    df = spark.createDataFrame([given], "ra double, dec double")
    row = fr.transform_position(df, source, target).first()
    assert (row["ra_out"], row["dec_out"]) == pytest.approx(expected, abs=1e-7)


SIX = [
    (fr.FK4, fr.FK5, (0.0, 0.0, 0.01, 1e-7, 1e-7, 0.0),
     (0.6410108201, 0.2786355075, 0.01, 0.0000001116, 0.0000000789, 0.0000988271)),
    (fr.FK4, fr.FK5, (50.0, -83.0, 1.0, 1e-7, 1e-7, -300.0),
     (48.9397106370, -82.8187302734, 1.0155801252, 0.0000002647, 0.0000000894, -300.0064069434)),
    (fr.FK5, fr.FK4, (130.0, 45.0, 1.0, 1e-7, 1e-7, 300.0),
     (129.1438927007, 45.1770298575, 1.0155797802, 0.0000001066, 0.0000000896, 299.9935908606)),
]


@pytest.mark.parametrize("source,target,given,expected", SIX)
def test_six_vectors(spark, source, target, given, expected):
    df = spark.createDataFrame([given], ", ".join(f"{n} double" for n in fr.SIX_FIELDS))
    row = fr.transform_six(df, source, target, sla=True).first()
    found = [row[f"out_{n}"] for n in fr.SIX_FIELDS]
    assert found[:3] == pytest.approx(expected[:3], abs=1e-6)
    assert found[3:] == pytest.approx(expected[3:], abs=1e-3)


def test_six_vector_icrs_round_trip(spark):
    given = (120.0, 45.0, 0.5, 1e-7, -2e-7, 30.0)
    df = spark.createDataFrame([given], ", ".join(f"{n} double" for n in fr.SIX_FIELDS))
    there = fr.transform_six(df, fr.FK5, fr.ICRS)
    there = there.select(*(F.col(f"out_{n}").alias(n) for n in fr.SIX_FIELDS))
    back = fr.transform_six(there, fr.ICRS, fr.FK5).first()
    assert [back[f"out_{n}"] for n in fr.SIX_FIELDS] == pytest.approx(given, rel=1e-9)


def test_healpix_index_and_center(spark):
    df = spark.createDataFrame([(230.0, 60.0), (23.5, -12.25)], "ra double, dec double")
    rows = healpix.with_healpix_center(healpix.with_healpix(df, 10), 10).collect()
    assert rows[0]["hpx"] == 2937727
    assert (rows[1]["center"]["ra"], rows[1]["center"]["dec"]) == pytest.approx((23.51074219, -12.25362992), abs=1e-7)


def test_healpix_cells_are_complete(spark):
    cells = spark.range(12 * 4**4).withColumnRenamed("id", "hpx")
    centers = healpix.with_healpix_center(cells, 4)
    back = healpix.with_healpix(centers, 4, F.col("center.ra"), F.col("center.dec"), out="back")
    both = back.withColumn("again", healpix.healpix_index(4, F.col("center.ra"), F.col("center.dec")))
    assert both.filter("hpx != back OR hpx != again").count() == 0


def test_motion_along_great_circle(value):
    moved = value(sphere.move(10.0, 0.0, 1.0, 0.0, 30.0))
    assert (moved["ra"], moved["dec"]) == pytest.approx((40.0, 0.0), abs=1e-12)
    moved = value(sphere.move(10.0, 80.0, 0.0, 1.0, 20.0))
    assert (moved["ra"], moved["dec"]) == pytest.approx((190.0, 80.0), abs=1e-9)
    still = value(sphere.move(10.0, 80.0, 0.0, 0.0, 20.0))
    assert (still["ra"], still["dec"]) == (10.0, 80.0)


def test_small_distances_keep_digits(value):
    assert value(sphere.distance(10.0, 20.0, 10.0, 20.0 + 1e-10)) == pytest.approx(1e-10, rel=1e-3)
    assert value(sphere.distance(0.0, 90.0, 123.0, -90.0)) == pytest.approx(180.0)


def test_headings(values):
    found = values(sphere.heading(0.0, 0.0, 0.0, 10.0), sphere.heading(0.0, 0.0, 0.0, -10.0),
                   sphere.heading(0.0, 0.0, 10.0, 0.0), sphere.heading(0.0, 0.0, 350.0, 0.0),
                   sphere.heading(5.0, -90.0, 10.0, 0.0), sphere.heading(5.0, 90.0, 10.0, 0.0))
    assert found == pytest.approx((0.0, 180.0, 90.0, 270.0, 0.0, 180.0), abs=1e-9)


@pytest.mark.parametrize("lat", [-90.0, -52.5, 0.0, 12.25, 89.999, 90.0])
def test_geodetic_round_trip(spark, lat):
    df = spark.createDataFrame([(8.5, lat, 1234.5)], "lon double, lat double, height double")
    df = df.withColumn("g", sphere.geodetic_to_geocentric("lon", "lat", "height"))
    df = df.select(F.col("g.lon").alias("lon"), F.col("g.lat").alias("phi"), F.col("g.rho").alias("rho"))
    row = sphere.geocentric_to_geodetic(df, "lon", "phi", "rho").first()
    assert row["geod_lat"] == pytest.approx(lat, abs=1e-9)
    assert row["geod_height"] == pytest.approx(1234.5, abs=1e-4)


def test_ra_halfwidth_bounds_cone():
    for dec, radius in ((0.0, 10.0), (60.0, 20.0), (-80.0, 9.0), (85.0, 5.0)):
        half = sphere.ra_halfwidth(dec, radius)
        if half < 180:
            assert math.sin(math.radians(half)) == pytest.approx(
                math.sin(math.radians(radius)) / math.cos(math.radians(dec)))


def test_pixel_slices_of_a_region_are_worked_out_once_and_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from skylattice.plans import pixels

    images = spark.range(40).coalesce(1).selectExpr(
        "id AS k", "array(100, 80) AS pixelSize", "array(50.5D, 40.5D) AS wcs_refPixel", "array(id * 9D, 0D) AS wcs_refValues",
        "array(-0.05D, 0D, 0D, 0.05D) AS wcs_cdmatrix")
    grid = images.select("k", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(1), F.lit(80))))
    cut = pixels.region_cut(grid, images, "k", "CIRCLE 90 0 1")
    found = {r["k"]: (r["n"], r["a"], r["b"]) for r in cut.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("a"), F.max("y").alias("b")).collect()}
    assert list(found) == [10] and found[10] == (42 * 42, 42, 42)
    assert "sin(" not in cut._jdf.queryExecution().optimizedPlan().toString().lower()
