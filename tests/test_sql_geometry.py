import random

import pytest
from pyspark.sql import functions as F

from skylattice import sqlgeometry, sqlpack
from skylattice.functions import healpix, regions, registry, sphere, text
from skylattice.functions.stemming import stem, stem_sql


@pytest.fixture(scope="module")
def pack(spark):
    sqlpack.install(spark)
    return spark


def shapes(spark, n=60):
    """Random shapes around one spot, so that many meet: a point, a circle and polygons a row."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        ra, dec = rng.uniform(-3, 3) % 360, rng.uniform(60, 64)
        corners = [((ra + rng.uniform(0.3, 3) * a) % 360, dec + rng.uniform(0.3, 2) * d) for a, d in ((-1, -1), (1.2, -1), (0.4, 0.1), (1, 1), (-1, 1))]
        rows.append((i, ra, dec, rng.uniform(0.05, 1.5), [{"ra": a, "dec": d} for a, d in corners]))
    df = spark.createDataFrame(rows, "i int, ra double, dec double, r double, poly array<struct<ra:double,dec:double>>")
    return df.select("i", regions.point("ra", "dec").alias("point"), regions.circle("ra", "dec", "r").alias("circle"), F.col("poly").alias("polygon"))


@pytest.mark.parametrize("a", ["point", "circle", "polygon"])
@pytest.mark.parametrize("b", ["point", "circle", "polygon"])
def test_predicates_equal_the_column_form(pack, a, b):
    df = shapes(pack)
    pairs = df.select(F.col("i").alias("i"), F.col(a).alias("a")).crossJoin(df.select(F.col("i").alias("j"), F.col(b).alias("b")))
    pairs = pairs.withColumns({"sa": sqlgeometry.as_shape("a", a), "sb": sqlgeometry.as_shape("b", b)})
    for function, column in (("sky_contains", regions.contains), ("intersects", regions.intersects)):
        try:
            plain = column(F.col("a"), a, F.col("b"), b)
        except ValueError:
            with pytest.raises(Exception, match="test of a"):
                pairs.select(F.expr(f"{function}(sa, sb)")).collect()
            continue
        rows = pairs.select(F.expr(f"{function}(sa, sb)").alias("sql"), plain.cast("int").alias("col")).collect()
        assert all(r["sql"] == r["col"] for r in rows)
        if a != b or a != "point":
            assert 2 <= sum(r["sql"] for r in rows) < len(rows)


def test_constructors_and_measures(pack):
    row = pack.sql("""SELECT area(circle('ICRS', 10D, 20D, 3D)) AS c, area(polygon('ICRS', array(0D, 0D, 90D, 0D, 0D, 90D))) AS octant,
        area(point('', 1D, 2D)) AS none, area(box('ICRS', 10D, 0D, 2D, 2D)) AS b, distance(point('ICRS', 1D, 2D), point('ICRS', 1D, 3D)) AS d,
        coord1(point('ICRS', 7D, 8D)) AS c1, coord2(centroid(circle('FK5', 7D, 8D, 1D))) AS c2, coordsys(centroid(circle('FK5', 7D, 8D, 1D))) AS f,
        sky_contains(point('ICRS', 359.9D, 0D), circle('ICRS', 0.1D, 0D, 0.3D)) AS seam, distance(CAST(NULL AS """ + sqlgeometry.SHAPE + """), point('', 1D, 1D)) AS n""").first()
    value = pack.range(1).select(regions.area_circle(regions.circle(10.0, 20.0, 3.0)), regions.area_polygon(regions.box(10.0, 0.0, 2.0, 2.0))).first()
    assert abs(row["c"] - value[0]) < 1e-9 and abs(row["b"] - value[1]) < 1e-9
    assert abs(row["octant"] - 41252.96124941927 / 8) < 1e-6 and row["none"] == 0 and abs(row["d"] - 1) < 1e-12
    assert (row["c1"], row["c2"], row["f"], row["seam"], row["n"]) == (7.0, 8.0, "FK5", 1, None)
    for bad in ("centroid(polygon('', array(1D, 1D, 2D, 1D, 2D, 2D)))", "polygon('', array(1D, 2D, 3D, 4D))", "coord1(circle('', 1D, 1D, 1D))",
                "distance(circle('', 1D, 1D, 1D), point('', 1D, 1D))"):
        with pytest.raises(Exception):
            pack.sql(f"SELECT {bad} FROM range(1)").collect()


def test_frames_are_brought_together(pack):
    from skylattice.functions import frames

    df = pack.createDataFrame([(120.0, 10.0)], "l double, b double")
    there = frames.transform_position(df, frames.GALACTIC, frames.ICRS, ra="l", dec="b", out_ra="ra", out_dec="dec").first()
    found = pack.sql(f"SELECT distance(point('GALACTIC', 120D, 10D), point('ICRS', {there['ra']!r}D, {there['dec']!r}D)) AS d, "
                     f"sky_contains(point('GALACTIC', 120D, 10D), circle('ICRS', {there['ra']!r}D, {there['dec']!r}D, 0.01D)) AS c, "
                     f"distance(point('GALACTIC', 120D, 10D), point('UNKNOWN', 120D, 10D)) AS plain").first()
    assert found["d"] < 1e-4 and found["c"] == 1 and found["plain"] == 0


def test_motion_cells_and_words(pack):
    rng = random.Random(8)
    rows = [(rng.uniform(0, 360), rng.uniform(-90, 90), rng.uniform(-1, 1) * 1e-3, rng.uniform(-1, 1) * 1e-3, rng.uniform(-500, 500)) for _ in range(300)]
    rows += [(10.0, 20.0, 0.0, 0.0, 5.0), (0.0, 90.0, 1e-3, 0.0, 3.0), (0.0, -90.0, 0.0, 1e-3, 3.0)]
    df = pack.createDataFrame(rows, "ra double, dec double, pr double, pd double, t double")
    both = df.select(F.expr("apply_pm(ra, dec, pr, pd, t)").alias("s"), sphere.move("ra", "dec", "pr", "pd", "t").alias("c"),
                     *(F.expr(f"healpix_index({k}, ra, dec)").alias(f"s{k}") for k in (0, 5, 13)), *(healpix.healpix_index(k, "ra", "dec").alias(f"c{k}") for k in (0, 5, 13)))
    for r in both.collect():
        assert abs(r["s"]["ra"] - r["c"]["ra"]) < 1e-9 and abs(r["s"]["dec"] - r["c"]["dec"]) < 1e-9
        assert all(r[f"s{k}"] == r[f"c{k}"] for k in (0, 5, 13))
    assert pack.sql("SELECT healpix_index(3, NULL, 1D) AS n").first()["n"] is None
    texts = pack.createDataFrame([("He was running",), ("a relational thing",), ("RUNS related",), ("",), (None,), ("rune",)], "t string")
    for query in ("run", "the Runner's", "relate", "running related", "of the", ""):
        rows = texts.select(F.expr(f"hasword(t, {query!r})" if "'" not in query else f'hasword(t, "{query}")').alias("s"), text.has_words("t", query).alias("c")).collect()
        assert [r["s"] for r in rows] == [r["c"] for r in rows]
    words = ["generalizations", "hopping", "hoping", "falling", "agreed", "skies", "sky", "adoption", "controlling", "rates", "ab", "m3ing", "activities"]
    found = pack.createDataFrame([(w,) for w in words], "w string").select(F.expr(stem_sql("w"))).collect()
    assert [r[0] for r in found] == [stem(w) for w in words]


def test_install_says_what_it_cannot(spark):
    registry.register(registry.UserFunction("only_column", "x", "INT", "A column function.", column=lambda x: x))
    try:
        with pytest.raises(ValueError, match="only_column"):
            registry.install(spark)
        with pytest.raises(ValueError, match="no SQL body for only_column, not_there"):
            registry.install(spark, ["square", "only_column", "not_there"])
        assert registry.install(spark, ["square"]) == ["square"]
    finally:
        del registry.FUNCTIONS["only_column"]
