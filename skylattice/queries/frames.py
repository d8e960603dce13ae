"""Reference frames."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import regions, sphere, stctext
from .registry import query


def _rotated_sql(matrix: np.ndarray, ra: str = "ra", dec: str = "dec") -> tuple[str, str]:
    xyz = [f"cos(radians({dec})) * cos(radians({ra}))", f"cos(radians({dec})) * sin(radians({ra}))", f"sin(radians({dec}))"]
    x, y, z = ("(" + " + ".join(f"({m[i]!r}::DOUBLE) * {xyz[i]}" for i in range(3)) + ")" for m in
               [[float(v) for v in row] for row in matrix])
    return f"(degrees(atan2({y}, {x})) + 360) % 360", f"degrees(atan2({z}, sqrt({x} * {x} + {y} * {y})))"


_GAL = _rotated_sql(fr.J2000_TO_GALACTIC)
_PREC = _rotated_sql(fr.precession_fk5(fr.JD_J2000, fr.julian_epoch(1975.0)))


@query("n10_galactic", f"SELECT c_custkey, round({_GAL[0]}, 6) AS l, round({_GAL[1]}, 6) AS b FROM {{sky_a}} s")
def n10_galactic(t):
    out = fr.transform_position(t.sky_a, fr.FK5, fr.GALACTIC, out_ra="l", out_dec="b")
    return out.select("c_custkey", F.round("l", 6).alias("l"), F.round("b", 6).alias("b"))


@query("n10_precession", f"SELECT c_custkey, round({_PREC[0]}, 6) AS ra75, round({_PREC[1]}, 6) AS dec75 FROM {{sky_a}} s")
def n10_precession(t):
    out = fr.transform_position(t.sky_a, fr.FK5, fr.fk5(1975.0), out_ra="ra75", out_dec="dec75")
    return out.select("c_custkey", F.round("ra75", 6).alias("ra75"), F.round("dec75", 6).alias("dec75"))


@query("n10_round_trips", "SELECT c_custkey, 0.0 AS sg_off, 0.0 AS ecl_off FROM {sky_a} s")
def n10_round_trips(t):
    df = t.sky_a.select("c_custkey", "ra", "dec")
    for mark, frame in (("sg", fr.SUPER_GALACTIC), ("ecl", fr.ecliptic())):
        df = fr.transform_position(df, fr.ICRS, frame, out_ra="a", out_dec="d")
        df = fr.transform_position(df, frame, fr.ICRS, "a", "d", "back_ra", "back_dec")
        off = F.abs(F.round(sphere.distance("ra", "dec", "back_ra", "back_dec"), 6))
        df = df.withColumn(f"{mark}_off", off).drop("a", "d", "back_ra", "back_dec")
    return df.drop("ra", "dec")


def _fk4_sql(parallax: str, rv: str, pm_ra: str, pm_dec: str, columns: str) -> str:
    """FK4 B1950 to FK5 J2000 with velocities, in SQL; ends in a select over x, y, z, u, v, w."""
    k = fr.AU_PER_CENTURY
    century = 100.0 / fr.ARCSEC
    r = {"x": "cos(radians(dec)) * cos(radians(ra))", "y": "cos(radians(dec)) * sin(radians(ra))", "z": "sin(radians(dec))"}
    start = (f"SELECT *, {r['x']} AS x, {r['y']} AS y, {r['z']} AS z, ({pm_ra}) * {century!r}::DOUBLE AS pa, ({pm_dec}) * {century!r}::DOUBLE AS pd, "
             f"{k!r}::DOUBLE * ({rv}) * ({parallax}) AS rad FROM {{sky_a}} s")
    moved = (f"SELECT *, -pa * y - pd * cos(radians(ra)) * z + rad * x AS u, pa * x - pd * sin(radians(ra)) * z + rad * y AS v, "
             f"pd * cos(radians(dec)) + rad * z AS w FROM ({start}) a")
    dot = lambda terms, names: " + ".join(f"({float(c)!r}::DOUBLE) * {n}" for c, n in zip(terms, names))
    terms = (f"SELECT *, {dot(fr.E_TERMS, 'xyz')} AS ea, {dot(fr.E_TERMS_RATE, 'xyz')} AS er, {dot(fr.E_TERMS, 'uvw')} AS ev FROM ({moved}) b")
    clean = "SELECT * EXCLUDE (x, y, z, u, v, w), " + ", ".join(
        [f"{n} - ({float(fr.E_TERMS[i])!r}::DOUBLE) + ea * {n} AS {n}" for i, n in enumerate("xyz")]
        + [f"{m} - ({float(fr.E_TERMS_RATE[i])!r}::DOUBLE) + er * {n} + ev * {n} + ev * {m} AS {m}" for i, (n, m) in enumerate(zip("xyz", "uvw"))]
    ) + f" FROM ({terms}) c"
    turned = "SELECT * EXCLUDE (x, y, z, u, v, w), " + ", ".join(
        f"{dot(fr.FK4_TO_FK5[i], 'xyzuvw')} AS {n}" for i, n in enumerate("xyzuvw")) + f" FROM ({clean}) d"
    return f"SELECT {columns} FROM (SELECT *, x * x + y * y AS a2, x * u + y * v AS xv, x * x + y * y + z * z AS r2 FROM ({turned}) e) f"


_BACK = "round((degrees(atan2(y, x)) + 360) % 360, {n}) AS ra, round(degrees(atan2(z, sqrt(x * x + y * y))), {n}) AS dec"


@query("n10_fk4", _fk4_sql("0", "0", "0", "0", "c_custkey, " + _BACK.replace("{n}", "6")))
def n10_fk4(t):
    df = fr.transform_position(t.sky_a, fr.FK4, fr.FK5)
    return df.select("c_custkey", F.round("ra_out", 6).alias("ra"), F.round("dec_out", 6).alias("dec"))


@query("n11_six_vector", _fk4_sql(
    "0.1", "c_acctbal / 100", "c_nationkey * 1e-8", "1e-7", "c_custkey, " + _BACK.replace("{n}", "6")
    + ", round(0.1 / sqrt(r2), 8) AS parallax, round((xv + z * w) / (" + repr(fr.AU_PER_CENTURY) + "::DOUBLE * 0.1 * sqrt(r2)), 5) AS rv, "
      "round((w * a2 - z * xv) / (r2 * sqrt(a2)) / " + repr(100.0 / fr.ARCSEC) + "::DOUBLE * 1e9, 4) AS pm_dec, "
      "round((x * v - y * u) / sqrt(a2 * r2) / " + repr(100.0 / fr.ARCSEC) + "::DOUBLE * 1e9, 4) AS pm_ra_cosdec"))
def n11_six_vector(t):
    df = t.sky_a.select(
        "c_custkey", "ra", "dec", F.lit(0.1).alias("parallax"), (F.col("c_nationkey") * 1e-8).alias("pm_ra"),
        F.lit(1e-7).alias("pm_dec"), (F.col("c_acctbal") / 100).alias("rv"))
    out = fr.transform_six(df, fr.FK4, fr.FK5)
    return out.select(
        "c_custkey", F.round("out_ra", 6).alias("ra"), F.round("out_dec", 6).alias("dec"), F.round("out_parallax", 8).alias("parallax"),
        F.round("out_rv", 5).alias("rv"), F.round(F.col("out_pm_dec") * 1e9, 4).alias("pm_dec"),
        F.round(F.col("out_pm_ra") * F.cos(F.radians("out_dec")) * 1e9, 4).alias("pm_ra_cosdec"))


@query("g9_implicit_frame", f"SELECT c_custkey FROM {{sky_a}} s WHERE abs({_GAL[1]}) <= 90 AND degrees(acos(greatest(-1, least(1, "
                            f"sin(radians({_GAL[1]})) * sin(radians(20)) + cos(radians({_GAL[1]})) * cos(radians(20)) * "
                            f"cos(radians({_GAL[0]} - 45)))))) <= 25")
def g9_implicit_frame(t):
    region = stctext.parse_region("Circle GALACTIC 45 20 25")
    return t.sky_a.filter(region.contains_point("ra", "dec", "ICRS")).select("c_custkey")


_CORNER = _rotated_sql(fr.J2000_TO_GALACTIC, "(ra - p_size / 2e1)", "(dec - p_size / 2e1)")


@query("g21_region_frame", f"SELECT p_partkey, round({_GAL[0]}, 6) AS l, round({_GAL[1]}, 6) AS b, p_size / 1e1 AS radius, round({_CORNER[1]}, 6) AS corner_b "
                           f"FROM {{sky_part}} s")
def g21_region_frame(t):
    images = t.images
    circle = regions.circle("ra", "dec", "size")
    turned = fr.rotate_circle(circle, fr.FK5, fr.GALACTIC)
    vertices = fr.rotate_vertices(F.col("coverage"), fr.FK5, fr.GALACTIC)
    rows = images.select("p_partkey", turned.alias("c"), vertices.alias("v"))
    return rows.select("p_partkey", F.round("c.ra", 6).alias("l"), F.round("c.dec", 6).alias("b"), "c.radius",
                       F.round(F.col("v")[0]["dec"], 6).alias("corner_b"))
