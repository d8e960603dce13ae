"""Angles and positions."""

from pyspark.sql import functions as F

from ..functions import angles, healpix, sphere
from .registry import dist_sql, query


@query("n1_parse_hms", "SELECT c_custkey, round(ra, 6) AS a, round(ra, 6) AS b, round(ra, 6) AS c FROM {sky_a} s")
def n1_parse_hms(t):
    squeezed = F.concat(*(F.lpad(F.get(F.split(angles.deg_to_hms("ra", " ", 6), " "), F.lit(i)), n, "0")
                          for i, n in ((0, 2), (1, 2), (2, 9))))
    return t.sky_a.select(
        "c_custkey", F.round(angles.hms_to_deg(angles.deg_to_hms("ra", " ", 6)), 6).alias("a"),
        F.round(angles.hms_to_deg(angles.deg_to_hms("ra", ":", 6), ":"), 6).alias("b"),
        F.round(angles.hms_to_deg(squeezed, ""), 6).alias("c"))


@query("n2_parse_dms", "SELECT c_custkey, round(dec, 6) AS a, round(dec / 1e3, 6) AS b FROM {sky_a} s")
def n2_parse_dms(t):
    # the second column has many values between 0 and -1 degree
    return t.sky_a.select(
        "c_custkey", F.round(angles.dms_to_deg(angles.deg_to_dms("dec", " ", 6)), 6).alias("a"),
        F.round(angles.dms_to_deg(angles.deg_to_dms(F.col("dec") / 1e3, ":", 6), ":"), 6).alias("b"))


@query("n3_hours", "SELECT c_custkey, (ra / 15) * 15 AS a, round(ra, 8) AS b FROM {sky_a} s")
def n3_hours(t):
    return t.sky_a.select("c_custkey", angles.hours_to_deg(F.col("ra") / 15).alias("a"), F.round(
        angles.parse_angle((F.col("ra") / 15).cast("string"), "fracHour"), 8).alias("b"))


@query("n4_parse_pair", "SELECT c_custkey, round(ra, 5) AS ra, round(dec, 5) AS dec FROM {sky_a} s")
def n4_parse_pair(t):
    kind = F.col("c_custkey") % 4
    blanks = F.concat_ws(" ", angles.deg_to_hms("ra", " ", 6), angles.deg_to_dms("dec", " ", 6))
    colons = F.concat_ws(" ", angles.deg_to_hms("ra", ":", 6), angles.deg_to_dms("dec", ":", 6))
    pair = F.when(kind == 0, F.concat_ws(",", "ra", "dec")).when(kind == 1, F.concat_ws(" ", "ra", "dec")).when(
        kind == 2, blanks).otherwise(colons)
    found = t.sky_a.select("c_custkey", angles.parse_pair(pair).alias("p"))
    return found.select("c_custkey", F.round("p.ra", 5).alias("ra"), F.round("p.dec", 5).alias("dec"))


@query("n5_vectors", "SELECT c_custkey, round(cos(radians(dec)) * cos(radians(ra)), 8) AS x, "
                     "round(cos(radians(dec)) * sin(radians(ra)), 8) AS y, round(sin(radians(dec)), 8) AS z, "
                     "round(ra, 6) AS back_ra, round(dec, 6) AS back_dec FROM {sky_a} s")
def n5_vectors(t):
    rows = t.sky_a.withColumn("v", sphere.unit_vector("ra", "dec"))
    return rows.select(
        "c_custkey", *(F.round(F.col("v")[c], 8).alias(c) for c in "xyz"),
        F.round(sphere.vector_ra(F.col("v.x"), F.col("v.y")), 6).alias("back_ra"),
        F.round(sphere.vector_dec(F.col("v.x"), F.col("v.y"), F.col("v.z")), 6).alias("back_dec"))


@query("n6_distance", f"SELECT c_custkey, round({dist_sql('ra', 'dec', '30.0', '-45.0')}, 7) AS d FROM {{sky_a}} s")
def n6_distance(t):
    return t.sky_a.select("c_custkey", F.round(sphere.distance("ra", "dec", 30.0, -45.0), 7).alias("d"))


@query("n7_heading", "SELECT c_custkey, CASE WHEN abs(ra - 90.5) <= 1e-9 THEN CASE WHEN dec < 10 THEN 0.0 ELSE 180.0 END WHEN dec <= -90 THEN 0.0 "
                     "WHEN dec >= 90 THEN 180.0 ELSE round((degrees(atan2(sin(radians(90.5 - ra)) * cos(radians(10)), cos(radians(dec)) * "
                     "sin(radians(10)) - sin(radians(dec)) * cos(radians(10)) * cos(radians(90.5 - ra)))) + 360) % 360, 6) END "
                     "AS heading FROM {sky_a} s")
def n7_heading(t):
    return t.sky_a.select("c_custkey", F.round(sphere.heading("ra", "dec", 90.5, 10.0), 6).alias("heading"))


_MOVE_Z = "(sin(radians(dec)) * cos(m) + cos(radians(dec)) * sin(m) * pd / pt)"
_MOVE_X = ("(cos(radians(dec)) * cos(radians(ra)) * cos(m) - (sin(radians(dec)) * cos(radians(ra)) * pd / pt + "
           "sin(radians(ra)) * pa / pt) * sin(m))")
_MOVE_Y = ("(cos(radians(dec)) * sin(radians(ra)) * cos(m) - (sin(radians(dec)) * sin(radians(ra)) * pd / pt - "
           "cos(radians(ra)) * pa / pt) * sin(m))")


@query("n8_proper_motion", f"SELECT c_custkey, round((degrees(atan2({_MOVE_Y}, {_MOVE_X})) + 360) % 360, 5) AS ra2, "
                           f"round(degrees(atan2({_MOVE_Z}, sqrt({_MOVE_X} * {_MOVE_X} + {_MOVE_Y} * {_MOVE_Y}))), 5) AS dec2 FROM (SELECT *, radians(pt * 100) AS m FROM "
                           f"(SELECT *, sqrt(pa * pa + pd * pd) AS pt FROM (SELECT c_custkey, ra, dec, (c_custkey % 7 + 1) / 1e3 "
                           f"AS pa, (c_custkey % 11 - 5) / 1e3 AS pd FROM {{sky_a}} s) q) q) q")
def n8_proper_motion(t):
    rows = t.sky_a
    moved = sphere.move("ra", "dec", (F.col("c_custkey") % 7 + 1) / 1e3, (F.col("c_custkey") % 11 - 5) / 1e3, 100.0)
    return rows.select("c_custkey", moved.alias("p")).select(
        "c_custkey", F.round("p.ra", 5).alias("ra2"), F.round("p.dec", 5).alias("dec2"))


@query("n9_fold_clamp", "SELECT c_custkey, (((ra - 500) % 360) + 360) % 360 AS folded, greatest(-90, least(90, dec * 1.5)) "
                        "AS clamped, ra + 30 > 270 AND ra - 30 < 90 AS stitched FROM {sky_a} s")
def n9_fold_clamp(t):
    return t.sky_a.select(
        "c_custkey", sphere.fold_ra(F.col("ra") - 500).alias("folded"), sphere.clamp_dec(F.col("dec") * 1.5).alias("clamped"),
        sphere.crosses_stitch(F.col("ra") - 30, F.col("ra") + 30).alias("stitched"))


@query("n12_geodetic", "SELECT c_custkey, round(dec, 7) AS lat, CAST(c_nationkey * 100 AS DOUBLE) AS height FROM {sky_a} s")
def n12_geodetic(t):
    there = sphere.geodetic_to_geocentric("ra", "dec", F.col("c_nationkey") * 100.0)
    rows = t.sky_a.withColumn("g", there).select(
        "c_custkey", F.col("g.lon").alias("lon"), F.col("g.lat").alias("phi"), F.col("g.rho").alias("rho"))
    back = sphere.geocentric_to_geodetic(rows, "lon", "phi", "rho")
    return back.select("c_custkey", F.round("geod_lat", 7).alias("lat"), F.round("geod_height", 3).alias("height"))


def _healpix_sql(order: int) -> str:
    n = 1 << order
    spread = lambda v: f"CAST(list_sum(list_transform(range(0, {order}), lambda i: (({v} >> i) & 1) << (2 * i))) AS BIGINT)"
    return (
        f"SELECT c_custkey, f * {n * n} + {spread('x')} + 2 * {spread('y')} AS hpx FROM (SELECT c_custkey, "
        f"CASE WHEN eq THEN CASE WHEN (jp >> {order}) = (jm >> {order}) THEN (jp >> {order}) | 4 WHEN (jp >> {order}) < "
        f"(jm >> {order}) THEN (jp >> {order}) ELSE (jm >> {order}) + 8 END ELSE CASE WHEN z >= 0 THEN q ELSE q + 8 END END AS f, "
        f"CASE WHEN eq THEN jm & {n - 1} WHEN z >= 0 THEN {n - 1} - jm ELSE jp END AS x, "
        f"CASE WHEN eq THEN {n - 1} - (jp & {n - 1}) WHEN z >= 0 THEN {n - 1} - jp ELSE jm END AS y FROM (SELECT *, "
        f"CAST(CASE WHEN eq THEN floor({n} * (0.5 + t - 0.75 * z)) ELSE least({n - 1}, floor((t - q) * w)) END AS BIGINT) AS jp, "
        f"CAST(CASE WHEN eq THEN floor({n} * (0.5 + t + 0.75 * z)) ELSE least({n - 1}, floor((1 - t + q) * w)) END AS BIGINT) AS jm "
        f"FROM (SELECT *, abs(z) <= 2e0 / 3 AS eq, CAST(least(3, floor(t)) AS BIGINT) AS q, {n} * sqrt(3e0 / (1 + abs(z))) * "
        f"abs(cos(radians(dec))) AS w FROM (SELECT c_custkey, dec, sin(radians(dec)) AS z, ra / 90 AS t FROM {{sky_a}} s) a) b) c) d")


# positions on cell borders are decided by the last bit of a sine; offsets keep away from them
_OFF_GRID = "(SELECT c_custkey, ra + 0.00137 AS ra, dec * 0.99991 + 0.00071 AS dec FROM {sky_a} s0)"


@query("n13_healpix", _healpix_sql(8).replace("{sky_a}", _OFF_GRID))
def n13_healpix(t):
    rows = t.sky_a.select("c_custkey", (F.col("ra") + 0.00137).alias("ra"), (F.col("dec") * 0.99991 + 0.00071).alias("dec"))
    return healpix.with_healpix(rows, 8).select("c_custkey", "hpx")


@query("n13_healpix_column", _healpix_sql(10).replace("{sky_a}", _OFF_GRID))
def n13_healpix_column(t):
    rows = t.sky_a.select("c_custkey", (F.col("ra") + 0.00137).alias("ra"), (F.col("dec") * 0.99991 + 0.00071).alias("dec"))
    return rows.select("c_custkey", healpix.healpix_index(10, "ra", "dec").alias("hpx"))


@query("n14_healpix_center", "SELECT c_custkey, TRUE AS same_cell, TRUE AS near FROM {sky_a} s")
def n14_healpix_center(t):
    rows = healpix.with_healpix(t.sky_a.select("c_custkey", "ra", "dec"), 8)
    rows = healpix.with_healpix_center(rows, 8)
    rows = healpix.with_healpix(rows, 8, F.col("center.ra"), F.col("center.dec"), out="again")
    # the centre lies in its own cell, and no farther off than a cell is large
    return rows.select("c_custkey", (F.col("hpx") == F.col("again")).alias("same_cell"), (sphere.distance(
        "ra", "dec", F.col("center.ra"), F.col("center.dec")) < 0.3).alias("near"))
