"""Joins."""

from pyspark.sql import functions as F

from ..functions import regions
from ..operators import coverage, crossmatch, keys, lookups, relational
from ..session import scratch_path
from .registry import dist_sql, query


@query("j1_inner_on", "SELECT o_orderkey, l_linenumber, c_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
                      "JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 40")
def j1_inner_on(t):
    o = t.orders.filter("o_orderpriority = '1-URGENT'")
    li = t.lineitem.filter("l_quantity > 40")
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "l_linenumber", "c_name")


@query("j1_theta", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
                   "AND l_shipdate < o_orderdate AND l_extendedprice * 3 > o_totalprice")
def j1_theta(t):
    on = ((F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") < F.col("o_orderdate"))
          & (F.col("l_extendedprice") * 3 > F.col("o_totalprice")))
    return t.lineitem.join(t.orders, on).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("j2_using", "SELECT k, n, m FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a "
                   "JOIN (SELECT s_suppkey AS k, s_name AS m FROM supplier) b USING (k)")
def j2_using(t):
    a = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    return a.join(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("m")), "k")


@query("j3_natural", "SELECT * FROM (SELECT doc_id, lang FROM documents) a NATURAL JOIN labels b")
def j3_natural(t):
    return relational.natural_join(t.documents.select("doc_id", "lang"), t.labels)


@query("j4_left_outer", "SELECT d.doc_id, toxic FROM documents d LEFT OUTER JOIN labels l ON d.doc_id = l.doc_id")
def j4_left_outer(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "toxic")


@query("j4_right_outer", "SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) o "
                         "RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey")
def j4_right_outer(t):
    o = t.orders.filter("o_totalprice > 200000")
    return o.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@query("j4_full_outer", "SELECT a.k AS left_key, b.k AS right_key FROM (SELECT s_suppkey AS k FROM supplier "
                        "WHERE s_acctbal > 0) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer "
                        "WHERE c_acctbal > 9000) b ON a.k = b.k")
def j4_full_outer(t):
    a = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("left_key"))
    b = t.customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("right_key"))
    return a.join(b, F.col("left_key") == F.col("right_key"), "full")


@query("j5_cross", "SELECT c_custkey, r_name FROM customer, region")
def j5_cross(t):
    # region has five rows at every scale, so the product stays linear in the customers
    return t.customer.select("c_custkey").crossJoin(t.region.select("r_name"))


@query("j6_nested", "SELECT o_orderkey, n_name, r_name FROM orders JOIN (customer JOIN (nation JOIN region ON "
                    "n_regionkey = r_regionkey) ON c_nationkey = n_nationkey) ON o_custkey = c_custkey "
                    "WHERE o_totalprice > 300000")
def j6_nested(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    people = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.filter("o_totalprice > 300000").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "n_name", "r_name")


@query("j7_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o "
                  "WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 40)")
def j7_semi(t):
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 40)
    return t.customer.join(t.orders, on, "left_semi").select("c_custkey")


@query("j7_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem "
                         "WHERE l_quantity = 50)")
def j7_in_subquery(t):
    return t.part.join(t.lineitem.filter("l_quantity = 50"), F.col("p_partkey") == F.col("l_partkey"),
                       "left_semi").select("p_partkey")


@query("j8_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o "
                  "WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def j8_anti(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j8_not_in", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j8_not_in(t):
    return t.spark.sql("SELECT doc_id FROM {d} WHERE doc_id NOT IN (SELECT doc_id FROM {l})",
                       d=t.documents, l=t.labels)


@query("j9_derived_table", "SELECT seg, count(*) AS n, round(sum(bal), 2) AS total FROM (SELECT c_mktsegment AS seg, "
                           "c_acctbal AS bal FROM customer WHERE c_acctbal > 0) q GROUP BY seg")
def j9_derived_table(t):
    q = t.customer.filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    return q.groupBy("seg").agg(F.count("*").alias("n"), F.round(F.sum("bal"), 2).alias("total"))


@query("j10_crossmatch", f"SELECT a.c_custkey, b.s_suppkey, round({dist_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')}, 6) AS dist "
                         f"FROM {{sky_a}} a JOIN {{sky_b}} b ON {dist_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= 3.0")
def j10_crossmatch(t):
    pairs = crossmatch.crossmatch(t.sky_a.select("c_custkey", "ra", "dec"), t.sky_b.select("s_suppkey", "ra", "dec"),
                                  3.0)
    return pairs.select("c_custkey", "s_suppkey", F.round("dist", 6).alias("dist"))


@query("j10_unmatched", f"SELECT c_custkey FROM {{sky_a}} a WHERE NOT EXISTS (SELECT 1 FROM {{sky_b}} b "
                        f"WHERE {dist_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= 5.0)")
def j10_unmatched(t):
    return crossmatch.crossmatch(t.sky_a, t.sky_b, 5.0, how="left_anti").select(F.col("c_custkey"))


@query("j11_region_list", f"SELECT c_custkey, s_suppkey FROM {{sky_a}} a JOIN {{sky_b}} b ON "
                          f"{dist_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= 1 + b.s_suppkey % 4 WHERE s_acctbal > 0")
def j11_region_list(t):
    areas = t.sky_b.filter("s_acctbal > 0").select(
        "s_suppkey", F.col("ra").alias("center_ra"), F.col("dec").alias("center_dec"),
        (1 + F.col("s_suppkey") % 4).cast("double").alias("radius"))
    test = regions.point_in_circle(regions.point("ra", "dec"), regions.circle("center_ra", "center_dec", "radius"))
    return crossmatch.match_regions(t.sky_a.select("c_custkey", "ra", "dec"), areas, test, max_radius=4.0).select(
        "c_custkey", "s_suppkey")


_STAR = [(0.0, 1.0), (0.2, 0.25), (0.9, 0.4), (0.3, -0.2), (0.6, -0.8), (-0.1, -0.35), (-0.8, -0.7), (-0.35, 0.1)]
_STAR_SQL = ", ".join(f"{{'i': {i}, 'u': {u}, 'w': {w}}}" for i, (u, w) in enumerate(_STAR))


@query("j11_irregular_regions", f"""WITH v AS (SELECT p_partkey, q.i, ra + q.u * (p_size / 5e0) AS a, dec + q.w * (p_size / 5e0) AS d FROM (
  SELECT *, unnest([{_STAR_SQL}]) AS q FROM {{sky_part}} s WHERE abs(dec) < 70) z),
 c AS (SELECT *, cos(radians(d)) * cos(radians(a)) AS x, cos(radians(d)) * sin(radians(a)) AS y, sin(radians(d)) AS z FROM v),
 e AS (SELECT p.p_partkey, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz FROM c p JOIN c q ON p.p_partkey = q.p_partkey AND q.i = (p.i + 1) % 8),
 o AS (SELECT c_custkey, p_partkey, cos(radians(a.dec)) * cos(radians(a.ra)) AS x, cos(radians(a.dec)) * sin(radians(a.ra)) AS y, sin(radians(a.dec)) AS z
  FROM {{sky_a}} a JOIN {{sky_part}} b ON {dist_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} < 35 AND abs(b.dec) < 70)
 SELECT c_custkey, p_partkey FROM o JOIN e USING (p_partkey) GROUP BY c_custkey, p_partkey HAVING abs(sum(atan2(
  (ay * bz - az * by_) * x + (az * bx - ax * bz) * y + (ax * by_ - ay * bx) * z,
  ax * bx + ay * by_ + az * bz - (ax * x + ay * y + az * z) * (bx * x + by_ * y + bz * z)))) > pi()""")
def j11_irregular_regions(t):
    """Positions in star-shaped regions of very different sizes, found by their covers."""
    corner = lambda u, w: regions.point(F.col("ra") + u * F.col("p_size") / 5.0, F.col("dec") + w * F.col("p_size") / 5.0)
    areas = t.images.filter("abs(dec) < 70").select("p_partkey", F.array(*(corner(u, w) for u, w in _STAR)).alias("area"))
    return coverage.match_shapes(t.sky_a.select("c_custkey", "ra", "dec"), areas, "area", "polygon").select("c_custkey", "p_partkey")


@query("j10_varied_radii", f"SELECT a.c_custkey, b.s_suppkey, round({dist_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')}, 6) AS dist FROM {{sky_a}} a JOIN {{sky_b}} b "
                           f"ON {dist_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= 60 / pow(8, b.s_suppkey % 7)")
def j10_varied_radii(t):
    circles = t.sky_b.select("s_suppkey", "ra", "dec", (60 / F.pow(F.lit(8.0), F.col("s_suppkey") % 7)).alias("reach"))
    pairs = coverage.match_circles(t.sky_a.select("c_custkey", "ra", "dec"), circles, "reach")
    return pairs.select("c_custkey", "s_suppkey", F.round("dist", 6).alias("dist"))


@query("j12_nearest", f"SELECT c_custkey, round({dist_sql('ra', 'dec', '120.0', '10.0')}, 6) AS dist FROM {{sky_a}} s "
                      f"ORDER BY {dist_sql('ra', 'dec', '120.0', '10.0')}, c_custkey LIMIT 10")
def j12_nearest(t):
    return crossmatch.nearest(t.sky_a, 120.0, 10.0, 10, ties=["c_custkey"]).select(
        "c_custkey", F.round("dist", 6).alias("dist"))


@query("j13_select_one", "SELECT c_custkey, n_name AS nation_name, n_regionkey AS region FROM customer JOIN nation "
                         "ON c_nationkey = n_nationkey")
def j13_select_one(t):
    found = lookups.select_one(t.customer, t.nation, "c_nationkey", "n_nationkey",
                               "n_name:nation_name(unknown) n_regionkey:region", order=["n_name"])
    return found.select("c_custkey", "nation_name", "region")


@query("j14_merge_first", "SELECT n_nationkey, top_name, top_price FROM nation, (SELECT p_name AS top_name, "
                          "p_retailprice AS top_price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) q")
def j14_merge_first(t):
    best = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").select(
        F.col("p_name").alias("top_name"), F.col("p_retailprice").alias("top_price"))
    return lookups.merge_first(t.nation.select("n_nationkey"), best)


@query("j15_dict_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' "
                       "END AS state FROM orders")
def j15_dict_map(t):
    return t.orders.select("o_orderkey", lookups.dict_map("o_orderstatus", {"O": "open", "F": "done"}, "other")
                           .alias("state"))


@query("j16_name_map", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'industry' "
                       "WHEN c_mktsegment = 'HOUSEHOLD' THEN 'home' ELSE c_mktsegment END AS sector FROM customer")
def j16_name_map(t):
    path = scratch_path(t.spark, "aliases")
    # aliases come out of the data: the segments in the case people write them
    segments = t.customer.select("c_mktsegment").distinct()
    target = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "industry").when(
        F.col("c_mktsegment") == "HOUSEHOLD", "home")
    segments.withColumn("target", target).filter("target IS NOT NULL").select(
        F.concat_ws("\t", "target", F.concat_ws(" ", F.initcap("c_mktsegment"), F.lit("x=20y")))).write.text(path)
    aliases = lookups.read_aliases(t.spark, path)
    return lookups.map_names(t.customer, aliases, "c_mktsegment", "sector", on_miss="keep").select(
        "c_custkey", "sector")


@query("j17_bands", "SELECT p_partkey, (p_size * 10) * 1e-9 AS lo, (p_size * 10 + 20) * 1e-9 AS mid FROM part "
                    "JOIN (SELECT p_brand AS b, min(p_size) AS s FROM part GROUP BY 1) q ON p_brand = b "
                    "WHERE p_size = s")
def j17_bands(t):
    bands = t.part.groupBy(F.col("p_brand").alias("name")).agg(
        (F.min("p_size") * 10).alias("low"), (F.min("p_size") * 10 + 20).alias("mid"),
        (F.min("p_size") * 10 + 40).alias("high"))
    found = lookups.map_bands(t.part, bands, "p_brand")
    return found.filter(F.round(F.col("bandpassLo") * 1e8) == F.col("p_size")).select(
        "p_partkey", F.col("bandpassLo").alias("lo"), F.col("bandpassRefval").alias("mid"))


@query("j18_resolve", "SELECT event_id, ra, dec FROM events e LEFT JOIN {sky_a} s ON "
                      "lower(c_name) = 'customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')")
def j18_resolve(t):
    objects = t.sky_a.select(F.col("c_name").alias("name"), "ra", "dec")
    named = t.events.select("event_id", F.format_string("Customer#%09d", "user_id").alias("name"))
    return lookups.resolve_names(named, objects, "name").select("event_id", "ra", "dec")


@query("j19_resource_join", "SELECT s_suppkey, n_name, l_orderkey FROM supplier JOIN nation ON s_nationkey = "
                            "n_nationkey LEFT OUTER JOIN (SELECT * FROM lineitem WHERE l_quantity = 50 AND "
                            "l_linenumber = 1) l ON s_suppkey = l_suppkey")
def j19_resource_join(t):
    sets = t.nation.withColumnRenamed("n_nationkey", "s_nationkey")
    interfaces = t.lineitem.filter("l_quantity = 50 AND l_linenumber = 1").select(
        F.col("l_suppkey").alias("s_suppkey"), "l_orderkey")
    return relational.natural_join(relational.natural_join(t.supplier, sets), interfaces, "left").select(
        "s_suppkey", "n_name", "l_orderkey")


@query("j20_orphans", "SELECT doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d "
                      "WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def j20_orphans(t):
    return keys.orphans(t.labels, t.documents.filter("lang = 'en'"), {"doc_id": "doc_id"}).select("doc_id", "quality")
