"""Select lists, predicates of the dialect, ordering, limits, set operations."""

from pyspark.sql import functions as F

from .. import schema
from ..operators import limits, relational
from ..functions import math as m
from ..schema import ColumnSpec, TableSpec
from .registry import query

SKY_SPEC = TableSpec("sky", (
    ColumnSpec("c_custkey", "bigint", ucd="meta.id;meta.main", verb_level=1, required=True),
    ColumnSpec("c_name", "string", ucd="meta.title", verb_level=10),
    ColumnSpec("c_nationkey", "int", ucd="meta.code", verb_level=20),
    ColumnSpec("c_acctbal", "double", unit="mag", ucd="phot.mag;em.opt", verb_level=10),
    ColumnSpec("c_mktsegment", "string", ucd="meta.code.class", verb_level=30),
    ColumnSpec("ra", "double", unit="deg", ucd="pos.eq.ra;meta.main", verb_level=1),
    ColumnSpec("dec", "double", unit="deg", ucd="pos.eq.dec;meta.main", verb_level=1),
), primary_key=("c_custkey",))


@query("p1_select_list", "SELECT o.o_orderkey AS id, o.o_orderpriority, c.c_name AS customer_name FROM orders o "
                         "JOIN customer c ON o.o_custkey = c.c_custkey")
def p1_select_list(t):
    o, c = t.orders.alias("o"), t.customer.alias("c")
    return o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey")).select(
        F.col("o.o_orderkey").alias("id"), "o.o_orderpriority", F.col("c.c_name").alias("customer_name"))


@query("p1_star_after_using", "SELECT * FROM (SELECT l_suppkey AS k, l_orderkey FROM lineitem) a "
                              "JOIN (SELECT s_suppkey AS k, s_name FROM supplier) b USING (k)")
def p1_star_after_using(t):
    a = t.lineitem.select(F.col("l_suppkey").alias("k"), "l_orderkey")
    return a.join(t.supplier.select(F.col("s_suppkey").alias("k"), "s_name"), "k").select("*")


@query("p2_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def p2_distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("p3_arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber // 2 AS half, -l_linenumber + 3 AS turned, "
                        "l_extendedprice * (1 - l_discount) / l_quantity AS unit_price FROM lineitem")
def p3_arithmetic(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", m.int_div("l_linenumber", F.lit(2)).alias("half"),
        (-F.col("l_linenumber") + 3).alias("turned"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("unit_price"))


@query("p4_comparison", "SELECT l_orderkey, l_linenumber FROM lineitem "
                        "WHERE l_quantity >= 49 AND l_discount != 0.05 AND l_tax < 0.03")
def p4_comparison(t):
    c = F.col
    return t.lineitem.filter((c("l_quantity") >= 49) & (c("l_discount") != 0.05) & (c("l_tax") < 0.03)).select(
        "l_orderkey", "l_linenumber")


@query("p5_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 "
                     "AND o_custkey NOT BETWEEN 100 AND 1000")
def p5_between(t):
    return t.orders.filter(F.col("o_totalprice").between(1000, 20000)
                           & ~F.col("o_custkey").between(100, 1000)).select("o_orderkey")


@query("p6_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') "
                "AND c_nationkey NOT IN (1, 2, 3)")
def p6_in(t):
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
                             & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey")


@query("p7_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%ARD' AND p_name NOT LIKE 'h_t%'")
def p7_like(t):
    return t.part.filter(F.col("p_type").like("%ARD") & ~F.col("p_name").like("h_t%")).select("p_partkey", "p_name")


@query("p8_is_null", "SELECT count(*) FILTER (WHERE quality IS NULL) AS missing, "
                     "count(*) FILTER (WHERE quality IS NOT NULL) AS present "
                     "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def p8_is_null(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.agg(F.count_if(F.col("quality").isNull()).alias("missing"),
                      F.count_if(F.col("quality").isNotNull()).alias("present"))


@query("p9_logic", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_quantity > 45) "
                   "AND NOT (l_discount > 0.02 AND l_tax > 0.01)")
def p9_logic(t):
    c = F.col
    return t.lineitem.filter(((c("l_returnflag") == "R") | (c("l_quantity") > 45))
                             & ~((c("l_discount") > 0.02) & (c("l_tax") > 0.01))).select("l_orderkey", "l_linenumber")


@query("p10_boolean_predicates", "SELECT c_custkey FROM {sky_a} s WHERE 1 = (ra < 180)::int AND 0 = (dec < -30)::int "
                                 "AND (c_mktsegment LIKE 'B%')::int != 1")
def p10_boolean_predicates(t):
    return t.sky_a.filter((F.col("ra") < 180) & ~(F.col("dec") < -30) & ~F.col("c_mktsegment").like("B%")).select(
        "c_custkey")


@query("p11_ucd_column", "SELECT c_custkey, c_acctbal AS mag FROM customer WHERE c_acctbal < 0")
def p11_ucd_column(t):
    df = SKY_SPEC.annotate(t.sky_a)
    mag = schema.ucd_column("phot.*", df)
    return df.filter(mag < 0).select("c_custkey", mag.alias("mag"))


@query("p12_unique_ucd", "SELECT c_custkey, ra AS lon, dec AS lat FROM {sky_a} s")
def p12_unique_ucd(t):
    df = SKY_SPEC.annotate(t.sky_a)
    ra = schema.column_by_ucds(df, "POS_EQ_RA_MAIN", "pos.eq.ra;meta.main")
    dec = schema.column_by_ucds(df, "POS_EQ_DEC_MAIN", "pos.eq.dec;meta.main")
    return df.select("c_custkey", F.col(ra).alias("lon"), F.col(dec).alias("lat"))


@query("p13_verbosity", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, ra, dec FROM {sky_a} s")
def p13_verbosity(t):
    return schema.select_columns(SKY_SPEC.annotate(t.sky_a), verb_level=10, patterns=["c_mkt*"])


@query("p14_computed_output", "SELECT c_custkey, c_acctbal * 2 + 1 AS doubled, upper(c_mktsegment) AS segment "
                              "FROM customer")
def p14_computed_output(t):
    return t.customer.selectExpr("c_custkey", "c_acctbal * 2 + 1 AS doubled", "upper(c_mktsegment) AS segment")


@query("l1_order_by", "SELECT doc_id, quality, n FROM (SELECT d.doc_id, quality, row_number() OVER "
                      "(ORDER BY quality DESC NULLS FIRST, d.doc_id) AS n FROM documents d LEFT JOIN labels l "
                      "ON d.doc_id = l.doc_id) s WHERE n <= 50")
def l1_order_by(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    top = joined.orderBy(relational.ordering("quality", descending=True), "doc_id").limit(50)
    return top.withColumn("n", F.expr("row_number() OVER (ORDER BY quality DESC NULLS FIRST, doc_id)").cast("bigint"))


@query("l2_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def l2_top(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("l3_offset", "SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 20 OFFSET 90")
def l3_offset(t):
    ids = relational.union(t.customer.select("c_custkey"), t.supplier.select(F.col("s_suppkey").alias("c_custkey")))
    return limits.page(ids, "c_custkey", 20, 90)


@query("l4_overflow", "SELECT least(count(*), 1000) AS matched, CASE WHEN count(*) > 1000 THEN 'OVERFLOW' ELSE 'OK' "
                      "END AS status FROM (SELECT 1 FROM orders WHERE o_totalprice > 100000 LIMIT 1001) s")
def l4_overflow(t):
    return limits.overflow(t.orders.filter("o_totalprice > 100000"), 1000)


@query("l5_limit_policy", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem "
                          "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 2000")
def l5_limit_policy(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return limits.limited(rows, limits.effective_limit(None), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("l6_sort_keys", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS FIRST, "
                       "s_suppkey DESC LIMIT 30")
def l6_sort_keys(t):
    keys = limits.sort_keys(["s_acctbal", "s_suppkey"], fixed="s_name", descending=True)
    return limits.limited(t.supplier.select("s_suppkey", "s_acctbal"), 30, *keys)


@query("l7_paging", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def l7_paging(t):
    return limits.page_after(t.events.select("event_id", "event_type"), "event_id", 100, last=500)


@query("u1_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u1_union(t):
    return relational.union(t.customer.select(F.col("c_nationkey").alias("k")),
                            t.supplier.select(F.col("s_nationkey").alias("k")))


@query("u1_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL "
                       "SELECT s_nationkey FROM supplier) s GROUP BY k")
def u1_union_all(t):
    both = relational.union(t.customer.select(F.col("c_nationkey").alias("k")),
                            t.supplier.select(F.col("s_nationkey").alias("k")), keep_all=True)
    return both.groupBy("k").agg(F.count("*").alias("n"))


@query("u2_intersect", "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier")
def u2_intersect(t):
    return relational.intersect(t.lineitem.select(F.col("l_suppkey").alias("k")),
                                t.supplier.select(F.col("s_suppkey").alias("k")))


@query("u2_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def u2_intersect_all(t):
    return relational.intersect(t.customer.select(F.col("c_nationkey").alias("k")),
                                t.supplier.select(F.col("s_nationkey").alias("k")), keep_all=True)


@query("u3_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders "
                   "WHERE o_totalprice > 250000")
def u3_except(t):
    return relational.except_(t.customer.select(F.col("c_custkey").alias("k")),
                              t.orders.filter("o_totalprice > 250000").select(F.col("o_custkey").alias("k")))


@query("u3_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def u3_except_all(t):
    return relational.except_(t.customer.select(F.col("c_nationkey").alias("k")),
                              t.supplier.select(F.col("s_nationkey").alias("k")), keep_all=True)


@query("u4_operand_check", "SELECT 'c' AS kind, c_custkey AS id FROM customer UNION ALL "
                           "SELECT 's', s_suppkey FROM supplier")
def u4_operand_check(t):
    a = t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"))
    b = t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"))
    try:
        relational.check_operands(a, b.withColumnRenamed("id", "other"))
    except relational.OperandError:
        return relational.union(a, b, keep_all=True)
    raise AssertionError("operands with different names were accepted")


@query("u5_set_limit", "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 40")
def u5_set_limit(t):
    both = relational.union(t.customer.select(F.col("c_custkey").alias("k")),
                            t.supplier.select(F.col("s_suppkey").alias("k")))
    return relational.set_limit(both, ["k"], 10, 40)


@query("u6_union_view", "SELECT 'image' AS kind, CAST(p_partkey AS VARCHAR) AS id, ra, dec, CAST(NULL AS DOUBLE) AS flux "
                        "FROM {sky_part} s UNION ALL SELECT 'source', CAST(c_custkey AS VARCHAR), ra, dec, c_acctbal "
                        "FROM {sky_a} s")
def u6_union_view(t):
    images = t.images.select(F.lit("image").alias("kind"), F.col("p_partkey").alias("id"), "ra", "dec")
    sources = t.sky_a.select(F.lit("source").alias("kind"), F.col("c_custkey").alias("id"), "ra", "dec",
                             F.col("c_acctbal").alias("flux"))
    return relational.union_view([images, sources], {"kind": "string", "id": "string", "ra": "double",
                                                     "dec": "double", "flux": "double"})
