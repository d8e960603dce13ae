"""Predicates from parameters and typed expressions."""

import datetime

from pyspark.sql import functions as F

from ..functions import times
from ..operators import filterexpr, intervals, predicates as p, rangelist
from ..operators.predicates import Condition, search_filter
from .registry import mjd_sql, query


@query("p15_typed_equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') "
                             "AND o_totalprice BETWEEN 10000 AND 90000 AND o_orderdate >= TIMESTAMP '1997-03-01'")
def p15_typed_equality(t):
    mjd = times.mjd_of_datetime(datetime.datetime(1997, 3, 1))
    tests = [p.equals_value("o_orderstatus", "O"), p.equals_value("o_orderpriority", ["1-URGENT", "2-HIGH"]),
             p.equals_value("o_totalprice", (10000, 90000), "interval"),
             p.equals_value("o_orderdate", (mjd, float("inf")), "mjd-interval"), p.equals_value("o_custkey", None)]
    return t.orders.filter(p.conjunction(tests)).select("o_orderkey")


@query("p16_constant_predicate", "SELECT c_custkey FROM customer WHERE 1 != 1")
def p16_constant_predicate(t):
    return t.customer.filter(p.on_constant("star", lambda v: v == "galaxy")).select("c_custkey")


@query("p16_constant_true", "SELECT c_custkey FROM customer")
def p16_constant_true(t):
    return t.customer.filter(p.on_constant("star", lambda v: v in ("galaxy", "star"))).select("c_custkey")


@query("p17_min_max", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_retailprice >= 950")
def p17_min_max(t):
    return t.part.filter(p.conjunction([p.between_open("p_size", 5, 9), p.between_open("p_retailprice", 950, None),
                                        p.between_open("p_partkey", None, None)])).select("p_partkey")


@query("p18_numeric_expression", "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size BETWEEN 20 AND 22 OR p_size IN (31, 33)) "
                                 "AND NOT p_retailprice BETWEEN 950 AND 1050 AND p_size * 1000 >= 2000")
def p18_numeric_expression(t):
    return t.part.filter(
        filterexpr.numeric_filter("p_size", "<5 | 20..22 | 31,33")
        & filterexpr.numeric_filter("p_retailprice", "! 1000 +/- 50")
        & filterexpr.numeric_filter(F.col("p_size") * 1000, ">= 2", scaling=1000.0)).select("p_partkey")


@query("p19_date_expression", "SELECT event_id FROM events WHERE (ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-05 23:59:59' "
                              "OR ts > TIMESTAMP '2024-01-28 23:59:59' OR ts BETWEEN TIMESTAMP '2024-01-10' AND "
                              "TIMESTAMP '2024-01-11 12:00:00' OR ts BETWEEN TIMESTAMP '2024-01-19 12:00:00' AND TIMESTAMP "
                              "'2024-01-20 12:00:00')")
def p19_date_expression(t):
    text = "2024-01-05 | > 2024-01-28 | 2024-01-10 .. 2024-01-11T12:00:00 | 2024-01-20 +/- 0.5"
    return t.events.filter(filterexpr.date_filter("ts", text)).select("event_id")


@query("p20_mjd_expression", f"SELECT event_id FROM events WHERE {mjd_sql('ts')} BETWEEN 60314.0 AND 60314.999988425924 "
                             f"OR {mjd_sql('ts')} < 60311.0")
def p20_mjd_expression(t):
    rows = t.events.select("event_id", times.mjd("ts").alias("mjd"))
    return rows.filter(filterexpr.mjd_filter("mjd", "2024-01-05 | < 2024-01-02")).select("event_id")


@query("p21_string_expression", "SELECT p_partkey FROM part WHERE p_name ILIKE 'red%' AND p_brand NOT IN ('Brand#1', 'Brand#2') AND "
                                "regexp_matches(p_type, '^[EM].*$') AND NOT regexp_matches(p_name, '^.*bolt$') AND p_brand != 'Brand#9' "
                                "AND p_type IN ('ECONOMY', 'MEDIUM')")
def p21_string_expression(t):
    f = filterexpr.string_filter
    return t.part.filter(f("p_name", "~ RED*") & f("p_brand", "!=,Brand#1,Brand#2") & f("p_type", "= [EM]*")
                         & f("p_name", "! *bolt") & f("p_brand", "!= Brand#9") & f("p_type", "=|ECONOMY|MEDIUM")).select("p_partkey")


@query("p21_string_equality", "SELECT p_partkey FROM part WHERE p_name = 'red bolt' OR lower(p_name) = 'hot gear' OR p_brand >= 'Brand#8'")
def p21_string_equality(t):
    f = filterexpr.string_filter
    return t.part.filter(f("p_name", "red bolt") | f("p_name", "=~ HOT gear") | f("p_brand", ">= Brand#8")).select("p_partkey")


@query("p22_range_list", "SELECT p_partkey FROM part WHERE (p_size <= 3 OR p_size IN (10, 13, 16, 19) OR p_size = 25 OR p_size >= 48) "
                         "AND p_retailprice BETWEEN 900 AND 1000")
def p22_range_list(t):
    return t.part.filter(rangelist.range_filter("p_size", "/3,10/20/3,25,48/", "int")
                         & rangelist.range_filter("p_retailprice", "900/1000", "float")).select("p_partkey")


@query("p22_discrete", "SELECT p_partkey FROM part WHERE p_size IN (0, 1, 2, 3, 4, 7)")
def p22_discrete(t):
    return t.part.filter(rangelist.range_filter("p_size", "0,1/9/3,1/3/1", "int")).select("p_partkey")


@query("p22_long_steps", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey BETWEEN 3 AND 300000003 "
                         "AND (l_orderkey - 3) % 1000 = 0) OR l_orderkey IN (1, 7)")
def p22_long_steps(t):
    return t.lineitem.filter(rangelist.range_filter("l_orderkey", "3/300000003/1000,1,7", "int")).select("l_orderkey", "l_linenumber")


@query("p23_date_range_list", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' OR o_orderdate IN "
                              "(TIMESTAMP '1996-01-01', TIMESTAMP '1996-01-08', TIMESTAMP '1996-01-15')")
def p23_date_range_list(t):
    text = "1998-06-01/,1996-01-01/1996-01-15/7"
    rows = t.orders.withColumns({"mjd": times.mjd("o_orderdate"), "jd": times.jd("o_orderdate")})
    by_stamp = rangelist.range_filter("o_orderdate", text, "date")
    by_mjd = rangelist.range_filter("mjd", text, "date", "mjd")
    by_jd = rangelist.range_filter("jd", text, "date", "jd")
    return rows.filter(by_stamp & by_mjd & by_jd).select("o_orderkey")


@query("p24_interval_overlap", "SELECT l_orderkey, l_linenumber FROM {intervals} i WHERE lo < 50100 AND hi > 50090")
def p24_interval_overlap(t):
    return t.intervals.filter(p.overlaps("lo", "hi", 50090, 50100)).select("l_orderkey", "l_linenumber")


@query("p25_value_in_interval", "SELECT l_orderkey, l_linenumber FROM {intervals} i WHERE 50400.25 BETWEEN lo AND hi")
def p25_value_in_interval(t):
    return t.intervals.filter(p.covers_value("lo", "hi", 50400.25)).select("l_orderkey", "l_linenumber")


@query("p26_any_interval", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 2000 OR o_totalprice >= 498000")
def p26_any_interval(t):
    return t.orders.filter(p.in_any_interval("o_totalprice", [(1000, 2000), (498000, float("inf"))])).select("o_orderkey")


@query("p27_any_of", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src4')")
def p27_any_of(t):
    return t.documents.filter(p.any_of("source", ["src1", "src4"])).select("doc_id")


@query("p28_nocase_equality", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'furniture')")
def p28_nocase_equality(t):
    return t.customer.filter(rangelist.caseless_filter("c_mktsegment", "Building,FURNITURE")).select("c_custkey")


@query("p29_shell_pattern", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'r.d [^a-m]') AND p_brand ILIKE '%RAND#1%'")
def p29_shell_pattern(t):
    return t.part.filter(p.shell_match("p_name", "r?d [!abcdefghijklm]*") & p.shell_match("p_brand", "*RAND\\#1*", nocase=True)).select(
        "p_partkey")


@query("p30_states", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def p30_states(t):
    states = t.orders.withColumn("pol_states", F.concat(F.lit("/I/"), "o_orderstatus", F.lit("/")))
    return states.filter(p.has_state("pol_states", ["O", "P"])).select("o_orderkey")


@query("p31_media_types", "SELECT count(*) FILTER (WHERE m = 'application/fits') AS fits, count(*) FILTER (WHERE m LIKE 'image/%') "
                          "AS graphic, count(*) FILTER (WHERE m IN ('application/fits', 'application/x-votable+xml')) AS compliant, "
                          "count(*) FILTER (WHERE m IN ('image/png', 'text/plain')) AS listed FROM (SELECT CASE user_id % 4 WHEN 0 THEN "
                          "'application/fits' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/x-votable+xml' ELSE 'text/plain' END AS m "
                          "FROM events) q")
def p31_media_types(t):
    kinds = ["application/fits", "image/png", "application/x-votable+xml", "text/plain"]
    mime = F.element_at(F.array(*map(F.lit, kinds)), (F.col("user_id") % 4 + 1).cast("int"))
    rows = t.events.select(mime.alias("mime"))
    return rows.agg(*(F.count_if(p.media_type("mime", wanted)).alias(name) for name, wanted in (
        ("fits", "fits"), ("graphic", "graphic"), ("compliant", "compliant"), ("listed", "image/png,text/plain"))))


@query("p32_band", "SELECT p_partkey, FALSE AS by_name FROM part WHERE p_size * 1e-7 < 3.05e-6 AND (p_size + 2) * 1e-7 > 2.95e-6 "
                   "UNION ALL SELECT p_partkey, TRUE FROM part WHERE p_type = 'PROMO'")
def p32_band(t):
    from ..plans.spectra import band_filter

    rows = t.part.withColumns({"lo": F.col("p_size") * 1e-7, "hi": (F.col("p_size") + 2) * 1e-7})
    numeric = rows.filter(band_filter("lo", "hi", "p_type", "2.95e-6/3.05e-6"))
    named = rows.filter(band_filter("lo", "hi", "p_type", "PROMO"))
    return numeric.select("p_partkey", F.lit(False).alias("by_name")).unionByName(
        named.select("p_partkey", F.lit(True).alias("by_name")))


@query("p33_combined", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '5-LOW') AND o_totalprice > 400000")
def p33_combined(t):
    either = Condition(lambda q: [p.equals_value("o_orderstatus", q["status"]), p.equals_value("o_orderpriority", q["prio"])],
                       "status", "prio", joiner="OR")
    price = Condition(lambda q: F.col("o_totalprice") > q["price"], "price", required=True)
    unused = Condition(lambda q: F.col("o_custkey") == q["customer"], "customer")
    params = {"status": "F", "prio": "5-LOW", "price": 400000}
    return t.orders.filter(search_filter([either, price, unused], params)).select("o_orderkey")


@query("p34_row_triggers", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (quality IS NULL OR "
                           "(lang = 'en' AND NOT coalesce(toxic = 1, FALSE)))")
def p34_row_triggers(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    trigger = p.trigger_or(p.key_null(rows, "quality"), p.key_is(rows, "no_such_key", "x"), p.trigger_and(
        p.key_is(rows, "lang", "en"), p.trigger_not(p.key_is(rows, "toxic", 1)), p.key_missing(rows, "absent")))
    return p.ignore_on(rows, trigger).select("doc_id")


@query("p35_embargo", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '3-MEDIUM' OR o_orderdate < TIMESTAMP '1997-01-01' OR "
                      "o_orderstatus IN ('F')")
def p35_embargo(t):
    embargo = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.to_date("o_orderdate"))
    return t.orders.withColumn("embargo", embargo).filter(
        p.visible_to("embargo", "o_orderstatus", ["F"], datetime.date(1997, 1, 1))).select("o_orderkey")


@query("p36_by_key", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def p36_by_key(t):
    return p.by_key(t.customer, {"c_custkey": 77}).select("c_custkey", "c_name")


@query("p37_delete", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(quality = 1, FALSE)")
def p37_delete(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return p.delete_matching(rows, F.col("quality") == 1).select("doc_id")


_SPANS = "(SELECT s_suppkey, 50000 + s_suppkey * 37 % 1500 AS lo, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 50000 + s_suppkey * 37 % 1500 + pow(2, s_suppkey % 12) END AS hi FROM supplier)"


@query("p26_interval_table", f"SELECT s_suppkey, count(*) AS n FROM orders JOIN {_SPANS} q ON {mjd_sql('o_orderdate')} >= lo AND ({mjd_sql('o_orderdate')} <= hi OR hi IS NULL) "
                             "GROUP BY s_suppkey")
def p26_interval_table(t):
    """Dates in intervals that are rows of a table: short, long, nested and open ones."""
    start = (50000 + F.col("s_suppkey") * 37 % 1500).cast("double")
    spans = t.supplier.select("s_suppkey", start.alias("lo"), F.when(F.col("s_suppkey") % 11 != 0, start + F.pow(F.lit(2.0), F.col("s_suppkey") % 12)).alias("hi"))
    dates = t.orders.select(times.mjd("o_orderdate").alias("mjd"))
    return intervals.match_intervals(dates, spans, "mjd", "lo", "hi", counted="held").groupBy("s_suppkey").agg(F.sum("held").alias("n"))
