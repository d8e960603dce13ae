"""Aggregation, summaries, windows."""

from pyspark.sql import functions as F

from ..operators import keys, limits, stats
from ..operators.skew import number_rows
from ..plans import spectra as sp
from .registry import query


@query("a1_count", "SELECT count(*) AS n, count(quality) AS n_quality FROM documents d LEFT JOIN labels l "
                   "ON d.doc_id = l.doc_id")
def a1_count(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").agg(
        F.count("*").alias("n"), F.count("quality").alias("n_quality"))


@query("a2_aggregates", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, "
                        "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_tax), 6) AS avg_tax, "
                        "min(l_shipdate) AS first_ship, max(l_extendedprice) AS top, count(DISTINCT l_suppkey) AS suppliers, "
                        "CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS line_sum FROM lineitem "
                        "GROUP BY l_returnflag, l_linestatus")
def a2_aggregates(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_tax"), 6).alias("avg_tax"), F.min("l_shipdate").alias("first_ship"),
        F.max("l_extendedprice").alias("top"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.sum_distinct("l_linenumber").alias("line_sum"))


@query("a3_group_by", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def a3_group_by(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("a4_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders "
                    "GROUP BY o_custkey HAVING count(*) > 14")
def a4_having(t):
    return t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n > 14")


@query("a5_string_agg", "SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ', ' ORDER BY l_extendedprice, l_partkey) AS flags, "
                        "count(*) AS n FROM lineitem GROUP BY l_orderkey")
def a5_string_agg(t):
    flags = F.concat("l_returnflag", "l_linestatus")
    rows = t.lineitem.withColumn("place", F.struct("l_extendedprice", "l_partkey"))
    return rows.groupBy("l_orderkey").agg(stats.string_agg(flags, ", ", order="place").alias("flags"), F.count("*").alias("n"))


def _stats_sql(column: str, numeric: bool, table: str) -> str:
    mean = f"avg({column})" if numeric else "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{column}' AS column_name, CAST(min({column}) AS VARCHAR) AS min_value, "
            f"CAST(max({column}) AS VARCHAR) AS max_value, round({mean}, 6) AS mean_value, "
            f"bool_or({column} IS NULL) AS has_nulls FROM {table}")


@query("a6_column_stats", " UNION ALL ".join(
    _stats_sql(c, n, "(SELECT d.doc_id, lang, n_chars, quality FROM documents d LEFT JOIN labels l "
                     "ON d.doc_id = l.doc_id) q")
    for c, n in (("doc_id", True), ("lang", False), ("n_chars", True), ("quality", True))))
def a6_column_stats(t):
    df = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return stats.column_stats(df).withColumn("mean_value", F.round("mean_value", 6))


@query("a7_options", "SELECT DISTINCT source FROM documents")
def a7_options(t):
    return stats.options(t.documents, "source")


@query("a8_result_summary", "SELECT o_custkey, first_order, lo, hi, status, array_to_string(types, ',') AS types FROM ("
                            "SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS first_order, min(o_orderdate) AS lo, "
                            "max(o_orderdate) AS hi, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') "
                            "AS status, list_sort(list_distinct(list(o_orderpriority))) AS types FROM orders "
                            "GROUP BY o_custkey) q")
def a8_result_summary(t):
    return t.orders.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", "o_orderkey").alias("first_order"), F.min("o_orderdate").alias("lo"),
        F.max("o_orderdate").alias("hi"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("status"),
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("types"))


@query("a8_search_summary", "SELECT min_by(l_orderkey, l_extendedprice * 1e7 + l_orderkey) AS l_orderkey, "
                            "min(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, "
                            "array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS l_returnflag, "
                            "array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS l_linestatus "
                            "FROM lineitem WHERE l_tax > 0.02")
def a8_search_summary(t):
    found = t.lineitem.filter("l_tax > 0.02").withColumn(
        "place", F.col("l_extendedprice") * 1e7 + F.col("l_orderkey"))
    row = stats.result_summary(found, ["l_orderkey"], "place", "l_quantity", "l_extendedprice", "l_returnflag",
                               "l_linestatus")
    return row.withColumns({c: F.array_join(c, ",") for c in ("l_returnflag", "l_linestatus")})


@query("a9_targets", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def a9_targets(t):
    return stats.options(t.events.filter("event_type = 'purchase'"), "user_id")


@query("a10_group_fragment", "SELECT DISTINCT n FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) q")
def a10_group_fragment(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")).select("n").distinct()


@query("a11_counts_per_subject", "SELECT lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id "
                                 "WHERE toxic = 0 GROUP BY lang")
def a11_counts_per_subject(t):
    return t.documents.select("doc_id", "lang").join(t.labels.filter("toxic = 0"), "doc_id").groupBy("lang").agg(
        F.count("*").alias("n"))


@query("a12_chunked", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position "
                      "FROM events")
def a12_chunked(t):
    return stats.chunked(t.events.select("user_id", "event_id"), "user_id", "event_id")


@query("a12_chunk_blocks", "SELECT user_id, block, string_agg(event_type, ',' ORDER BY event_id) AS items FROM ("
                           "SELECT user_id, event_id, event_type, CAST(floor((row_number() OVER (PARTITION BY user_id "
                           "ORDER BY event_id) - 1) / 10) AS BIGINT) AS block FROM events) q GROUP BY 1, 2")
def a12_chunk_blocks(t):
    blocks = stats.chunk_blocks(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id",
                                "event_type", block=10)
    return blocks.withColumn("items", F.array_join("items", ","))


@query("a13_matched", "SELECT count(*) AS matched, 'OK' AS status FROM orders WHERE o_totalprice > 499000")
def a13_matched(t):
    return limits.overflow(t.orders.filter("o_totalprice > 499000"), 20_000)


@query("w1_normalise_flux", "SELECT spectrum_id, spectral, flux / max(flux) OVER (PARTITION BY spectrum_id) AS flux, "
                            "error / max(flux) OVER (PARTITION BY spectrum_id) AS error FROM {spectra} s")
def w1_normalise_flux(t):
    return sp.normalise_flux(t.spectra, "spectrum_id", "flux", "error")


@query("w2_first_writer", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER "
                          "(PARTITION BY user_id ORDER BY event_id) AS r FROM {keyed} k) q WHERE r = 1")
def w2_first_writer(t):
    return keys.first_by_key(t.keyed, ["user_id"], "event_id")


@query("w2_last_writer", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER "
                         "(PARTITION BY user_id ORDER BY event_id DESC) AS r FROM {keyed} k) q WHERE r = 1")
def w2_last_writer(t):
    return keys.last_by_key(t.keyed, ["user_id"], "event_id")


@query("w3_row_counter", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS rec_no FROM events "
                         "WHERE event_type = 'click'")
def w3_row_counter(t):
    return number_rows(t.events.filter("event_type = 'click'").select("event_id"), "event_id", "rec_no")


@query("w1_without_key", "SELECT k, l_linenumber, l_extendedprice / max(l_extendedprice) OVER (PARTITION BY k) AS flux FROM "
                         "(SELECT CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey END AS k, l_linenumber, l_extendedprice FROM lineitem)")
def w1_without_key(t):
    key = F.when(F.col("l_orderkey") % 3 > 0, F.col("l_orderkey"))
    rows = t.lineitem.select(key.alias("k"), "l_linenumber", F.col("l_extendedprice").alias("flux"))
    return sp.normalise_flux(rows, "k", "flux", huge=True)


@query("w2_without_order", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
                           "ORDER BY o DESC NULLS LAST, event_id) AS r FROM (SELECT *, CASE WHEN event_type = 'click' THEN event_id "
                           "END AS o FROM events)) WHERE r = 1 AND o IS NOT NULL")
def w2_without_order(t):
    order = F.when(F.col("event_type") == "click", F.col("event_id"))
    rows = t.events.select("user_id", "event_id", "event_type", order.alias("o"))
    return keys.last_by_key(rows, ["user_id"], "o").filter("o IS NOT NULL").select("user_id", "event_id", "event_type")


@query("w3_text_order", "SELECT c_name, row_number() OVER (ORDER BY CASE WHEN c_custkey > 3 THEN c_name END NULLS LAST, c_name) AS n "
                        "FROM customer WHERE c_custkey > 2")
def w3_text_order(t):
    """Numbers by a text that one row lacks."""
    name = F.when(F.col("c_custkey") > 3, F.col("c_name"))
    rows = t.customer.filter("c_custkey > 2").select("c_name", name.alias("o"))
    return number_rows(rows, "o", "n").select("c_name", "n")
