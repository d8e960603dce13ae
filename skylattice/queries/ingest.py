"""From raw rows to tables, key policies."""

from pyspark.sql import functions as F

from ..functions import times
from ..operators import expand, keys, lookups, mapping, predicates  # noqa: F401
from ..operators.mapping import RowMaker
from ..schema import ColumnSpec, TableSpec, structure_differences
from ..session import scratch_path
from ..sinks import layout, tables as sinks
from .registry import mjd_sql, query

RAW_SPEC = TableSpec("typed", (
    ColumnSpec("event_id", "bigint", required=True), ColumnSpec("when_", "timestamp_ntz"),
    ColumnSpec("amount", "float", unit="mag"), ColumnSpec("flag", "boolean"), ColumnSpec("kind", "string"),
    ColumnSpec("level", "int", default=7), ColumnSpec("doubled", "double"), ColumnSpec("absent", "string")))


def _raw_events(t):
    """Events as strings, the way text files bring them."""
    return t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"),
        F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("value").cast("string")).alias("val"),
        F.when(F.col("event_id") % 2 == 0, "On").otherwise("no").alias("flag"),
        F.when(F.col("event_type") == "view", "-").otherwise(F.col("event_type")).alias("kind"))


@query("i1_typed_maps", "SELECT event_id, date_trunc('second', ts) AS when_, CASE WHEN event_id % 5 = 0 THEN NULL ELSE "
                        "value::FLOAT::DOUBLE END AS amount, event_id % 2 = 0 AS flag FROM events")
def i1_typed_maps(t):
    maker = RowMaker(RAW_SPEC, simple="event_id:event_id when_:stamp amount:val flag:flag", strict=True)
    made = maker(_raw_events(t)).select("event_id", "when_", "amount", "flag")
    return made.withColumn("amount", F.col("amount").cast("double"))


@query("i2_expression_maps", "SELECT event_id, value * 2 AS doubled FROM events")
def i2_expression_maps(t):
    maker = RowMaker(RAW_SPEC, simple="event_id", expressions={"doubled": "value * 2"})
    return maker(t.events).select("event_id", "doubled")


@query("i3_identity_maps", "SELECT event_id, event_id % 2 = 0 AS flag, upper(CASE event_type WHEN 'view' THEN '-' ELSE event_type END) "
                           "AS kind FROM events")
def i3_identity_maps(t):
    maker = RowMaker(RAW_SPEC, id_maps=["e*", "flag", "kind"], expressions={"kind": "upper(kind)"})
    return maker(_raw_events(t)).select("event_id", "flag", "kind")


@query("i4_short_maps", "SELECT event_id, CAST(NULL AS VARCHAR) IS NULL AS no_key FROM events")
def i4_short_maps(t):
    maker = RowMaker(RAW_SPEC, simple="event_id:event_id, absent:@no_such_key")
    return maker(_raw_events(t)).select("event_id", F.col("absent").isNull().alias("no_key"))


@query("i5_null_on_value", "SELECT event_id, nullif(event_type, 'view') AS kind FROM events")
def i5_null_on_value(t):
    maker = RowMaker(RAW_SPEC, simple="event_id kind", null_literals={"kind": ["-", "n/a"]})
    return maker(_raw_events(t)).select("event_id", "kind")


@query("i6_variables_procedures", "SELECT event_id, (value + 1) * 10 AS doubled FROM events")
def i6_variables_procedures(t):
    maker = RowMaker(RAW_SPEC, simple="event_id doubled:scaled", variables={"shifted": "value + 1", "twice": "shifted * 2"},
                     procedures=[lambda df: df.withColumn("scaled", F.col("twice") * 5)])
    return maker(t.events).select("event_id", "doubled")


@query("i7_defaults", "SELECT event_id, 7 AS level FROM events")
def i7_defaults(t):
    maker = RowMaker(RAW_SPEC, simple="event_id level:@level")
    return maker(_raw_events(t)).select("event_id", "level")


@query("i8_ignore_on", "SELECT event_id FROM events WHERE event_type != 'view' AND event_id % 2 = 1")
def i8_ignore_on(t):
    raw = predicates.ignore_on(_raw_events(t), F.col("kind") == "-")
    maker = RowMaker(RAW_SPEC, simple="event_id", ignore=lambda df: predicates.key_is(df, "flag", "On"))
    return maker(raw).select("event_id")


@query("i9_expand_integers", "SELECT o_orderkey, unnest(range(o_orderkey % 3, o_orderkey % 5 + 1)) AS ind FROM orders WHERE o_orderstatus != 'P' "
                             "UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus = 'P'")
def i9_expand_integers(t):
    low = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise((F.col("o_orderkey") % 3).cast("string"))
    rows = t.orders.select("o_orderkey", low.alias("first"), (F.col("o_orderkey") % 5).alias("last"))
    return expand.expand_integers(rows, "first", "last", "ind").select("o_orderkey", "ind")


@query("i10_expand_dates", "SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + to_days(CAST(o_orderkey % 3 AS INT)) + INTERVAL 23 HOUR, "
                           "INTERVAL 12 HOUR)) AS cur_time FROM orders")
def i10_expand_dates(t):
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = t.orders.select("o_orderkey", start.alias("a"), F.date_format(
        F.date_add("o_orderdate", (F.col("o_orderkey") % 3).cast("int")), "yyyy-MM-dd").alias("b"))
    return expand.expand_dates(rows, "a", "b", hours=12.0).select("o_orderkey", "cur_time")


@query("i10_long_range", "SELECT r_regionkey, count(*) AS n, min(t) AS first_time, max(t) AS last_time FROM (SELECT r_regionkey, unnest("
                         "generate_series(TIMESTAMP '2000-01-01' + to_days(r_regionkey), TIMESTAMP '2020-01-01 23:00:00', INTERVAL 1 HOUR)) "
                         "AS t FROM region) GROUP BY 1")
def i10_long_range(t):
    start = F.date_format(F.date_add(F.lit("2000-01-01"), F.col("r_regionkey")), "yyyy-MM-dd")
    rows = expand.expand_dates(t.region.select("r_regionkey", start.alias("a"), F.lit("2020-01-01").alias("b")), "a", "b", hours=1.0)
    return rows.groupBy("r_regionkey").agg(F.count("*").alias("n"), F.min("cur_time").alias("first_time"), F.max("cur_time").alias("last_time"))


@query("i11_expand_comma", "SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 4 = 0 THEN []::VARCHAR[] ELSE [o_orderstatus, o_orderpriority] END) AS item "
                           "FROM orders")
def i11_expand_comma(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, " , ,").otherwise(F.concat_ws(" , ", "o_orderstatus", F.lit(""), "o_orderpriority"))
    return expand.expand_comma(t.orders.select("o_orderkey", text.alias("list")), "list", "item").select("o_orderkey", "item")


@query("i12_fan_out", "SELECT event_type AS sink, count(*) AS n FROM events GROUP BY event_type")
def i12_fan_out(t):
    roles = ["signup", "view", "click", "error", "purchase"]
    sinks_ = mapping.fan_out(t.events.withColumnRenamed("event_type", "role"), "role", {r: (lambda df: df) for r in roles})
    counted = [df.agg(F.count("*").alias("n")).withColumn("sink", F.lit(r)) for r, df in sinks_.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out.filter("n > 0")


_VALID = TableSpec("valid", (ColumnSpec("p_partkey", "bigint", required=True), ColumnSpec("p_size", "int", minimum=10, maximum=15),
                             ColumnSpec("p_type", "string", options=("ECONOMY", "PROMO", "LARGE"), required=True)))


@query("i13_validate", "SELECT p_partkey, CAST((p_size < 10)::INT + (p_size > 15)::INT + (p_type NOT IN ('ECONOMY', 'PROMO', 'LARGE'))::INT AS INT) AS n "
                       "FROM part WHERE p_size < 10 OR p_size > 15 OR p_type NOT IN ('ECONOMY', 'PROMO', 'LARGE')")
def i13_validate(t):
    _, rejected = keys.validate(t.part.select("p_partkey", "p_size", "p_type"), _VALID)
    return rejected.select("p_partkey", F.size("violations").alias("n"))


@query("i13_good_rows", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 15 AND p_type IN ('ECONOMY', 'PROMO', 'LARGE')")
def i13_good_rows(t):
    good, _ = keys.validate(t.part.select("p_partkey", "p_size", "p_type"), _VALID)
    return good.select("p_partkey")


@query("i14_source_rollback", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 200)")
def i14_source_rollback(t):
    return keys.without_bad_sources(t.events, F.col("value") > 200, "user_id").select("event_id")


@query("i15_conflicts", "SELECT user_id, count(*) AS rows FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def i15_conflicts(t):
    return keys.key_conflicts(t.events.select("user_id", "event_type"), ["user_id"])


@query("i15_check_policy", "SELECT c_custkey, c_name, c_custkey AS seq FROM customer")
def i15_check_policy(t):
    rows = t.customer.select("c_custkey", "c_name", F.col("c_custkey").alias("seq"))
    # the same rows once more, with a NULL that does not count as a difference
    again = rows.withColumns({"c_name": F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), "seq": F.col("seq") + 1000000})
    return keys.merge(rows, again, ["c_custkey"], "seq", "check")


_HALVES = ("WITH stored AS (SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r "
           "FROM events WHERE event_type = 'signup') q WHERE r = 1), fresh AS (SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER "
           "(PARTITION BY user_id ORDER BY event_id {dir}) AS r FROM events WHERE event_type = 'error' AND value > 20) q WHERE r = 1) ")


def _stored_and_new(t):
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    stored = keys.first_by_key(rows.filter("event_type = 'signup'").drop("value"), ["user_id"], "event_id")
    return stored, rows.filter("event_type = 'error' AND value > 20").drop("value")


@query("i16_drop_policy", _HALVES.replace("{dir}", "ASC") + "SELECT * FROM stored UNION ALL SELECT * FROM fresh WHERE user_id NOT IN "
                          "(SELECT user_id FROM stored)")
def i16_drop_policy(t):
    return keys.merge(*_stored_and_new(t), ["user_id"], "event_id", "drop")


@query("i17_overwrite_policy", _HALVES.replace("{dir}", "DESC") + "SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE user_id NOT IN "
                               "(SELECT user_id FROM fresh)")
def i17_overwrite_policy(t):
    return keys.merge(*_stored_and_new(t), ["user_id"], "event_id", "overwrite")


@query("i18_drop_old_policy", _HALVES.replace("{dir}", "DESC") + "SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE user_id NOT IN "
                              "(SELECT user_id FROM fresh)")
def i18_drop_old_policy(t):
    return keys.merge(*_stored_and_new(t), ["user_id"], "event_id", "dropOld")


@query("i19_replace_sources", "SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source, -1 "
                              "FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def i19_replace_sources(t):
    stored = t.documents.select("doc_id", "source", "n_chars")
    fresh = t.documents.filter("source IN ('src1', 'src2') AND lang = 'en'").select("doc_id", "source", F.lit(-1).cast("bigint").alias("n_chars"))
    return keys.replace_sources(stored, fresh, "source")


@query("i19_dynamic_overwrite", "SELECT doc_id, source FROM documents WHERE source != 'src1' UNION ALL SELECT doc_id, source FROM documents WHERE "
                                "source = 'src1' AND lang = 'en'")
def i19_dynamic_overwrite(t):
    path = scratch_path(t.spark, "by_source")
    sinks.write_replacing_sources(t.documents.select("doc_id", "source"), path, "source")
    fresh = t.documents.filter("source = 'src1' AND lang = 'en'").select("doc_id", "source")
    sinks.write_replacing_sources(fresh, path, "source")
    return t.spark.read.parquet(path).select("doc_id", F.col("source").cast("string").alias("source"))


@query("i20_tombstones", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN (CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2020-01-01' ELSE "
                         "TIMESTAMP '2024-06-01' END) ELSE TIMESTAMP '2021-01-01' END AS stamp, c_mktsegment = 'BUILDING' AS deleted FROM customer")
def i20_tombstones(t):
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    # one market segment is gone; its customers in debt were marked deleted before
    before = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0)
    old = t.customer.select("c_custkey", stamp("2020-01-01").alias("stamp"), before.alias("deleted"))
    new = t.customer.filter("c_mktsegment != 'BUILDING'").select("c_custkey", stamp("2021-01-01").alias("stamp"))
    return keys.mark_deleted(old, new, ["c_custkey"], "stamp", "deleted", stamp("2024-06-01"))


@query("i21_fix_up", "SELECT s_suppkey, 'S-' || s_name AS s_name FROM supplier")
def i21_fix_up(t):
    return mapping.fix_up(t.supplier.select("s_suppkey", "s_name"), {"s_name": "concat('S-', s_name)"})


@query("i22_row_filters", "SELECT o_orderkey, ind FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 4 + 1)) AS ind FROM orders) q WHERE ind % 2 = 1")
def i22_row_filters(t):
    return expand.row_filters(
        t.orders.select("o_orderkey", F.lit(0).alias("a"), (F.col("o_orderkey") % 4).alias("b")),
        lambda df: expand.expand_integers(df, "a", "b", "ind"), lambda df: df.filter("ind % 2 = 1")).select("o_orderkey", "ind")


@query("i23_structure", "SELECT 'c_name: type string, declared int' AS problem, count(*) AS n FROM customer UNION ALL SELECT "
                        "'c_acctbal: not declared', count(*) FROM customer")
def i23_structure(t):
    spec = TableSpec("c", (ColumnSpec("c_custkey", "bigint"), ColumnSpec("c_name", "int")))
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    problems = F.explode(F.array(*map(F.lit, structure_differences(rows, spec)))).alias("problem")
    return rows.select(problems).groupBy("problem").agg(F.count("*").alias("n"))


@query("i24_sky_clustering", "SELECT count(*) AS rows, TRUE AS sorted FROM {sky_a} s")
def i24_sky_clustering(t):
    path = scratch_path(t.spark, "clustered")
    sinks.sky_clustered(t.sky_a.select("c_custkey", "ra", "dec"), order=4, partitions=4).write.parquet(path)
    laid = t.spark.read.parquet(path)
    # files hold disjoint ranges of cells, so the cells of a file span at most the count of distinct ones it has
    spans = laid.groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.count("*").alias("n"), F.min("hpx").alias("a"), F.max("hpx").alias("b"))
    total = laid.agg((F.max("hpx") - F.min("hpx")).alias("whole"))
    return spans.crossJoin(total).agg(F.sum("n").alias("rows"), (F.sum(F.col("b") - F.col("a")) <= F.max("whole")).alias("sorted"))


@query("i24_curve_layout", f"SELECT o_orderkey FROM (SELECT *, o_custkey * 7919 % 36000 / 1e2 AS ra FROM orders) q WHERE ra BETWEEN 100 AND 120 AND "
                           f"{mjd_sql('o_orderdate')} BETWEEN 50000 AND 50200")
def i24_curve_layout(t):
    """Rows laid out along a curve through position, time and price, searched by two of the three."""
    path = scratch_path(t.spark, "layout")
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") * 7919 % 36000 / 100.0).alias("ra"), times.mjd("o_orderdate").alias("t"), "o_totalprice")
    layout.write_layout(rows, path, ["ra", "t", "o_totalprice"], files=27)
    return layout.read_layout(t.spark, path, {"ra": (100.0, 120.0), "t": (50000.0, 50200.0)}).select("o_orderkey")


@query("i25_split_names", "SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS author FROM orders")
def i25_split_names(t):
    authors = F.concat_ws("; ", "o_orderstatus", "o_orderpriority", F.lit("et al."))
    return expand.split_names(t.orders.select("o_orderkey", authors.alias("authors")), "authors", "author").select("o_orderkey", "author")


@query("i26_unpivot_unique", "SELECT DISTINCT value FROM (SELECT o_orderstatus AS value FROM orders UNION ALL SELECT o_orderpriority FROM orders "
                             "UNION ALL SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey % 2 = 0)")
def i26_unpivot_unique(t):
    rows = t.orders.withColumn("several", F.array(F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")), F.lit(1)))
    return expand.unpivot_unique(rows, ["o_orderstatus", "o_orderpriority", "several"])
