"""Functions on columns."""

from pyspark.sql import functions as F

from ..functions import casts, formats, math as m, registry as ufuncs, stctext, text, times, units
from ..functions import sphere
from ..operators import wordindex
from ..schema import ColumnSpec, TableSpec
from ..session import scratch_path
from .. import sqlpack
from .registry import dist_sql, mjd_sql, query

R8 = 8


def _round(**columns):
    return [F.round(c, R8).alias(n) for n, c in columns.items()]


@query("f1_basic_math", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, "
                        "round(exp(c_acctbal / 5000), 8) AS e, round(sqrt(abs(c_acctbal)), 8) AS s, "
                        "round(pow(c_nationkey, 1.5), 8) AS p, c_custkey % 7 AS r, round(pi() * c_nationkey, 8) AS pn, "
                        "round(degrees(c_nationkey / 10), 8) AS dg, round(radians(c_acctbal), 8) AS rd FROM customer")
def f1_basic_math(t):
    bal, nat = F.col("c_acctbal"), F.col("c_nationkey")
    return t.customer.select(
        "c_custkey", F.abs(bal).alias("a"), F.ceil(bal).cast("double").alias("c"), F.floor(bal).cast("double").alias("f"),
        *_round(e=F.exp(bal / 5000), s=F.sqrt(F.abs(bal)), p=F.pow(nat, F.lit(1.5)), pn=F.pi() * nat,
                dg=F.degrees(nat / 10), rd=F.radians(bal)), (F.col("c_custkey") % 7).alias("r"))


@query("f2_trigonometry", "SELECT c_custkey, round(sin(x), 8) AS s, round(cos(x), 8) AS c, round(tan(x), 8) AS t, "
                          "round(1 / tan(x + 0.1), 6) AS ct, round(asin(x / 7), 8) AS a_s, round(acos(x / 7), 8) AS a_c, "
                          "round(atan(x), 8) AS a_t, round(atan2(x, 2), 8) AS a_2 FROM "
                          "(SELECT c_custkey, (c_custkey % 60) / 1e1 AS x FROM customer) q")
def f2_trigonometry(t):
    x = (F.col("c_custkey") % 60) / 10.0
    return t.customer.select(
        "c_custkey", *_round(s=F.sin(x), c=F.cos(x), t=F.tan(x), a_s=F.asin(x / 7), a_c=F.acos(x / 7), a_t=F.atan(x),
                             a_2=F.atan2(x, F.lit(2.0))), F.round(m.cot(x + 0.1), 6).alias("ct"))


@query("f3_logarithms", "SELECT o_orderkey, round(ln(o_totalprice), 8) AS l, round(log10(o_totalprice), 8) AS l10 FROM orders")
def f3_logarithms(t):
    return t.orders.select("o_orderkey", *_round(l=m.natural_log("o_totalprice"), l10=m.log10("o_totalprice")))


@query("f4_square", "SELECT s_suppkey, s_acctbal * s_acctbal AS sq FROM supplier")
def f4_square(t):
    return t.supplier.select("s_suppkey", m.square("s_acctbal").alias("sq"))


@query("f5_round", "SELECT o_orderkey, round_even(o_totalprice, 0) AS r0, round_even(o_totalprice * 10, 0) / 10 AS r1, "
                   "round_even(o_totalprice / 1000, 0) * 1000 AS rm3 FROM orders")
def f5_round(t):
    return t.orders.select("o_orderkey", m.round_places("o_totalprice").alias("r0"),
                           m.round_places("o_totalprice", 1).alias("r1"), m.round_places("o_totalprice", -3).alias("rm3"))


@query("f6_truncate", "SELECT c_custkey, sign(c_acctbal) * floor(abs(c_acctbal)) AS t0, "
                      "sign(c_acctbal) * (floor(abs(c_acctbal) * 10) / 10) AS t1, "
                      "sign(c_acctbal) * (floor(abs(c_acctbal) / 100) * 100) AS tm2 FROM customer")
def f6_truncate(t):
    return t.customer.select("c_custkey", m.truncate("c_acctbal").alias("t0"), m.truncate("c_acctbal", 1).alias("t1"),
                             m.truncate("c_acctbal", -2).alias("tm2"))


@query("f7_rand", "SELECT count(*) AS n, count(*) AS inside FROM customer")
def f7_rand(t):
    # the values are random; that every row has one in [0, 1) is not
    drawn = t.customer.select(m.random(7).alias("r"))
    return drawn.agg(F.count("*").alias("n"), F.count_if((F.col("r") >= 0) & (F.col("r") < 1)).alias("inside"))


_UNITS = TableSpec("lengths", (ColumnSpec("p_partkey", "bigint"), ColumnSpec("p_size", "int", unit="km"),
                               ColumnSpec("p_retailprice", "double", unit="arcsec/yr")))


@query("f8_in_unit", "SELECT p_partkey, round(p_size * 1000.0, 6) AS metres, round(p_retailprice / 3600, 9) AS pm FROM part")
def f8_in_unit(t):
    df = _UNITS.annotate(t.part.select("p_partkey", "p_size", "p_retailprice"))
    df = units.in_unit(df, "p_size", "m", "metres")
    df = units.in_unit(df, "p_retailprice", "deg/yr", "pm")
    return df.select("p_partkey", F.round("metres", 6).alias("metres"), F.round("pm", 9).alias("pm"))


@query("f9_harmonise", "SELECT p_partkey, round(p_size * 1000.0, 6) AS p_size, round(p_retailprice * 1000, 6) AS p_retailprice FROM part")
def f9_harmonise(t):
    df = _UNITS.annotate(t.part.select("p_partkey", "p_size", "p_retailprice"))
    df = units.harmonise(df, {"p_partkey": None, "p_size": "m", "p_retailprice": "mas/yr"})
    return df.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query("f10_scale", "SELECT d.doc_id, quality * 2.5 + 1 AS scaled FROM documents d LEFT JOIN labels l "
                    "ON d.doc_id = l.doc_id")
def f10_scale(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", m.scale("quality", 2.5, 1).alias("scaled"))


@query("f11_mean", "SELECT o_orderkey, o_totalprice + (c_acctbal - o_totalprice) / 2 AS mean, "
                   "o_orderdate + INTERVAL 6 HOUR AS halfway FROM orders JOIN customer ON o_custkey = c_custkey")
def f11_mean(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", m.mean("o_totalprice", "c_acctbal").alias("mean"), m.mean_timestamp(
        F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL '12' HOUR")).alias("halfway"))


@query("f12_proper_motion", "SELECT c_custkey, round(sqrt(a * a + d * d), 8) AS pm_total, "
                            "round(degrees(atan2(a, d)), 8) AS pm_posang FROM (SELECT c_custkey, c_acctbal / 1e3 AS a, "
                            "(c_nationkey - 12) / 1e1 AS d FROM customer) q")
def f12_proper_motion(t):
    a, d = F.col("c_acctbal") / 1e3, (F.col("c_nationkey") - 12) / 10.0
    return t.customer.select("c_custkey", *_round(pm_total=m.total_pm(a, d), pm_posang=m.pm_angle(a, d)))


@query("f13_spectral", "SELECT p_partkey, round(299792458.0 / (p_retailprice * 1e-9) / 1e9, 6) AS ghz, "
                       "round(299792458.0 / (p_retailprice * 1e-9) * 4.13566733e-15, 8) AS ev, "
                       "p_retailprice * (1e-9 / 1e-10) AS aa, CASE WHEN p_size = 0 THEN 1e7 ELSE 1 / (p_size / 1e3) END AS pc "
                       "FROM part")
def f13_spectral(t):
    lam = F.col("p_retailprice")
    return t.part.select(
        "p_partkey", F.round(units.spectral(lam, "nm", "GHz"), 6).alias("ghz"),
        F.round(units.spectral(lam, "nm", "eV"), 8).alias("ev"), units.spectral(lam, "nm", "Angstrom").alias("aa"),
        units.parallax_to_distance(F.col("p_size") / 1e3).alias("pc"))


@query("t1_concat", "SELECT p_partkey, p_brand || '/' || p_type AS label FROM part")
def t1_concat(t):
    return t.part.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("label"))


@query("t2_case", "SELECT doc_id, upper(lang) AS u, lower(source) AS l FROM documents")
def t2_case(t):
    return t.documents.select("doc_id", F.upper("lang").alias("u"), F.lower("source").alias("l"))


@query("t3_regex", "SELECT doc_id, CAST(regexp_matches(text, 'th[ae]+[a-z]*tion') AS INT) AS hit FROM documents")
def t3_regex(t):
    return t.documents.select("doc_id", text.matches("text", "th[ae]+[a-z]*tion").cast("int").alias("hit"))


@query("t4_has_word", "SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), "
                      "'[^a-z0-9_]+'), 'thble') AND list_contains(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), 'thtion')")
def t4_has_word(t):
    return t.documents.filter(text.has_words("text", "the thble of thtion", stemmed=False)).select("doc_id")


_ONTION = ("SELECT doc_id, lang FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: regexp_full_match(w, "
           "'ontion(e|es|s|ed|ing|ings|e?(able|ant|ate|ation|ator|er|ment|ou)(s|d|ed|ing)?|at(ed|ing)|ates)?'))) > 0")  # the forms of one stem


@query("t4_has_word_stemmed", _ONTION)
def t4_has_word_stemmed(t):
    return t.documents.filter(text.has_words("text", "ontions")).select("doc_id", "lang")


@query("t4_indexed", _ONTION)
def t4_indexed(t):
    path = scratch_path(t.spark, "words")
    wordindex.write_index(t.documents.select("doc_id", "text"), "doc_id", "text", path)
    found = wordindex.search_index(t.spark, path, "ontions").withColumnRenamed("key", "doc_id")
    return t.documents.select("doc_id", "lang").join(found, "doc_id")


@query("t5_nocase_like", "SELECT page_id FROM pages WHERE url ILIKE '%EXAMPLE.com%'")
def t5_nocase_like(t):
    return t.pages.filter(text.like_nocase("url", "%EXAMPLE.com%")).select("page_id")


@query("t6_hashlist", "SELECT o_orderkey, CAST(list_contains(string_split(lower(o_orderstatus) || '#' || "
                      "lower(o_orderpriority), '#'), '1-urgent') AS INT) AS hit FROM orders")
def t6_hashlist(t):
    joined = F.concat_ws("#", F.lower("o_orderstatus"), F.lower("o_orderpriority"))
    return t.orders.select("o_orderkey", text.hashlist_has(joined, "1-URGENT").cast("int").alias("hit"))


@query("t7_many_columns", "SELECT page_id FROM pages WHERE list_contains(regexp_split_to_array(lower(url || ' ' || html), "
                          "'[^a-z0-9_]+'), 'anre') AND list_contains(regexp_split_to_array(lower(url || ' ' || html), "
                          "'[^a-z0-9_]+'), 'com')")
def t7_many_columns(t):
    return t.pages.filter(text.has_words_in_any(["url", "html"], "anre com", stemmed=False)).select("page_id")


@query("t7_indexed", "SELECT page_id FROM pages WHERE list_contains(regexp_split_to_array(lower(url || ' ' || html), "
                          "'[^a-z0-9_]+'), 'anre') AND list_contains(regexp_split_to_array(lower(url || ' ' || html), "
                          "'[^a-z0-9_]+'), 'com')")
def t7_indexed(t):
    path = scratch_path(t.spark, "words")
    wordindex.write_index(t.pages, "page_id", ["url", "html"], path)
    return wordindex.search_index(t.spark, path, "anre com", stemmed=False).withColumnRenamed("key", "page_id")


@query("t8_remove_blanks", "SELECT p_partkey, replace(p_name, ' ', '') AS squeezed FROM part")
def t8_remove_blanks(t):
    return t.part.select("p_partkey", text.remove_blanks("p_name").alias("squeezed"))


@query("t9_parse_with_null", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#7' OR p_brand LIKE '%1' THEN -1 ELSE "
                             "CAST(regexp_extract(p_brand, '#(.*)', 1) AS BIGINT) END AS brand FROM part")
def t9_parse_with_null(t):
    parser = lambda c: casts.to_int(F.regexp_extract(c, "#(.*)", 1))
    return t.part.select("p_partkey", casts.parse_with_null(
        "p_brand", parser, "Brand#7", F.lit(-1).cast("bigint"), lambda c: c.like("%1")).alias("brand"))


@query("t10_path_key", "SELECT page_id, translate(to_base64(encode(url)), '+/', '$!') AS flat FROM pages")
def t10_path_key(t):
    return t.pages.select("page_id", text.path_key("url").alias("flat"))


@query("t11_tolerant_casts", "SELECT event_id, TRY_CAST(nullif(trim(regexp_extract(props, '[0-9]*')), '') AS BIGINT) AS none, "
                             "TRY_CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, TRY_CAST(regexp_extract(props, "
                             "'[0-9]+') AS DOUBLE) AS d, event_id % 2 = 1 AS odd FROM events")
def t11_tolerant_casts(t):
    number = F.regexp_extract("props", "[0-9]+", 0)
    return t.events.select(
        "event_id", casts.to_int(F.regexp_extract("props", "^[0-9]*", 0)).alias("none"), casts.to_int(number).alias("k"),
        casts.to_float(F.concat(F.lit("  "), number)).alias("d"),
        casts.to_bool(F.when(F.col("event_id") % 2 == 1, "Yes").otherwise("off")).alias("odd"))


@query("t12_percent_template", "SELECT c_custkey, string_split(c_name, '#')[1] AS a, string_split(c_name, '#')[2] AS b "
                               "FROM customer")
def t12_percent_template(t):
    return t.customer.select("c_custkey", text.percent_part("c_name", "%a#%b", "a").alias("a"),
                             text.percent_part("c_name", "%a#%b", "b").alias("b"))


@query("t13_bibcode", "SELECT o_orderkey, year(o_orderdate) % 2 = 0 AS is_code FROM orders")
def t13_bibcode(t):
    code = F.concat(F.year("o_orderdate").cast("string"), F.lit("A&A...123..456B"))
    code = F.when(F.year("o_orderdate") % 2 == 0, code).otherwise(F.concat(F.lit("x"), code))
    return t.orders.select("o_orderkey", F.col("o_orderdate").isNotNull() & text.is_bibcode(code).alias("is_code")) \
        .toDF("o_orderkey", "is_code")


@query("d1_mjd", f"SELECT event_id, round({mjd_sql('ts')}, 6) AS mjd FROM events")
def d1_mjd(t):
    return t.events.select("event_id", F.round(times.mjd("ts"), 6).alias("mjd"))


@query("d2_jd", f"SELECT event_id, round({mjd_sql('ts')} + 2400000.5, 3) AS jd FROM events")
def d2_jd(t):
    return t.events.select("event_id", F.round(times.jd("ts"), 3).alias("jd"))


@query("d3_years", f"SELECT o_orderkey, round(2000 + ({mjd_sql('o_orderdate')} - 51544.5) / 365.25, 8) AS jy, "
                   f"round(1900 + ({mjd_sql('o_orderdate')} + 2400000.5 - 2415020.31352) / 365.242198781, 8) AS by FROM orders")
def d3_years(t):
    return t.orders.select("o_orderkey", F.round(times.julian_year("o_orderdate"), 8).alias("jy"),
                           F.round(times.besselian_year("o_orderdate"), 8).alias("by"))


@query("d4_from_numbers", "SELECT o_orderkey, o_orderdate AS a, o_orderdate AS b, o_orderdate AS c, o_orderdate AS d FROM orders")
def d4_from_numbers(t):
    def second(ts):
        return F.date_trunc("second", ts + F.expr("INTERVAL '0.5' SECOND")).cast("timestamp_ntz")

    date = "o_orderdate"
    return t.orders.select(
        "o_orderkey", second(times.timestamp_of_mjd(times.mjd(date))).alias("a"),
        second(times.timestamp_of_jd(times.jd(date))).alias("b"),
        second(times.timestamp_of_julian_year(times.julian_year(date))).alias("c"),
        second(times.timestamp_of_besselian_year(times.besselian_year(date))).alias("d"))


@query("d5_any_to_mjd", f"SELECT o_orderkey, {mjd_sql('o_orderdate')} AS a, {mjd_sql('o_orderdate')} AS b, "
                        f"{mjd_sql('o_orderdate')} AS c FROM orders")
def d5_any_to_mjd(t):
    jd_or_mjd = F.when(F.col("o_orderkey") % 2 == 0, times.jd("o_orderdate")).otherwise(times.mjd("o_orderdate"))
    return t.orders.select(
        "o_orderkey", times.any_to_mjd(jd_or_mjd).alias("a"), times.any_to_mjd("o_orderdate", "timestamp").alias("b"),
        times.any_to_mjd(F.date_format("o_orderdate", "yyyyMMdd"), "string").alias("c"))


@query("d6_parse_timestamp", "SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) AS b FROM events")
def d6_parse_timestamp(t):
    by_pattern = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mixed = F.when(F.col("event_id") % 3 == 0, iso).otherwise(by_pattern)
    return t.events.select("event_id", times.parse_timestamp(mixed, "dd/MM/yyyy HH:mm:ss").alias("a"),
                           times.parse_timestamp(iso).alias("b"))


@query("d7_parse_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, '2000-01-01' AS b FROM orders")
def d7_parse_date(t):
    parsed = times.parse_date(F.date_format("o_orderdate", "dd.MM.yyyy"), "dd.MM.yyyy")
    return t.orders.select("o_orderkey", parsed.cast("string").alias("a"),
                           times.parse_date(F.lit("2000.0"), "!!jYear").cast("string").alias("b"))


@query("d8_parse_time", "SELECT event_id, event_id * 1.0 AS a, event_id * 1.0 AS b, (event_id % 40) * 3600.0 + 754 AS c FROM events")
def d8_parse_time(t):
    clock = F.format_string("%02d:12:34", F.col("event_id") % 40)
    seconds = F.col("event_id").cast("string")
    hours = (F.col("event_id") / 3600.0).cast("string")
    as_seconds = lambda i: (F.extract(F.lit("DAY"), i) * 86400 + F.extract(F.lit("HOUR"), i) * 3600
                            + F.extract(F.lit("MINUTE"), i) * 60 + F.extract(F.lit("SECOND"), i)).cast("double")
    return t.events.select(
        "event_id", as_seconds(times.parse_time(seconds, "!!secondsSinceMidnight")).alias("a"),
        F.round(times.time_seconds(hours, "!!decimalHours"), 4).alias("b"), times.time_seconds(clock).alias("c"))


@query("d9_make_timestamp", "SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 200000) AS ts FROM orders")
def d9_make_timestamp(t):
    offset = times.interval_of_seconds(F.col("o_orderkey") % 200000)
    return t.orders.select("o_orderkey", times.make_timestamp(F.to_date("o_orderdate"), offset).alias("ts"))


_LEAPS = ("(CASE WHEN d >= 51179 THEN 32 WHEN d >= 50630 THEN 31 WHEN d >= 50083 THEN 30 WHEN d >= 49534 THEN 29 "
          "ELSE 28 END)")
_TDB = ("(0.001658 * sin(radians(357.53 + 0.9856003 * (tt - 51544.5))) + 0.000014 * sin(2 * radians(357.53 + "
        "0.9856003 * (tt - 51544.5))))")


@query("d10_time_scales", f"SELECT o_orderkey, {_LEAPS} * 1.0 AS tai, round({_LEAPS} + 32.184, 6) AS tt, "
                          f"round({_LEAPS} + 32.184 + {_TDB}, 6) AS tdb, round({_LEAPS} + 32.184 + 6.969291e-10 * 86400 * "
                          f"(tt - 43144), 6) AS tcg, round({_LEAPS} + 32.184 + {_TDB} + 1.550505e-8 * 86400 * (tt - 43144), 6) "
                          f"AS tcb FROM (SELECT *, d + ({_LEAPS} + 32.184) / 86400 AS tt FROM (SELECT o_orderkey, "
                          f"{mjd_sql('o_orderdate')} AS d FROM orders) q) q")
def d10_time_scales(t):
    at = times.mjd("o_orderdate")
    return t.orders.select("o_orderkey", *(F.round(times.scale_offset(at, "UTC", s), 6).alias(s.lower())
                                           for s in ("TAI", "TT", "TDB", "TCG", "TCB")))


@query("d10_scale_timestamp", "SELECT o_orderkey, o_orderdate AS back FROM orders")
def d10_scale_timestamp(t):
    there = times.convert_scale_timestamp("o_orderdate", "UTC", "TT")
    return t.orders.select("o_orderkey", there.alias("tt")).select(
        "o_orderkey", times.convert_scale_timestamp("tt", "TT", "UTC").alias("back"))


@query("k7_significant", "SELECT o_orderkey, printf('%.1f', o_totalprice / 7.3) AS txt FROM orders")
def k7_significant(t):
    return t.orders.select("o_orderkey", formats.significant(F.col("o_totalprice") / 7.3, 1).alias("txt"))


@query("k8_hms", "SELECT c_custkey, lpad(CAST(CAST(floor(h) AS INT) AS VARCHAR), 2, '0') || ':' || "
                 "lpad(CAST(CAST(floor((h - floor(h)) * 60) AS INT) AS VARCHAR), 2, '0') AS hm, "
                 "round(((h - floor(h)) * 60 - floor((h - floor(h)) * 60)) * 60, 3) AS s FROM "
                 "(SELECT c_custkey, ra / 360 * 24 AS h FROM {sky_a} q) q")
def k8_hms(t):
    full = formats.hms("ra", ":", 3)
    return t.sky_a.select("c_custkey", F.substring(full, 1, 5).alias("hm"),
                          F.element_at(F.split(full, ":"), 3).cast("double").alias("s"))


@query("k9_dms", "SELECT c_custkey, CASE WHEN dec < 0 THEN '-' ELSE '+' END || CAST(CAST(floor(abs(dec)) AS INT) AS VARCHAR) "
                 "AS d, round((abs(dec) - floor(abs(dec))) * 3600, 2) AS arcsec FROM {sky_a} q")
def k9_dms(t):
    parts = F.split(formats.dms("dec", " ", 2), " ")
    return t.sky_a.select("c_custkey", F.get(parts, F.lit(0)).alias("d"), F.round(
        F.get(parts, F.lit(1)).cast("double") * 60 + F.get(parts, F.lit(2)).cast("double"), 2).alias("arcsec"))


@query("k10_display_unit", "SELECT p_partkey, printf('%.2f', p_size / 60.0) AS deg, '[' || printf('%.1f', p_size * 60.0) || "
                           "', N/A]' AS pair FROM part")
def k10_display_unit(t):
    pair = F.array(F.col("p_size").cast("double"), F.lit(None).cast("double"))
    return t.part.select("p_partkey", formats.display_unit("p_size", "arcmin", "deg").alias("deg"),
                         formats.display_unit_array(pair, "arcmin", "arcsec", 1).alias("pair"))


@query("k11_human_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS full_date, strftime(ts, '%Y-%m-%d') AS day, "
                          "strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def k11_human_dates(t):
    whole = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return t.events.select("event_id", formats.human_date("ts").alias("full_date"), formats.human_day("ts").alias("day"),
                           formats.human_date_of_number(times.mjd(whole), "mjd").alias("iso"))


@query("k12_by_unit", f"SELECT event_id, round({mjd_sql('ts')}, 6) AS mjd, round({mjd_sql('ts')} + 2400000.5, 3) AS jd, "
                      f"round(2000 + ({mjd_sql('ts')} - 51544.5) / 365.25, 8) AS jy, "
                      f"round(({mjd_sql('ts')} - 40587) * 86400, 1) AS s, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def k12_by_unit(t):
    return t.events.select(
        "event_id", F.round(times.in_unit("ts", "mjd"), 6).alias("mjd"), F.round(times.in_unit("ts", "d"), 3).alias("jd"),
        F.round(times.in_unit("ts", "yr"), 8).alias("jy"), F.round(times.in_unit("ts", "s"), 1).alias("s"),
        times.in_unit("ts", "").alias("iso"))


@query("k13_clock", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, lpad(CAST((event_id % 86400) // 3600 AS VARCHAR), 2, '0') "
                    "|| ':' || lpad(CAST((event_id % 3600) // 60 AS VARCHAR), 2, '0') || ':' || "
                    "lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS elapsed FROM events")
def k13_clock(t):
    whole = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return t.events.select("event_id", formats.clock_of_timestamp(whole).alias("clock"),
                           formats.clock(F.col("event_id")).alias("elapsed"))


@query("k14_byte_size", "SELECT doc_id, CASE WHEN n < 1e3 THEN CAST(n AS VARCHAR) || ' Bytes' WHEN n < 1e6 THEN "
                        "printf('%.1f', n / 1024) || 'kiB' WHEN n < 1e9 THEN printf('%.1f', n / 1024 / 1024) || 'MiB' "
                        "ELSE printf('%.1f', n / 1024 / 1024 / 1024) || 'GiB' END AS size FROM "
                        "(SELECT doc_id, n_chars * 1021 AS n FROM documents) q")
def k14_byte_size(t):
    return t.documents.select("doc_id", formats.byte_size(F.col("n_chars") * 1021).alias("size"))


@query("k15_stc_text", "SELECT c_custkey, 'Position ICRS ' || regexp_replace(printf('%.10f', ra), '\\.?0+$', '') || ' ' || "
                       "regexp_replace(printf('%.10f', dec), '\\.?0+$', '') AS stc FROM {sky_a} q")
def k15_stc_text(t):
    return t.sky_a.select("c_custkey", formats.stc_point(sphere.point("ra", "dec")).alias("stc"))


@query("k15_stc_shapes", "SELECT p_partkey, 'Circle ICRS ' || f(ra) || ' ' || f(dec) || ' ' || f(p_size / 1e1) AS circle, 'Polygon ICRS ' || f(ra - h) || ' ' || "
                         "f(dec - h) || ' ' || f(ra - h) || ' ' || f(dec + h) || ' ' || f(ra + h) || ' ' || f(dec + h) || ' ' || f(ra + h) || ' ' || f(dec - h) AS polygon, "
                         "'polygon' AS kind FROM (SELECT *, p_size / 2e1 AS h FROM {sky_part} s) q".replace("f(ra", "regexp_replace(printf('%.10f', ra").replace(
                             "f(dec", "regexp_replace(printf('%.10f', dec").replace("f(p_size", "regexp_replace(printf('%.10f', p_size").replace(
                             ") || ", "), '\\.?0+$', '') || ").replace(") AS ", "), '\\.?0+$', '') AS "))
def k15_stc_shapes(t):
    images = t.images
    circle = formats.stc_circle(F.struct("ra", "dec", F.col("size").alias("radius")))
    return images.select("p_partkey", circle.alias("circle"), formats.stc_polygon("coverage").alias("polygon"),
                         stctext.region_kind(formats.stc_polygon("coverage")).alias("kind"))


@query("k16_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS txt FROM pages")
def k16_strip_tags(t):
    return t.pages.select("page_id", formats.strip_tags("html").alias("txt"))


@query("k17_position_array", "SELECT c_custkey, ra AS x, dec AS y FROM {sky_a} q")
def k17_position_array(t):
    pair = formats.position_array(sphere.point("ra", "dec"))
    return t.sky_a.select("c_custkey", pair[0].alias("x"), pair[1].alias("y"))


@query("z1_sql_functions", f"SELECT c_custkey, round({dist_sql('ra', 'dec', '120.0', '10.0')}, 6) AS d, "
                           f"CAST({dist_sql('ra', 'dec', '120.0', '10.0')} <= 40 AS INT) AS inside FROM {{sky_a}} s")
def z1_sql_functions(t):
    sqlpack.install(t.spark)
    return t.spark.sql("SELECT c_custkey, round(sky_distance(ra, dec, 120D, 10D), 6) AS d, "
                       "sky_contains_circle(ra, dec, 120D, 10D, 40D) AS inside FROM {s}", s=t.sky_a)


@query("z1_sql_geometry", f"SELECT a.c_custkey, CAST({dist_sql('ra', 'dec', '100.0', '-20.0')} <= 40 AS INT) AS inside, round({dist_sql('ra', 'dec', '10.0', '80.0')}, 6) AS d, "
                          f"{dist_sql('ra', 'dec', '250.0', '40.0')} <= 12 + c_custkey % 5 AS met, "
                          f"CASE WHEN c_name ILIKE '%customer%' THEN 1 ELSE 0 END AS named FROM {{sky_a}} a")
def z1_sql_geometry(t):
    """Shapes, tests and word search as SQL text."""
    sqlpack.install(t.spark)
    return t.spark.sql("""SELECT c_custkey, sky_contains(point('ICRS', ra, dec), circle('ICRS', 100D, -20D, 40D)) AS inside,
        round(distance(point('ICRS', ra, dec), point('ICRS', 10D, 80D)), 6) AS d,
        intersects(circle('ICRS', ra, dec, CAST(c_custkey % 5 AS DOUBLE)), circle('ICRS', 250D, 40D, 12D)) = 1 AS met,
        CAST(hasword(replace(c_name, '#', ' '), 'customers') AS INT) AS named FROM {s}""", s=t.sky_a)


@query("z1_registry", f"SELECT event_id, round({mjd_sql('ts')}, 6) AS mjd FROM events")
def z1_registry(t):
    sqlpack.install(t.spark)
    return t.events.select("event_id", F.round(ufuncs.user_function("to_mjd")(F.col("ts")), 6).alias("mjd"))


@query("z2_predicate_form", "SELECT p_partkey FROM part WHERE p_name ILIKE '%WIDGET%'")
def z2_predicate_form(t):
    return t.part.filter(ufuncs.user_function("nocasematch")(F.col("p_name"), "%WIDGET%")).select("p_partkey")


@query("z3_aggregate", "SELECT l_orderkey, string_agg(l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def z3_aggregate(t):
    return t.spark.sql("SELECT l_orderkey, listagg(l_returnflag, '|') WITHIN GROUP (ORDER BY l_returnflag) AS flags "
                       "FROM {li} GROUP BY l_orderkey", li=t.lineitem)


@query("z4_generator", "SELECT event_id, unnest(range(0, event_id % 4)) AS ind FROM events")
def z4_generator(t):
    sqlpack.install_generators(t.spark)
    return t.spark.sql("SELECT event_id, g.ind FROM {e}, LATERAL index_rows(event_id % 4) g", e=t.events)


@query("z5_row_procedure", "SELECT c_custkey, c_acctbal * 3 + 7 AS scaled FROM customer")
def z5_row_procedure(t):
    def scale_column(df, source, dest, factor, offset=0.0):
        return df.withColumn(dest, m.scale(source, factor, offset))

    return t.customer.transform(scale_column, "c_acctbal", "scaled", 3.0, offset=7.0).select("c_custkey", "scaled")


@query("z6_phrase_maker", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_brand IN ('Brand#1', 'Brand#2')")
def z6_phrase_maker(t):
    from ..operators.predicates import Condition, any_of, between_open, search_filter

    conditions = [Condition(lambda p: between_open("p_size", p["size_min"], p["size_max"]), "size_min", "size_max"),
                  Condition(lambda p: any_of("p_brand", p["brand"]), "brand"),
                  Condition(lambda p: any_of("p_type", p["type"]), "type")]
    params = {"size_min": 10, "size_max": 12, "brand": ["Brand#1", "Brand#2"]}
    return t.part.filter(search_filter(conditions, params)).select("p_partkey")


@query("z7_free_computation", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS norm2 "
                              "FROM embeddings")
def z7_free_computation(t):
    def norms(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            total = [float(np.dot(v.astype("f8"), v.astype("f8"))) for v in batch["embedding"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "norm2": np.round(total, 5)})

    return t.embeddings.select("vec_id", "embedding").mapInPandas(norms, "vec_id bigint, norm2 double")


@query("z8_region_makers", f"SELECT c_custkey FROM {{sky_a}} s WHERE {dist_sql('ra', 'dec', '200.0', '-20.0')} <= 15")
def z8_region_makers(t):
    from ..functions import regions

    def around(word):
        if word.startswith("around "):
            ra, dec, radius = map(float, word.split()[1:])
            return regions.Shape("circle", (ra, dec, radius), "ICRS")
        return None

    makers = [around, *stctext.REGION_MAKERS]
    region = next(r for r in (maker("around 200 -20 15") for maker in makers) if r is not None)
    return t.sky_a.filter(region.contains_point("ra", "dec")).select("c_custkey")
