"""Typed expressions and range lists, checked on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from skylattice.operators import filterexpr as fx
from skylattice.operators import predicates as p
from skylattice.operators import rangelist as rl
from skylattice.operators.predicates import Condition


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(float(i),) for i in range(-5, 31)] + [(None,)], "v double").cache()


def hits(df, test, name="v"):
    return [r[name] for r in df.filter(test).orderBy(name).collect()]


@pytest.mark.parametrize("text,expected", [
    ("< -3", [-5, -4]), ("<=-4", [-5, -4]), ("28..29", [28, 29]), ("5 +/- 1", [4, 5, 6]), ("1, 2, 7", [1, 2, 7]), ("12", [12]),
    ("= 12", [12]), ("> 28 & < 30", [29]), ("1 | 3 | > 29", [1, 3, 30]), ("! > -5", [-5]), ("1.5..3.5 & ! 2", [3]),
    ("1..5 & 3..9 | 20", [3, 4, 5, 20]),
])
def test_numeric_expressions(numbers, text, expected):
    assert hits(numbers, fx.numeric_filter("v", text)) == expected


def test_scaled_literals(numbers):
    assert hits(numbers, fx.numeric_filter("v", "2..3", scaling=10.0)) == list(range(20, 31))


@pytest.mark.parametrize("text", ["", "a", "1..", "1,", "< ", "1 2", "5 +/- x", "1 &"])
def test_bad_numeric_expressions(numbers, text):
    with pytest.raises(fx.FilterError):
        fx.numeric_filter("v", text)


DATES = ["2001-05-07T00:00:00", "2001-05-07T13:00:00", "2001-05-07T23:59:59", "2001-05-08T00:00:00", "2001-05-09T12:00:00"]


@pytest.mark.parametrize("text,expected", [
    ("2001-05-07", DATES[:3]), ("<= 2001-05-07", DATES[:3]), ("< 2001-05-07T13:00:00", DATES[:1]), ("> 2001-05-07", DATES[3:]),
    (">= 2001-05-08", DATES[3:]), ("2001-05-07 .. 2001-05-08", DATES[:4]), ("2001-05-08 +/- 0.5", DATES[1:4]),
    ("2001-05-08, 2001-05-09", DATES[3:]), ("2001-05-07T13:00:00", DATES[1:2]),
])
def test_date_expressions(spark, text, expected):
    from skylattice.functions import times

    df = spark.createDataFrame([(d,) for d in DATES], "d string").withColumn("t", F.col("d").cast("timestamp_ntz"))
    assert hits(df, fx.date_filter("t", text), "d") == expected
    assert hits(df, fx.mjd_filter(times.mjd("t"), text), "d") == expected


WORDS = ["M 31", "M 33", "m 31", "NGC 224", "a*b", "x|y", "IC [1]"]


@pytest.mark.parametrize("text,expected", [
    ("M 31", ["M 31"]), ("== M 31", ["M 31"]), ("!= M 31", WORDS[1:]), ("~ M 3?", ["M 31", "M 33", "m 31"]),
    ("= M 3*", ["M 31", "M 33"]), ("= M 3[13]", ["M 31", "M 33"]), ("! M*", ["m 31", "NGC 224", "a*b", "x|y", "IC [1]"]),
    ("!~ M*", ["NGC 224", "a*b", "x|y", "IC [1]"]), ("=~ m 31", ["M 31", "m 31"]), ("=~ a*b", ["a*b"]),
    ("=,M 31,NGC 224", ["M 31", "NGC 224"]), ("=|M 31|m 31", ["M 31", "m 31"]), ("!=,M 31,M 33,m 31", ["NGC 224", "a*b", "x|y", "IC [1]"]),
    ("> m", ["m 31", "x|y"]), ("<= I", []), ("= x|y", ["x|y"]),
])
def test_string_expressions(spark, text, expected):
    df = spark.createDataFrame([(w,) for w in WORDS], "v string")
    assert sorted(hits(df, fx.string_filter("v", text))) == sorted(expected)


@pytest.mark.parametrize("literal,expected", [
    ("1", [1]), ("1/3/1", [1, 2, 3]), ("1/9/3", [1, 4, 7]), ("/-4,1/9/3", [-5, -4, 1, 4, 7]), ("29/", [29, 30]), ("/-5", [-5]),
    ("2/4", [2, 3, 4]), ("-3/-1,30", [-3, -2, -1, 30]),
])
def test_range_lists(numbers, literal, expected):
    assert hits(numbers, rl.range_filter("v", literal, "int")) == expected


def test_range_list_details(spark):
    assert rl.range_filter("v", None, "int") is None and rl.range_filter("v", "", "int") is None
    assert rl.split_qualifier("1/3;x%2fy") == ("1/3", "x/y")
    assert rl.names_value("a/b,c", "a/b") and not rl.names_value("a/b,c", "a")
    for bad in ("1/2/3/4", "/", "/3/1", "1;2;3", "x", "1/5/0"):
        with pytest.raises(rl.RangeError):
            rl.range_filter("v", bad, "int")
    with pytest.raises(rl.RangeError):
        rl.range_filter("v", "1/2/3", "float")


def test_steps_of_any_length(spark):
    numbers = spark.range(30).withColumnRenamed("id", "v")
    assert hits(numbers, rl.range_filter("v", "0/30000/10", "int")) == [0, 10, 20]
    assert hits(numbers, rl.range_filter("v", "1/1000000000/14,3", "int")) == [1, 3, 15, 29]
    days = spark.sql("SELECT timestamp_ntz'2001-01-01' + make_dt_interval(id) AS t, 51910 + id AS m, id FROM range(40)")
    for form, column in ((None, "t"), ("mjd", "m")):
        found = days.filter(rl.range_filter(column, "2001-01-02/2031-01-02/9", "date", form)).orderBy("id")
        assert [r["id"] for r in found.collect()] == [1, 10, 19, 28, 37]


def test_interval_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (5.0, 9.0)], "lo double, hi double")
    assert [r["lo"] for r in df.filter(rl.interval_filter("lo", "hi", "2/3")).collect()] == [2.0]
    assert [r["lo"] for r in df.filter(rl.interval_filter("lo", "hi", "2")).collect()] == [1.0, 2.0]
    assert [r["lo"] for r in df.filter(rl.interval_filter("lo", "hi", "/1.5,8/")).collect()] == [1.0, 5.0]


def test_positions_of_search():
    assert rl.positions("8,12") == [(8.0, 12.0)]
    assert rl.positions("10%2C12,-10,13;ICRS") == [(10.0, 12.0), (-10.0, 13.0)]
    for bad in ("12,12/14", "12", "12,13;WHACKO"):
        with pytest.raises(rl.RangeError):
            rl.positions(bad)


@pytest.mark.parametrize("pattern,regex", [(r"ZU?\*[!A-Z]*", r"ZU.\*[^A\-Z].*"), ("no[*", r"no\[.*"), ("a.b", r"a\.b")])
def test_shell_patterns(pattern, regex):
    assert p.shell_regex(pattern) == regex


def test_conditions(numbers):
    conditions = [Condition(lambda q: [F.col("v") == q["a"], F.col("v") == q["b"]], "a", "b"),
                  Condition(lambda q: F.col("v") > q["low"], "low", required=True)]
    assert hits(numbers, p.search_filter(conditions, {"low": 28})) == [29, 30]
    assert hits(numbers, p.search_filter(conditions, {"low": 0, "a": 1, "b": -1})) == [1]
    with pytest.raises(ValueError, match="low"):
        p.search_filter(conditions, {})


def test_constant_contradiction_empties_the_plan(numbers):
    plan = numbers.filter(p.on_constant("star", lambda v: v == "galaxy"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan or "LocalTableScan <empty>" in plan


def test_date_literals_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2001-05-07 00:30:00",)], "d string").withColumn("t", F.col("d").cast("timestamp_ntz"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.filter(fx.date_filter("t", "2001-05-07")).count() == 1
        assert df.filter(rl.range_filter("t", "2001-05-07T00:30:00/", "date")).count() == 1
        assert df.filter(rl.range_filter("t", "2001-05-07T00:30:01/", "date")).count() == 0
        assert df.filter(p.equals_value("t", datetime.datetime(2001, 5, 7, 0, 30))).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
