"""Joins, key policies, row making, expansion, lookups, numbering."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.functions import sphere
from skylattice.operators import crossmatch, expand, keys, limits, lookups, mapping, relational, skew, stats
from skylattice.schema import ColumnSpec, TableSpec, structure_differences


def _sky(spark, n, seed, clump=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < clump:
            rows.append((i, 200.0 + rng.uniform(-0.2, 0.2), 30.0 + rng.uniform(-0.2, 0.2)))
        elif i % 20 == 0:
            rows.append((i, rng.uniform(0, 360), rng.choice((-1, 1)) * rng.uniform(88, 90)))
        elif i % 20 == 1:
            rows.append((i, rng.uniform(-1, 1) % 360, rng.uniform(-90, 90)))
        else:
            rows.append((i, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))))
    return spark.createDataFrame(rows, "id int, ra double, dec double")


@pytest.mark.parametrize("radius,clump,slice_rows", [(2.0, 0.0, 1_000_000), (0.3, 0.4, 50), (40.0, 0.0, 100)])
def test_crossmatch_against_brute_force(spark, radius, clump, slice_rows):
    a, b = _sky(spark, 600, 1, clump), _sky(spark, 300, 2, clump)
    pairs = crossmatch.crossmatch(a, b, radius, slice_rows=slice_rows).select("id_1", "id_2")
    both = a.crossJoin(b.select(F.col("id").alias("i"), F.col("ra").alias("r"), F.col("dec").alias("d")))
    brute = both.filter(sphere.within("ra", "dec", "r", "d", radius)).select(F.col("id").alias("id_1"), F.col("i").alias("id_2"))
    assert pairs.count() == brute.count() > 0
    assert pairs.exceptAll(brute).count() == 0
    matched = crossmatch.crossmatch(a, b, radius, how="left_semi", slice_rows=slice_rows).select("id_1")
    lonely = crossmatch.crossmatch(a, b, radius, how="left_anti", slice_rows=slice_rows).select("id_1")
    assert matched.count() == brute.select("id_1").distinct().count()
    assert matched.count() + lonely.count() == 600 and matched.intersect(lonely).count() == 0


def test_crossmatch_needs_no_nested_loop_over_rows(spark):
    plan = crossmatch.crossmatch(_sky(spark, 10, 1), _sky(spark, 10, 2), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_radius_by_row(spark):
    a = _sky(spark, 400, 3)
    b = _sky(spark, 100, 4).withColumn("r", (F.col("id") % 9).cast("double"))
    found = crossmatch.crossmatch(a, b, "r", max_radius=2.0).count()
    other = b.select(F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), "r")
    assert found == a.crossJoin(other).filter(sphere.within("ra", "dec", "ra2", "dec2", F.col("r"))).count()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.lit("x").alias("v"))
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    salted = skew.salted_join(left, right, ["k"], how, slice_rows=100)
    plain = left.join(right, ["k"], how)
    assert salted.count() == plain.count() and salted.exceptAll(plain).count() == 0
    assert [r["k"] for r in skew.hot_keys(left, ["k"], 100).collect()] == [7]


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("o"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 5).cast("string")).alias("g"))
    from pyspark.sql import Window

    plain = df.withColumn("n", F.row_number().over(Window.orderBy("o")).cast("bigint"))
    assert skew.number_rows(df, "o", "n", slices=7).exceptAll(plain.select("o", "g", "n")).count() == 0
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint"))
    numbered = skew.number_rows(df, "o", "n", partition="g", slices=7).select("o", "g", "n")
    assert numbered.exceptAll(plain).count() == 0 and numbered.count() == 1000


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([("a", "one", 1), ("b", "two", 2)], "x string, y string, n int")


def _table(df):
    return sorted(tuple(r) for r in df.select("x", "y").collect())


def test_policies(spark, stored):
    new = spark.createDataFrame([("b", "other", 3), ("c", "three", 4), ("c", "four", 5)], stored.schema)
    assert _table(keys.merge(stored, new, ["x"], "n", "drop")) == [("a", "one"), ("b", "two"), ("c", "three")]
    for policy in ("overwrite", "dropOld"):
        assert _table(keys.merge(stored, new, ["x"], "n", policy)) == [("a", "one"), ("b", "other"), ("c", "four")]
    with pytest.raises(Exception, match="differing rows"):
        keys.merge(stored, new, ["x"], "n", "check").collect()
    with pytest.raises(keys.DuplicateKeyPolicyError):
        keys.merge(stored, new, ["x"], "n", "whatever")


def test_check_policy_accepts_equal_rows_and_nulls(spark, stored):
    new = spark.createDataFrame([("a", "one", 3), ("b", None, 4), ("c", None, 5)], stored.schema)
    assert _table(keys.merge(stored, new, ["x"], "n", "check")) == [("a", "one"), ("b", "two"), ("c", None)]
    assert keys.check_keys(stored.unionByName(stored), ["x"], "n").count() == 2


def test_compound_keys(spark):
    df = spark.createDataFrame([("a", 1, "p", 1), ("a", 2, "q", 2), ("a", 1, "r", 3)], "x string, k int, y string, n int")
    assert sorted(tuple(r) for r in keys.last_by_key(df, ["x", "k"], "n").collect()) == [("a", 1, "r", 3), ("a", 2, "q", 2)]
    assert [tuple(r) for r in keys.key_conflicts(df, ["x", "k"], ignore=["n"]).collect()] == [("a", 1, 2)]


def test_orphans_skip_nulls(spark):
    child = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "i int, k string")
    parent = spark.createDataFrame([("a",)], "k string")
    assert [r["i"] for r in keys.orphans(child, parent, {"k": "k"}).collect()] == [2]


SPEC = TableSpec("t", (ColumnSpec("n", "int", required=True), ColumnSpec("v", "double", unit="km"), ColumnSpec("d", "date", default=None),
                       ColumnSpec("kind", "string", default="none")))


def test_row_maker(spark):
    raw = spark.createDataFrame([("1", " 2.5 ", "2001-02-03", "-"), ("2", "", "20010204", "x")], "a string, b string, c string, k string")
    maker = mapping.RowMaker(SPEC, "n:a v:b d:c kind:k", null_literals={"kind": ["-"]}, strict=True)
    made = maker(raw)
    assert [tuple(r) for r in made.collect()] == [(1, 2.5, datetime.date(2001, 2, 3), "none"), (2, None, datetime.date(2001, 2, 4), "x")]
    assert made.schema["v"].metadata["unit"] == "km"
    with pytest.raises(KeyError):
        mapping.RowMaker(SPEC, "n:nowhere")(raw)
    with pytest.raises(Exception, match="no integer"):
        mapping.RowMaker(SPEC, "n:k", strict=True)(raw).collect()
    assert structure_differences(made.drop("d"), SPEC) == ["d: found kind in its place", "kind: missing"]


def test_fan_out_refuses_unknown_roles(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "role string, v int")
    out = mapping.fan_out(df, "role", {"a": lambda x: x, "b": lambda x: x})
    assert out["b"].first()["v"] == 2
    with pytest.raises(Exception, match="no table for role b"):
        mapping.fan_out(df, "role", {"a": lambda x: x})["a"].collect()


def test_expansion(spark):
    df = spark.createDataFrame([("a", "1", "3"), ("b", None, "3"), ("c", "4", "3"), ("d", "x", "3")], "n string, lo string, hi string")
    found = [tuple(r) for r in expand.expand_integers(df, "lo", "hi", "i").select("n", "i").orderBy("n", "i").collect()]
    assert found == [("a", 1), ("a", 2), ("a", 3), ("b", None), ("d", None)]
    dates = spark.createDataFrame([("2000-05-08", "2000-05-10", 24.0), ("2000-05-08", "2000-05-07", 24.0)], "a string, b string, h double")
    stamps = [r["cur_time"] for r in expand.expand_dates(dates, "a", "b").orderBy("cur_time").collect()]
    assert stamps == [datetime.datetime(2000, 5, d) for d in (8, 9, 10)]
    assert expand.expand_dates(dates.limit(1), "a", "b", hours=12.0).count() == 6
    assert expand.expand_dates(dates.limit(1), "a", "b", hours=0.0).count() == 7101
    lists = spark.createDataFrame([("a", " one, two ,,three "), ("b", "  "), ("c", None), ("d", "x; y; Foo et al; et al.")], "n string, s string")
    assert [r["i"] for r in expand.expand_comma(lists, "s", "i").filter("n != 'd'").collect()] == ["one", "two", "three"]
    assert [r["i"] for r in expand.split_names(lists.filter("n = 'd'"), "s", "i").collect()] == ["x", "y", "Foo et al"]


def test_lookups(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "k string, v int")
    table = spark.createDataFrame([("a", "A", None), ("a", "AA", 5), ("b", "B", 7)], "key string, name string, size int")
    known = df.filter("k != 'z'")
    found = lookups.select_one(known, table, "k", "key", "name:label size:n(0)", order=["name"])
    assert [tuple(r) for r in found.select("k", "label", "n").orderBy("k").collect()] == [("a", "A", 0), ("b", "B", 7)]
    with pytest.raises(Exception, match="no match for z"):
        lookups.select_one(df, table, "k", "key", "name:label").select("label").collect()
    with pytest.raises(Exception, match="no match for z"):
        df.select(lookups.dict_map("k", {"a": 1, "b": 2}, strict=True)).collect()
    aliases = spark.createDataFrame([("acyg", "alp Cyg")], "alias string, target string")
    names = spark.createDataFrame([("aCyg",), ("other",)], "n string")
    assert [r["t"] for r in lookups.map_names(names, aliases, "n", "t", "keep").orderBy("n").collect()] == ["alp Cyg", "other"]
    assert [r["t"] for r in lookups.map_names(names, aliases, "n", "t", "null").orderBy("n").collect()] == ["alp Cyg", None]
    assert lookups.quoted("Nova Cygni '92") == "Nova=20Cygni=20'92"


def test_set_operands(spark):
    a, b = spark.range(3).toDF("x"), spark.range(3).toDF("y")
    with pytest.raises(relational.OperandError):
        relational.union(a, b)
    assert relational.set_limit(a.union(a), ["x"], 2, None).count() == 6
    assert limits.effective_limit(None, "datasets") == 10_000
    with pytest.warns(UserWarning):
        assert limits.effective_limit(10**9) == 20_000_000
    assert tuple(limits.overflow(a, 2).first()) == (2, "OVERFLOW") and tuple(limits.overflow(a, 3).first()) == (3, "OK")


def test_column_statistics(spark):
    df = spark.createDataFrame([(1, "b", None), (3, "a", 2.0)], "i int, s string, f double")
    found = {r["column_name"]: tuple(r)[1:] for r in stats.column_stats(df).collect()}
    assert found == {"i": ("1", "3", 2.0, False), "s": ("a", "b", None, False), "f": ("2.0", "2.0", 2.0, True)}


def test_cone_prunes_the_scan(spark, tmp_path):
    path = str(tmp_path / "sky")
    _sky(spark, 500, 5).write.parquet(path)
    found = crossmatch.cone_search(spark.read.parquet(path).select("id", "ra", "dec"), 120.0, 10.0, 5.0, folded=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(dec" in pushed and "LessThanOrEqual(ra" in pushed
    assert found.count() == spark.read.parquet(path).filter(sphere.within("ra", "dec", 120.0, 10.0, 5.0)).count()


def test_pairs_are_dealt_over_tasks(spark):
    """Few small rows with many pairs go to as many tasks as the pairs take, whatever their bytes and files."""
    left = spark.range(3000).coalesce(1).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(400).coalesce(1).select((F.col("id") % 20).alias("k"), F.col("id").alias("w"))
    a, b = skew.spread_pairs(left, right, ["k"], pair_rows=500)
    pairs, plain = a.join(b, ["k", "__salt"]).drop("__salt"), left.join(right, ["k"])
    assert pairs.count() == plain.count() > 40_000 and pairs.exceptAll(plain).count() == 0
    sizes = [n for (n,) in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 30 and max(sizes) < 5_000
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == -(-plain.count() // 500) or a.rdd.getNumPartitions() == plain.count() // 500


def test_matches_run_in_many_tasks(spark):
    a, b = _sky(spark, 3000, 1, 0.5).coalesce(1), _sky(spark, 300, 2, 0.5).coalesce(1)
    assert crossmatch.crossmatch(a, b, 3.0, slice_rows=2000).rdd.getNumPartitions() >= 8


def test_hot_pairs_are_cut_on_both_sides(spark):
    """A key with many rows on both sides copies neither of them to every slice."""
    left, right = (spark.range(n).select(F.lit(7).alias("k"), F.col("id").alias(c)) for n, c in ((2000, "a"), (3000, "b")))
    a, b = skew.spread_pairs(left, right, ["k"], pair_rows=50_000)
    assert a.count() + b.count() < 2 * 11 * 3000
    assert a.join(b, ["k", "__salt"]).select("a", "b").distinct().count() == a.join(b, ["k", "__salt"]).count() == 6_000_000
    for m, n in ((1, 5000), (5000, 1)):
        one, many = (spark.range(x).select(F.lit(7).alias("k"), F.col("id").alias(c)) for x, c in ((m, "a"), (n, "b")))
        a, b = skew.spread_pairs(one, many, ["k"], pair_rows=500)
        assert a.join(b, ["k", "__salt"]).select("a", "b").distinct().count() == 5000 and a.count() + b.count() <= 5010
