import datetime
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import intervals


def tables(spark, rng, n_values=400, n_intervals=150):
    points = [(i, rng.choice([rng.uniform(-100, 100), float(rng.randrange(-20, 20)), None])) for i in range(n_values)]
    points += [(9001, float("inf")), (9002, float("-inf")), (9003, float("nan")), (9004, 1e18)]
    spans = []
    for k in range(n_intervals):
        a = rng.choice([rng.uniform(-120, 120), float(rng.randrange(-20, 20))])
        b = a + rng.choice([0.0, 1e-9, 1e-3, 0.5, 7.0, 60.0, 500.0])
        spans.append((k, rng.choice([a, a, a, None]), rng.choice([b, b, b, None])))
    spans += [(900, 5.0, 4.0), (901, None, None), (902, float("nan"), 3.0)]
    return spark.createDataFrame(points, "i int, v double"), spark.createDataFrame(spans, "k int, lo double, hi double")


@pytest.mark.parametrize("half_open", [False, True])
def test_values_in_intervals_equal_the_nested_loop(spark, half_open):
    values, spans = tables(spark, random.Random(1))
    upper = F.col("v") < F.col("hi") if half_open else F.col("v") <= F.col("hi")
    nan = F.isnan("v") | F.coalesce(F.isnan("lo") | F.isnan("hi"), F.lit(False))
    brute = values.crossJoin(spans).filter(F.col("v").isNotNull() & ~nan & (F.col("lo").isNull() | (F.col("lo") <= F.col("v"))) & (F.col("hi").isNull() | upper)
                                           & F.coalesce(F.col("lo") <= F.col("hi"), F.lit(True)))
    for slice_rows in (20, 1_000_000):
        found = intervals.match_intervals(values, spans, "v", "lo", "hi", half_open, slice_rows).select("i", "k").collect()
        assert sorted(found) == sorted(brute.select("i", "k").collect()) and len(found) > 1000


def test_overlaps_equal_the_nested_loop(spark):
    _, left = tables(spark, random.Random(2), 1, 120)
    _, right = tables(spark, random.Random(3), 1, 90)
    left, right = left.filter("k <> 902"), right.filter("k <> 902").toDF("k2", "lo2", "hi2")
    brute = left.crossJoin(right).filter("coalesce(lo <= hi, true) AND coalesce(lo2 <= hi2, true) AND coalesce(lo <= hi2, true) AND coalesce(lo2 <= hi, true)")
    found = intervals.match_overlaps(left, right, "lo", "hi", "lo2", "hi2", slice_rows=30).select("k", "k2").collect()
    assert sorted(found) == sorted(brute.select("k", "k2").collect()) and len(found) > 2000


def test_few_blocks_and_few_candidates(spark):
    rng = random.Random(4)
    spans = [(k, a := rng.uniform(0, 1e6), a + 10 ** rng.uniform(-3, 6)) for k in range(500)]
    df = spark.createDataFrame(spans, "k int, lo double, hi double")
    step = 2e6 / (1 << intervals.LEVELS)
    leaf = lambda c: intervals._leaf(F.col(c), 0.0, step)
    rows = df.select("k", leaf("lo").alias("a"), leaf("hi").alias("b"), F.explode(intervals._blocks(leaf("lo"), leaf("hi"))).alias("s"))
    found = rows.groupBy("k", "a", "b").agg(F.count("*").alias("n"), F.sum(F.expr("shiftleft(1L, s.level)")).alias("steps")).collect()
    assert len(found) == 500 and max(r["n"] for r in found) <= 2 * intervals.LEVELS
    assert all(r["steps"] == r["b"] - r["a"] + 1 for r in found)  # the blocks part the interval's steps


def test_other_types_and_refusals(spark):
    t = [datetime.datetime(2020, 1, d, 12) for d in range(1, 29)]
    values = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t timestamp_ntz")
    spans = spark.createDataFrame([(0, t[3], t[5]), (1, None, t[2]), (2, t[26], None)], "k int, a timestamp_ntz, b timestamp_ntz")
    found = intervals.match_intervals(values, spans, "t", "a", "b").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in found} == {0: 3, 1: 3, 2: 2}
    assert intervals.match_intervals(values, spans.limit(0), "t", "a", "b").count() == 0
    with pytest.raises(ValueError):
        intervals.match_intervals(values, spans.withColumnRenamed("k", "i"), "t", "a", "b")


@pytest.mark.parametrize("half_open", [False, True])
def test_counted_intervals_equal_their_pairs(spark, half_open):
    values, spans = tables(spark, random.Random(5))
    values = values.unionByName(spark.createDataFrame([(9100, -0.0), (9101, 0.0), (9102, 0.0)], "i int, v double"))
    spans = spans.unionByName(spans.limit(20)).unionByName(spark.createDataFrame([(950, -0.0, 0.0), (951, 0.0, 3.0), (None, 0.0, 5.0)], "k int, lo double, hi double"))
    pairs = intervals.match_intervals(values, spans, "v", "lo", "hi", half_open).groupBy("k").count().collect()
    for slice_rows in (20, 1_000_000):
        found = intervals.match_intervals(values, spans, "v", "lo", "hi", half_open, slice_rows, counted="n")
        assert found.columns == ["k", "lo", "hi", "n"] and found.count() <= spans.count()
        assert {tuple(r) for r in found.groupBy("k").sum("n").collect()} == {tuple(r) for r in pairs}
