"""Joins with tables of intervals: which intervals hold a value, which intervals overlap.

The range of all ends is cut into 2^LEVELS equal steps, the leaves of a binary tree.  An interval is cut where its ends
part, at its fork node, into the largest blocks of the tree that it fills or touches at its ends: at most two a level,
however long it is.  A value has one block on each level that intervals use.  The join is an equi-join on level and block;
only blocks at an interval's very ends can hold values outside it, which the exact comparison takes out.  So what is joined
is hardly more than what matches, long and short, nested and open intervals alike, and blocks with many
values are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .skew import salted_join, spread_pairs

LEVELS = 16


def _number(df: DataFrame, name: str) -> Column:
    """A column of numbers, dates or timestamps as a double, in order."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def _leaf(x: Column, low: float, step: float) -> Column:
    """The step a number falls into; those beyond either end fall into the first or last."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float((1 << LEVELS) - 1)), F.floor((x - low) / step))).cast("bigint")


def _blocks(a: Column, b: Column) -> Column:
    """The blocks (level, block) that fill the steps a to b: those whose double does not fit."""
    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)

        def fits(x: Column, wide: Column) -> Column:
            return (x * wide >= a) & ((x + 1) * wide <= b + 1)

        def block(x: Column) -> Column:
            return F.struct(level.alias("level"), x.alias("block"))

        left, right = F.floor((a + size - 1) / size).cast("bigint"), F.floor((b + 1) / size).cast("bigint") - 1
        both = F.array_distinct(F.array(block(left), block(right)))
        return F.filter(both, lambda s: fits(s["block"], size) & ~fits(F.floor(s["block"] / 2).cast("bigint"), 2 * size))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def match_intervals(values: DataFrame, intervals: DataFrame, value: str, low: str, high: str, half_open: bool = False,
                    slice_rows: int = 1_000_000, counted: str | None = None) -> DataFrame:
    """Pairs of rows of ``values`` and ``intervals`` with low <= value <= high (value < high if ``half_open``).

    A NULL end is open; values that are NULL or NaN match nothing, intervals whose ends are the wrong way round hold nothing.
    The tables' column names must differ.  With ``counted`` the result is each interval that holds a value, with their
    number in that column: as many as its pairs, but none of them is made.  Blocks with many pairs are spread over tasks.
    """
    shared = set(values.columns) & set(intervals.columns)
    if shared:
        raise ValueError(f"columns on both sides: {', '.join(sorted(shared))}")
    spark = values.sparkSession
    v, lo, hi = _number(values, value), _number(intervals, low), _number(intervals, high)
    kept = intervals.withColumns({"__lo": F.coalesce(lo, F.lit(float("-inf"))), "__hi": F.coalesce(hi, F.lit(float("inf")))}).filter(
        ~F.isnan("__lo") & ~F.isnan("__hi") & (F.col("__lo") <= F.col("__hi")))
    if counted:
        return _counted(values.select(v.alias("__x")), kept, half_open, slice_rows, counted).select(*intervals.columns, counted)
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    ends = kept.agg(F.least(F.min(finite(F.col("__lo"))), F.min(finite(F.col("__hi")))).alias("a"),
                    F.greatest(F.max(finite(F.col("__lo"))), F.max(finite(F.col("__hi")))).alias("b")).first()
    first, last = (0.0, 1.0) if ends["a"] is None else (ends["a"], ends["b"])
    step = max((last - first) / (1 << LEVELS), abs(first) * 1e-15, 5e-324)
    path = scratch_path(spark, "blocks")
    kept.withColumn("__at", F.explode(_blocks(_leaf(F.col("__lo"), first, step), _leaf(F.col("__hi"), first, step)))).select(
        "*", F.col("__at.level").alias("__level"), F.col("__at.block").alias("__block")).drop("__at").write.parquet(path)
    blocks = spark.read.parquet(path)
    levels = sorted(r[0] for r in blocks.select("__level").distinct().collect())  # LEVELS + 1 at most
    used = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    placed = values.withColumn("__v", v).filter(F.col("__v").isNotNull() & ~F.isnan("__v")).withColumn(
        "__leaf", _leaf(F.col("__v"), first, step)).withColumn("__level", F.explode(used)).withColumn(
        "__block", F.call_function("shiftright", F.col("__leaf"), F.col("__level"))).drop("__leaf")
    a, b = spread_pairs(placed, blocks, ["__level", "__block"], slice_rows)
    pairs = a.join(b, ["__level", "__block", "__salt"])
    upper = F.col("__v") < F.col("__hi") if half_open else F.col("__v") <= F.col("__hi")
    # an open end holds whatever comes, infinities too
    return pairs.filter((F.col("__lo") <= F.col("__v")) & (upper | (F.col("__hi") == float("inf")))).select(*values.columns, *intervals.columns)


def _counted(values: DataFrame, kept: DataFrame, half_open: bool, slice_rows: int, out: str) -> DataFrame:
    """Intervals (__lo, __hi) with the number of values (__x) in them, where it is not 0.

    Values and ends are put in one order; an interval holds as many values as there are up to its higher end less those
    before its lower one.  The order is cut into slices, with the counts of earlier slices as offsets.
    """
    spark = kept.sparkSession
    # at the same place, ends that come before the values sort as 0, values as 1, ends that come after them as 2
    after = F.when(F.col("__hi") < float("inf"), 0).otherwise(2) if half_open else F.lit(2)
    kept = kept.withColumns({"__lo": F.col("__lo") + 0.0, "__hi": F.col("__hi") + 0.0, "__after": after})  # no negative zeros
    at = values.filter(F.col("__x").isNotNull() & ~F.isnan("__x")).select((F.col("__x") + 0.0).alias("__x"), F.lit(1).alias("__kind"), F.lit(1).alias("__n"))
    ends = [kept.select(F.col(end).alias("__x"), kind.alias("__kind"), F.lit(0).alias("__n")) for end, kind in (
        ("__lo", F.lit(0)), ("__hi", F.col("__after")))]
    places = at.unionByName(ends[0]).unionByName(ends[1]).groupBy("__x", "__kind").agg(F.sum("__n").alias("__n"))
    path = scratch_path(spark, "places")
    places.write.parquet(path)
    places = spark.read.parquet(path)
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places.count() // slice_rows))
    path = scratch_path(spark, "slices")
    places.repartitionByRange(slices, "__x", "__kind").withColumn("__slice", F.spark_partition_id()).write.parquet(path)
    places = spark.read.parquet(path)
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    offsets = places.groupBy("__slice").agg(F.sum("__n").alias("__of")).select("__slice", F.coalesce(F.sum("__of").over(earlier), F.lit(0)).alias("__before"))
    so_far = F.sum("__n").over(Window.partitionBy("__slice").orderBy("__x", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = places.withColumn("__upto", so_far).filter("__kind <> 1").join(F.broadcast(offsets), "__slice").select(
        "__x", "__kind", (F.col("__upto") + F.col("__before")).alias("__rank"))
    low = ranks.select(F.col("__x").alias("__lo"), F.col("__kind").alias("__first"), F.col("__rank").alias("__below"))
    high = ranks.select(F.col("__x").alias("__hi"), F.col("__kind").alias("__after"), F.col("__rank").alias("__upto"))
    found = salted_join(kept.withColumn("__first", F.lit(0)), low, ["__lo", "__first"], slice_rows=slice_rows)
    found = salted_join(found, high, ["__hi", "__after"], slice_rows=slice_rows)
    return found.withColumn(out, F.col("__upto") - F.col("__below")).filter(F.col(out) > 0)


def match_overlaps(left: DataFrame, right: DataFrame, left_low: str, left_high: str, right_low: str, right_high: str,
                   slice_rows: int = 1_000_000) -> DataFrame:
    """Pairs of rows whose closed intervals share a value; NULL ends are open.

    Of two intervals that overlap the one that begins later begins in the other.
    """
    begin = lambda df, c: F.coalesce(_number(df, c), F.lit(float("-inf")))
    proper = lambda df, a, b: df.filter(F.coalesce(_number(df, a) <= _number(df, b), F.lit(True)))
    left, right = proper(left, left_low, left_high), proper(right, right_low, right_high)
    starts = left.withColumn("__begin", begin(left, left_low))
    inner = match_intervals(starts, right, "__begin", right_low, right_high, slice_rows=slice_rows)
    later = match_intervals(right.withColumn("__begin", begin(right, right_low)), left, "__begin", left_low, left_high, slice_rows=slice_rows)
    later = later.filter(F.col("__begin") > begin(left, left_low))
    columns = [*left.columns, *right.columns]
    return inner.select(*columns).unionByName(later.select(*columns))
