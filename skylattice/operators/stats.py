"""Aggregates over tables: column statistics, options, summaries, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import number_rows


def column_stats(df: DataFrame, columns=None) -> DataFrame:
    """One row per column: min, max (ordered types), mean (numbers), whether there are NULLs.

    A single aggregation over the table; values are text.
    """
    names = columns or df.columns
    aggregates, rows = [], []
    for i, name in enumerate(names):
        kind = df.schema[name].dataType
        ordered = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        numeric = isinstance(kind, T.NumericType)
        aggregates += [
            (F.min(name) if ordered else F.first(F.lit(None))).cast("string").alias(f"lo{i}"),
            (F.max(name) if ordered else F.first(F.lit(None))).cast("string").alias(f"hi{i}"),
            (F.avg(name) if numeric else F.first(F.lit(None))).cast("double").alias(f"avg{i}"),
            F.coalesce(F.bool_or(F.col(name).isNull()), F.lit(False)).alias(f"nulls{i}"),
        ]
        rows.append(F.struct(F.lit(name).alias("column_name"), F.col(f"lo{i}").alias("min_value"),
                             F.col(f"hi{i}").alias("max_value"), F.col(f"avg{i}").alias("mean_value"),
                             F.col(f"nulls{i}").alias("has_nulls")))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def options(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column."""
    return df.select(column).distinct()


def string_agg(value, delimiter: str, order=None) -> Column:
    """Values of a group joined by a delimiter, in an order; NULLs are left out.

    The result is one string per group, so groups must be of modest size.
    """
    value = F.col(value) if isinstance(value, str) else value
    if order is None:
        return F.listagg(value.cast("string"), delimiter)
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(
        F.col(order).alias("o"), value.cast("string").alias("v")))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), delimiter)


def result_summary(df: DataFrame, first, order, start: str, end: str, types: str, calibrations: str) -> DataFrame:
    """One row about a search result: columns of its first row, covered range, sets of types and calibrations."""
    return df.agg(
        *(F.min_by(c, order).alias(c) for c in first),
        F.min(start).alias(start), F.max(end).alias(end),
        F.array_sort(F.collect_set(types)).alias(types),
        F.array_sort(F.collect_set(calibrations)).alias(calibrations))


def chunked(df: DataFrame, key: str, order: str, out: str = "position") -> DataFrame:
    """Rows with their position inside the chunk of their key.

    Chunks stay rows, as a chunk may hold any number of them.
    """
    return number_rows(df, order, out, partition=key)


def chunk_blocks(df: DataFrame, key: str, order: str, value: str, block: int = 1000) -> DataFrame:
    """Chunks as arrays of at most ``block`` values: key, block number, values in order."""
    placed = chunked(df, key, order, "__position")
    placed = placed.withColumn("block", F.floor((F.col("__position") - 1) / block))
    pairs = F.sort_array(F.collect_list(F.struct("__position", value)))
    return placed.groupBy(key, "block").agg(F.transform(pairs, lambda p: p[value]).alias("items"))
