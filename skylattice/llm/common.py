"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: ASCII white space as the contracts have it: words are runs of anything else
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
PAUSE = 0.4  #: seconds that Spark's cleaner gets after a collection


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: the lineage ends there and every reader sees the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does when the driver collects its garbage, which a
    driver with little to do puts off while the disks fill.  A workaround: Spark has no call for it."""
    for _ in range(3):  # plans first, then what only they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(PAUSE)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often ``use`` mentions it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def row_key(*columns: str) -> list[Column]:
    """Two hashes that stand for a row's values, nulls included; equal rows have equal keys."""
    parts = [F.col(c) for c in columns]
    nulls = F.concat(*[F.when(p.isNull(), "1").otherwise("0") for p in parts])
    return [F.xxhash64(*parts, nulls), F.xxhash64(F.lit("second"), nulls, *reversed(parts))]


def without_rows(df: DataFrame, rejected: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of ``df`` whose key (``row_key`` of the columns) is not among those of ``rejected`` (columns __k1, __k2)."""
    k1, k2 = row_key(*columns)
    keyed = df.withColumns({"__k1": k1, "__k2": k2})
    return keyed.join(rejected.select("__k1", "__k2").distinct(), ["__k1", "__k2"], "left_anti").select(*df.columns)
