"""Columns from other tables by one key, and value maps.

Lookup tables are joined without hints: Spark broadcasts them when their
measured size is below its threshold and shuffles otherwise.
"""

from __future__ import annotations

import quopri
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions._args import col


def _miss(value, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: no match for "), F.coalesce(value.cast("string"), F.lit("NULL"))))


def select_one(df: DataFrame, table: DataFrame, key, column: str, assignments: str, order=None,
               required: bool = True) -> DataFrame:
    """Columns of the row of ``table`` whose ``column`` equals ``key``.

    ``assignments`` holds ``source:dest`` or ``source:dest(default)`` pairs;
    the default stands for NULL in the found row.  Several rows: the first by
    ``order`` (else any).  A key that is not found is an error where
    ``required``.
    """
    pairs = []
    for item in assignments.split():
        source, _, dest = item.partition(":")
        match = re.fullmatch(r"(\w+)\((.*)\)", dest)
        pairs.append((source, *(match.groups() if match else (dest, None))))
    wanted = F.struct(*(F.col(source).alias(f"c{i}") for i, (source, _, _) in enumerate(pairs)))
    place = F.row_number().over(Window.partitionBy(column).orderBy(*(order or [F.lit(0)])))
    unique = table.withColumn("__place", place).filter(F.col("__place") == 1).select(
        F.col(column).alias("__key"), wanted.alias("__found"))
    joined = df.join(unique, col(key) == F.col("__key"), "left")
    if required:
        joined = joined.withColumn("__found", F.when(F.col("__key").isNotNull(), F.col("__found")).otherwise(
            _miss(col(key), column).cast(joined.schema["__found"].dataType)))
    for i, (source, dest, default) in enumerate(pairs):
        value = F.col("__found")[f"c{i}"]
        if default is not None:
            value = F.when(F.col("__key").isNotNull(), F.coalesce(
                value, F.lit(default).cast(table.schema[source].dataType))).otherwise(value)
        joined = joined.withColumn(dest, value)
    return joined.drop("__key", "__found")


def merge_first(df: DataFrame, query: DataFrame) -> DataFrame:
    """The columns of the first row of a query added to every row."""
    return df.crossJoin(F.broadcast(query.limit(1)))


def dict_map(value, mapping: dict, default=None, strict: bool = False) -> Column:
    """A value through a dictionary; other values give the default, or an error with ``strict``."""
    value = col(value)
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), value)
    if strict:
        return F.when(value.isin(list(mapping)), found).otherwise(_miss(value, "map"))
    known = value.isin(list(mapping))
    return found if default is None else F.when(known, found).otherwise(F.lit(default))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, target) rows of an alias file: target, a tab, blank-separated aliases in quoted-printable."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", "\t", 2)
    aliases = lines.select(
        F.trim(F.get(parts, F.lit(0))).alias("target"),
        F.explode(F.split(F.trim(F.get(parts, F.lit(1))), r"\s+")).alias("alias"))
    decoded = F.regexp_replace("alias", "=20", " ")
    decoded = F.regexp_replace(F.regexp_replace(decoded, "=09", "\t"), "=3[Dd]", "=")
    return aliases.select(F.lower(decoded).alias("alias"), "target").filter("alias != ''")


def quoted(name: str) -> str:
    """A name as alias files want it."""
    return quopri.encodestring(name.encode(), quotetabs=True).decode().replace("=\n", "")


def map_names(df: DataFrame, aliases: DataFrame, value: str, out: str, on_miss: str = "error") -> DataFrame:
    """Names through an alias table, without regard to case.

    A miss is an error, ``null``, or with ``keep`` the name itself.
    """
    unique = aliases.groupBy(F.lower("alias").alias("__alias")).agg(F.min("target").alias("__target"))
    joined = df.join(unique, F.lower(F.col(value)) == F.col("__alias"), "left")
    other = {"error": _miss(F.col(value), "name"), "null": F.lit(None).cast("string"), "keep": F.col(value)}
    if on_miss not in other:
        raise ValueError(f"on_miss is error, null or keep, not {on_miss}")
    mapped = F.when(F.col("__alias").isNotNull(), F.col("__target")).otherwise(other[on_miss])
    return joined.withColumn(out, mapped).drop("__alias", "__target")


def map_bands(df: DataFrame, bands: DataFrame, name: str, prefix: str = "bandpass") -> DataFrame:
    """Low, middle and high wavelength (m) of a filter name; names not known leave NULLs.

    ``bands`` has name, low, mid, high in nanometres, one row per name or alias.
    """
    unique = bands.groupBy(F.lower("name").alias("__band")).agg(
        *(F.min_by(c, F.col("name")).alias(f"__{c}") for c in ("low", "mid", "high")))
    joined = df.join(unique, F.lower(F.trim(name)) == F.col("__band"), "left")
    for source, dest in (("low", "Lo"), ("mid", "Refval"), ("high", "Hi")):
        joined = joined.withColumn(prefix + dest, F.col(f"__{source}") * 1e-9)
    return joined.withColumn(prefix + "Unit", F.when(F.col("__band").isNotNull(), "m")).drop(
        "__band", "__low", "__mid", "__high")


def resolve_names(df: DataFrame, objects: DataFrame, name: str, out_ra: str = "ra", out_dec: str = "dec",
                  required: bool = False) -> DataFrame:
    """Positions of object names from a table (name, ra, dec); unknown names give NULL or an error."""
    unique = objects.groupBy(F.lower("name").alias("__name")).agg(
        F.min(F.struct("ra", "dec")).alias("__position"))
    joined = df.join(unique, F.lower(F.trim(name)) == F.col("__name"), "left")
    position = F.col("__position")
    if required:
        position = F.when(F.col("__name").isNotNull(), position).otherwise(
            _miss(F.col(name), "object").cast(joined.schema["__position"].dataType))
    return joined.withColumns({out_ra: position["ra"], out_dec: position["dec"]}).drop("__name", "__position")
