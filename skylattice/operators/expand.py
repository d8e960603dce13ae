"""One row to many: ranges, lists, columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import to_int
from ..functions.times import parse_iso

_BLOCK = 4096  #: steps exploded from one array


def _as_int(df: DataFrame, name: str) -> Column:
    return to_int(name) if df.schema[name].dataType.typeName() == "string" else F.col(name).cast("bigint")


def expand_integers(df: DataFrame, start: str, end: str, out: str = "ind") -> DataFrame:
    """A row per integer from ``start`` to ``end`` inclusive.

    Rows with unusable ends pass through with a NULL index; empty ranges give no row.
    """
    low, high = _as_int(df, start), _as_int(df, end)
    usable = low.isNotNull() & high.isNotNull()
    # blocks of numbers first, then the numbers of a block: no array grows with the range
    blocks = F.when(~usable, F.array(F.lit(None).cast("bigint"))).when(low <= high, F.sequence(low, high, F.lit(_BLOCK).cast("bigint")))
    df = df.withColumns({"__block": F.explode(blocks), "__high": high})
    values = F.when(F.col("__block").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(
        F.sequence("__block", F.least(F.col("__block") + (_BLOCK - 1), F.col("__high"))))
    return df.withColumn(out, F.explode(values)).drop("__block", "__high")


def expand_dates(df: DataFrame, start: str, end: str, out: str = "cur_time", hours=24.0) -> DataFrame:
    """A row per time step from ``start`` to the end day's last hour.

    ``hours`` may be a number or a column name; steps are 0.01 hours at least.
    """
    def stamp(name):
        kind = df.schema[name].dataType.typeName()
        return parse_iso(name) if kind == "string" else F.col(name).cast("timestamp_ntz")

    step_hours = F.greatest(F.lit(0.01), F.col(hours) if isinstance(hours, str) else F.lit(float(hours)))
    first, last = stamp(start), stamp(end) + F.expr("INTERVAL '23' HOUR")
    micros = F.round(step_hours * 3_600_000_000).cast("bigint")
    steps = F.floor(F.timestamp_diff("MICROSECOND", first, last) / micros).cast("bigint")
    # blocks of steps first, then the steps of a block: no array grows with the range
    df = df.withColumns({"__first": first, "__micros": micros, "__steps": steps}).filter(F.col("__steps") >= 0)
    df = df.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__steps"), F.lit(_BLOCK).cast("bigint"))))
    df = df.withColumn("__k", F.explode(F.sequence("__block", F.least(F.col("__block") + (_BLOCK - 1), F.col("__steps")))))
    moved = F.timestamp_add("MICROSECOND", F.col("__k") * F.col("__micros"), F.col("__first"))
    return df.withColumn(out, moved).drop("__first", "__micros", "__steps", "__block", "__k")


def _items(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda s: F.trim(s)), lambda s: s != "")


def expand_comma(df: DataFrame, source: str, out: str) -> DataFrame:
    """A row per non-empty, trimmed item of a comma list; rows without items vanish."""
    return df.withColumn(out, F.explode(_items(F.col(source), ",")))


def split_names(df: DataFrame, source: str, out: str) -> DataFrame:
    """A row per name of a ;-separated list, ``et al`` entries left out."""
    names = F.filter(_items(F.col(source), ";"), lambda s: ~F.lower(s).startswith("et al"))
    return df.withColumn(out, F.explode(names))


def unpivot_unique(df: DataFrame, columns, out: str = "value") -> DataFrame:
    """The distinct non-NULL values of several columns; arrays give their first element."""
    picked = []
    for name in columns:
        is_array = df.schema[name].dataType.typeName() == "array"
        picked.append((F.get(F.col(name), F.lit(0)) if is_array else F.col(name)).cast("string"))
    return df.select(F.explode(F.array(*picked)).alias(out)).filter(F.col(out).isNotNull()).distinct()


def row_filters(df: DataFrame, *filters: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Row filters in sequence; each may give zero or more rows for one."""
    for step in filters:
        df = df.transform(step)
    return df
