"""Keys: uniqueness policies, replacing rows, tombstones, validation, references.

Duplicates are settled by aggregates that combine on the map side, or by
first rows of windows that Spark limits on the map side, so a key with very
many copies never lands in one task as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TableSpec

POLICIES = ("check", "drop", "overwrite", "dropOld")


class DuplicateKeyPolicyError(ValueError):
    """An unknown policy for rows with the same key."""


def _pick(df: DataFrame, keys, order, last: bool) -> DataFrame:
    """One row per key by a window of which Spark keeps the first row of each key in every task before it shuffles."""
    names = order if isinstance(order, (list, tuple)) else [order]
    by = [F.desc_nulls_last(c) if last else F.asc_nulls_last(c) for c in names]
    numbered = df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return numbered.filter(F.col("__place") == 1).drop("__place")


def first_by_key(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key by a unique order; rows without order only where a key has no other."""
    return _pick(df, keys, order, last=False)


def last_by_key(df: DataFrame, keys, order) -> DataFrame:
    """The last row of each key by a unique order; rows without order only where a key has no other."""
    return _pick(df, keys, order, last=True)


def _conflict(columns) -> Column:
    """Two different values of any column in a group; NULLs do not count."""
    return reduce(lambda a, b: a | b, (
        F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in columns), F.lit(False))


def key_conflicts(df: DataFrame, keys, ignore=()) -> DataFrame:
    """Keys whose rows differ in a column, with their number of rows."""
    rest = [c for c in df.columns if c not in keys and c not in ignore]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), _conflict(rest).alias("__bad")).filter(
        "__bad").drop("__bad")


def check_keys(df: DataFrame, keys, order: str) -> DataFrame:
    """One row per key: equal duplicates collapse to the first; differing ones raise when the plan runs."""
    rest = [c for c in df.columns if c not in keys]
    compared = [c for c in rest if c != order]
    grouped = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), order)).alias("__row"), _conflict(compared).alias("__bad"))
    message = F.concat(F.lit("differing rows for key "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    checked = grouped.filter(F.when(F.col("__bad"), F.raise_error(message).cast("boolean")).otherwise(True))
    return checked.select(*(F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns))


def merge(stored: DataFrame, new: DataFrame, keys, order: str, policy: str = "check") -> DataFrame:
    """The table after feeding ``new`` rows under a policy.

    ``check`` raises on differing rows of one key (NULLs do not count),
    ``drop`` keeps what is there, ``overwrite`` and ``dropOld`` take the last.
    """
    keys = list(keys)
    new = new.select(*stored.columns)
    if policy == "check":
        both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        rank = both.withColumn("__rank", F.struct("__new", order)).drop("__new")
        rest = [c for c in stored.columns if c not in keys]
        compared = [c for c in rest if c != order]
        grouped = rank.groupBy(*keys).agg(
            F.min_by(F.struct(*rest), F.col("__rank")).alias("__row"), _conflict(compared).alias("__bad"))
        message = F.concat(
            F.lit("differing rows for key "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
        checked = grouped.filter(F.when(F.col("__bad"), F.raise_error(message).cast("boolean")).otherwise(True))
        return checked.select(*(F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in stored.columns))
    if policy == "drop":
        fresh = first_by_key(new, keys, order).join(stored.select(*keys), keys, "left_anti")
        return stored.unionByName(fresh.select(*stored.columns))
    if policy in ("overwrite", "dropOld"):
        latest = last_by_key(new, keys, order)
        kept = stored.join(latest.select(*keys), keys, "left_anti")
        return kept.select(*stored.columns).unionByName(latest)
    raise DuplicateKeyPolicyError(f"{policy} is none of {', '.join(POLICIES)}")


def replace_sources(stored: DataFrame, new: DataFrame, source: str = "source_id") -> DataFrame:
    """The table after all rows of the sources occurring in ``new`` were replaced."""
    touched = new.select(source).distinct()
    return stored.join(touched, source, "left_anti").select(*stored.columns).unionByName(
        new.select(*stored.columns))


def mark_deleted(old: DataFrame, new: DataFrame, keys, stamp: str, deleted: str, now) -> DataFrame:
    """Old records missing from ``new`` become deleted; only those newly deleted get a new time stamp."""
    keys = list(keys)
    values = [c for c in old.columns if c not in keys and c not in (stamp, deleted)]
    a = old.withColumn("__old", F.lit(True)).select(*keys, "__old", *(F.col(c).alias(f"__o_{c}") for c in
                                                                     [*values, stamp, deleted]))
    b = new.withColumn("__new", F.lit(True)).select(*keys, "__new", *(F.col(c).alias(f"__n_{c}") for c in
                                                                     [*values, stamp]))
    joined = a.join(b, keys, "full")
    present = F.col("__new").isNotNull()
    return joined.select(
        *keys,
        *(F.when(present, F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c) for c in values),
        F.when(present, F.col(f"__n_{stamp}")).when(F.col(f"__o_{deleted}"), F.col(f"__o_{stamp}"))
        .otherwise(now).alias(stamp),
        (~present).alias(deleted))


def orphans(child: DataFrame, parent: DataFrame, foreign_key: dict) -> DataFrame:
    """Rows of ``child`` whose reference (child column -> parent column) has no target; NULLs refer to nothing."""
    targets = parent.select(*(F.col(p).alias(f"__p_{p}") for p in foreign_key.values())).distinct()
    condition = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__p_{p}") for c, p in foreign_key.items()))
    given = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in foreign_key))
    return child.filter(given).join(targets, condition, "left_anti")


def violations(df: DataFrame, spec: TableSpec) -> Column:
    """Array of complaints about a row: missing values, values outside limits or options."""
    tests = []
    for c in spec.columns:
        if c.name not in df.columns:
            tests.append(F.lit(f"{c.name}: missing column"))
            continue
        value = F.col(c.name)
        if c.required:
            tests.append(F.when(value.isNull(), f"{c.name}: required"))
        if c.options:
            tests.append(F.when(~value.isin(list(c.options)), f"{c.name}: not an option"))
        if c.minimum is not None:
            tests.append(F.when(value < c.minimum, f"{c.name}: too small"))
        if c.maximum is not None:
            tests.append(F.when(value > c.maximum, f"{c.name}: too large"))
    if not tests:
        return F.array().cast("array<string>")
    return F.filter(F.array(*tests), lambda v: v.isNotNull())


def validate(df: DataFrame, spec: TableSpec, out: str = "violations") -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their complaints."""
    checked = df.withColumn(out, violations(df, spec))
    return checked.filter(F.size(out) == 0).drop(out), checked.filter(F.size(out) > 0)


def without_bad_sources(df: DataFrame, bad: Column, source: str) -> DataFrame:
    """Rows of the sources that have no bad row at all."""
    failed = df.filter(F.coalesce(bad, F.lit(False))).select(source).distinct()
    return df.join(failed, source, "left_anti").select(*df.columns)
