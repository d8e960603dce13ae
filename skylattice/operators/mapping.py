"""From raw rows of strings to typed rows of a declared table."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import literal_cast
from ..schema import TableSpec
from .predicates import ignore_on


def parse_assignments(text: str) -> list[tuple[str, str, bool]]:
    """``dest:src`` pairs; a source written ``@src`` may be missing.  Gives (dest, source, tolerant)."""
    pairs = []
    for item in re.split(r"[,\s]+", text.strip()):
        if item:
            dest, _, source = item.partition(":")
            source = source or dest
            pairs.append((dest, source.lstrip("@"), source.startswith("@")))
    return pairs


def null_on(value: Column, *literals) -> Column:
    """NULL where the value is one of the literals."""
    for literal in literals:
        value = F.nullif(value, F.lit(literal))
    return value


class RowMaker:
    """How a table's columns are made from a raw row.

    ``variables`` are worked out first, in order, then ``procedures``
    (functions from DataFrame to DataFrame), then the maps: ``simple`` maps
    (``dest:src dest:@src``), ``expressions`` (SQL text or columns by
    destination), and identity maps for destinations fitting ``id_maps``;
    explicit maps win.  Text is cast as the column type asks for.
    ``null_literals`` are NULL for their destination.
    """

    def __init__(self, spec: TableSpec, simple: str = "", expressions: dict | None = None, id_maps=(),
                 variables: dict | None = None, procedures: list[Callable[[DataFrame], DataFrame]] | None = None,
                 null_literals: dict | None = None, ignore=None, strict: bool = False):
        self.spec, self.simple, self.expressions = spec, simple, expressions or {}
        self.id_maps, self.variables, self.procedures = tuple(id_maps), variables or {}, procedures or []
        self.null_literals, self.ignore, self.strict = null_literals or {}, ignore, strict

    def _source(self, df: DataFrame, name: str) -> Column:
        spec = self.spec.column(name)
        if name in self.expressions:
            made = self.expressions[name]
            value = F.expr(made) if isinstance(made, str) else made
            return value.cast(spec.data_type)
        source, tolerant = None, False
        for dest, src, may_miss in parse_assignments(self.simple):
            if dest == name:
                source, tolerant = src, may_miss
        if source is None and any(fnmatch.fnmatchcase(name, p) for p in self.id_maps):
            source, tolerant = name, spec.default is not None
        if source is None:
            return F.lit(None).cast(spec.data_type)
        if source not in df.columns:
            if tolerant or spec.default is not None:
                return F.lit(None).cast(spec.data_type)
            raise KeyError(f"raw rows have no {source} for column {name}")
        value = F.col(source)
        if name in self.null_literals:
            value = null_on(value, *self.null_literals[name])
        if df.schema[source].dataType.typeName() != "string":
            return value.cast(spec.data_type)
        return literal_cast(value, spec.data_type, self.strict)

    def __call__(self, df: DataFrame) -> DataFrame:
        for name, made in self.variables.items():
            df = df.withColumn(name, F.expr(made) if isinstance(made, str) else made)
        for procedure in self.procedures:
            df = df.transform(procedure)
        if self.ignore is not None:
            df = ignore_on(df, self.ignore(df) if callable(self.ignore) else self.ignore)
        columns = []
        for spec in self.spec.columns:
            value = self._source(df, spec.name)
            if spec.default is not None:
                value = F.coalesce(value, F.lit(spec.default).cast(spec.data_type))
            columns.append(value.alias(spec.name, metadata=spec.metadata))
        return df.select(*columns)


def fix_up(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Columns rewritten after a query by SQL expressions."""
    return df.withColumns({name: F.expr(text) for name, text in expressions.items()})


def fan_out(df: DataFrame, role: str, makers: dict[str, Callable[[DataFrame], DataFrame]],
            check: bool = True) -> dict[str, DataFrame]:
    """One input to several tables by its role column; rows with other roles raise when a plan runs.

    Cache ``df`` first when it is expensive, as every table scans it.
    """
    if check:
        known = F.col(role).isin(list(makers))
        failure = F.raise_error(F.concat(F.lit("no table for role "), F.col(role))).cast("boolean")
        df = df.filter(F.when(known, True).otherwise(failure))
    return {name: maker(df.filter(F.col(role) == name).drop(role)) for name, maker in makers.items()}


def to_all(df: DataFrame, makers: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Every input row to every table."""
    return {name: maker(df) for name, maker in makers.items()}
