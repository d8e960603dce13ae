"""Table descriptions: typed columns with units, semantic labels and a key."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnSpec:
    """One column: type, null rule, unit, semantic label and where it shows up."""

    name: str
    type: T.DataType | str
    unit: str | None = None
    ucd: str | None = None
    utype: str | None = None
    description: str | None = None
    verb_level: int = 20
    required: bool = False
    default: object = None
    minimum: object = None
    maximum: object = None
    options: tuple = ()

    @property
    def data_type(self) -> T.DataType:
        return T._parse_datatype_string(self.type) if isinstance(self.type, str) else self.type

    @property
    def metadata(self) -> dict:
        pairs = {"unit": self.unit, "ucd": self.ucd, "utype": self.utype, "description": self.description,
                 "verbLevel": self.verb_level}
        return {key: value for key, value in pairs.items() if value is not None}

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.data_type, not self.required, self.metadata)


@dataclass(frozen=True)
class TableSpec:
    """A declared table: columns in order, primary key, duplicate policy, table-wide constants."""

    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    dupe_policy: str = "check"
    params: dict = field(default_factory=dict)

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def column(self, name: str) -> ColumnSpec:
        for spec in self.columns:
            if spec.name == name:
                return spec
        raise KeyError(name)

    def annotate(self, df: DataFrame) -> DataFrame:
        """``df`` with the declared columns carrying their metadata."""
        known = {c.name: c for c in self.columns}
        return df.select(*(F.col(c).alias(c, metadata=known[c].metadata) if c in known else F.col(c)
                           for c in df.columns))

    def with_params(self, df: DataFrame) -> DataFrame:
        """``df`` with the table-wide constants as literal columns."""
        return df.withColumns({key: F.lit(value) for key, value in self.params.items()})


def with_metadata(df: DataFrame, name: str, **pairs) -> DataFrame:
    return df.withMetadata(name, {**df.schema[name].metadata, **pairs})


def column_unit(df: DataFrame, name: str) -> str | None:
    return df.schema[name].metadata.get("unit")


def ucd_column(pattern: str, *frames: DataFrame) -> Column:
    """First column, in the order of the tables, whose UCD fits a shell pattern."""
    for df in frames:
        for f in df.schema.fields:
            if fnmatch.fnmatchcase(f.metadata.get("ucd", ""), pattern):
                return df[f.name]
    raise KeyError(f"no column with a UCD like {pattern}")


def column_by_ucds(df: DataFrame, *ucds: str) -> str:
    """The one column having the first UCD that occurs; several are an error."""
    for ucd in ucds:
        names = [f.name for f in df.schema.fields if f.metadata.get("ucd") == ucd]
        if len(names) == 1:
            return names[0]
        if names:
            raise KeyError(f"more than one column for {ucd}: {', '.join(names)}")
    raise KeyError(f"no column for any of {', '.join(ucds)}")


def select_columns(df: DataFrame, verb_level: int | None = None, patterns=(), names=(), extra=()) -> DataFrame:
    """Columns up to a verbosity level or by shell patterns or by names, plus extras, in table order."""
    chosen = []
    for f in df.schema.fields:
        by_level = verb_level is not None and f.metadata.get("verbLevel", 20) <= verb_level
        by_pattern = any(fnmatch.fnmatchcase(f.name, p) for p in patterns)
        if by_level or by_pattern or f.name in names or f.name in extra:
            chosen.append(f.name)
    missing = [n for n in (*names, *extra) if n not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {', '.join(missing)}")
    return df.select(*chosen)


def structure_differences(df: DataFrame, spec: TableSpec) -> list[str]:
    """How a stored table deviates from its definition; empty when it does not."""
    found, wanted = df.schema.fields, spec.schema().fields
    problems = []
    for position, want in enumerate(wanted):
        if position >= len(found):
            problems.append(f"{want.name}: missing")
        elif found[position].name != want.name:
            problems.append(f"{want.name}: found {found[position].name} in its place")
        elif found[position].dataType != want.dataType:
            problems.append(
                f"{want.name}: type {found[position].dataType.simpleString()}, "
                f"declared {want.dataType.simpleString()}")
    problems += [f"{extra.name}: not declared" for extra in found[len(wanted):]]
    return problems


def spec_of(df: DataFrame, name: str = "table") -> TableSpec:
    """A draft definition from the types and metadata of a table."""
    return TableSpec(name, tuple(
        ColumnSpec(f.name, f.dataType, f.metadata.get("unit"), f.metadata.get("ucd"), f.metadata.get("utype"),
                   f.metadata.get("description"), f.metadata.get("verbLevel", 20), not f.nullable)
        for f in df.schema.fields))
