"""Uploads as queryable views, drafts of table definitions, user-written sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import TableSpec, spec_of


class UploadError(ValueError):
    """An upload that cannot be made a table."""


def check_upload(df: DataFrame) -> DataFrame:
    """Uploads need distinct (without regard to case), non-empty column names."""
    seen = set()
    for name in df.columns:
        if not name or not name.strip():
            raise UploadError("a column without a name")
        if name.lower() in seen:
            raise UploadError(f"duplicate column {name}")
        seen.add(name.lower())
    return df


def upload(df: DataFrame, name: str) -> DataFrame:
    """Registers a checked upload as a temporary view."""
    check_upload(df).createOrReplaceTempView(name)
    return df


def draft_spec(df: DataFrame, name: str) -> TableSpec:
    """A table definition drafted from what a scan found out."""
    return spec_of(check_upload(df), name)


def draft_text(spec: TableSpec) -> str:
    """The draft as text, a line per column."""
    lines = [f"table {spec.name}"]
    for c in spec.columns:
        parts = [c.name, c.data_type.simpleString()]
        parts += [f"{k}={v}" for k, v in (("unit", c.unit), ("ucd", c.ucd), ("description", c.description)) if v]
        lines.append("  " + " ".join(parts))
    return "\n".join(lines)


class _Piece(InputPartition):
    def __init__(self, value):
        self.value = value


class _GeneratorReader(DataSourceReader):
    def __init__(self, pieces, rows):
        self.pieces, self.rows = pieces, rows

    def partitions(self):
        return [_Piece(p) for p in self.pieces]

    def read(self, partition):
        yield from self.rows(partition.value)


def read_generator(spark: SparkSession, name: str, schema: str, pieces, rows) -> DataFrame:
    """A user-written source: ``rows(piece)`` yields the tuples of one piece; pieces are read in parallel.

    Pieces are descriptions (paths, ranges), not data.
    """
    pieces = list(pieces)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return _GeneratorReader(pieces, rows)

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def injected(spark: SparkSession, query: str, condition, **frames: DataFrame) -> DataFrame:
    """A fixed query over named tables with one more condition on its result."""
    return spark.sql(query, **frames).filter(condition)
