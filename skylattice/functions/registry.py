"""User functions: a registry of column functions with documentation, and the SQL function pack."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession


@dataclass(frozen=True)
class UserFunction:
    """A function for queries: either an SQL expression over its parameters, or Python making a Column."""

    name: str
    signature: str
    returns: str
    doc: str
    sql: str | None = None
    column: Callable[..., Column] | None = None
    unit: str | None = None
    ucd: str | None = None
    predicate: bool = False

    def __call__(self, *args) -> Column:
        if self.column is None:
            raise TypeError(f"{self.name} is only there in SQL")
        return self.column(*args)


FUNCTIONS: dict[str, UserFunction] = {}


def register(function: UserFunction) -> UserFunction:
    FUNCTIONS[function.name.lower()] = function
    return function


def user_function(name: str) -> UserFunction:
    return FUNCTIONS[name.lower()]


def install(spark: SparkSession, names=None) -> list[str]:
    """Makes functions known to ``spark.sql`` and gives their names: those named, or all with an SQL body.

    A named one without an SQL body, or that is not there, is an error.
    """
    done = []
    missing = [n for n in names or () if n.lower() not in FUNCTIONS or FUNCTIONS[n.lower()].sql is None]
    if missing:
        raise ValueError(f"no SQL body for {', '.join(missing)}")
    for key, f in FUNCTIONS.items():
        if f.sql is None and names is None:
            raise ValueError(f"{f.name} is only there as a column function; name the functions to install")
        if names is None or f.name in names:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({f.signature}) RETURNS {f.returns} "
                      f"RETURN {f.sql}")
            done.append(key)
    return done
