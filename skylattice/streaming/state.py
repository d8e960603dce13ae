"""Keyed tables and feeds kept in a stream's state.

The state of a query, on the RocksDB store and in its checkpoint, is the table: a batch looks up and changes its own keys
only, whatever is stored, and a batch that runs again after a failure finds the state as it was before.  The table can be read from the
checkpoint; what a batch changed goes to a sink as well.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.keys import POLICIES, DuplicateKeyPolicyError

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: rows go through the state as JSON that keeps every digit
_AS_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "true"}


@contextlib.contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _KeyPolicy(StatefulProcessor):
    """One row a key; ``place`` orders rows, those without order (``unplaced``) come first."""

    def __init__(self, policy: str, by_order: bool, ignored: str):
        self.policy, self.by_order, self.ignored = policy, by_order, ignored

    def init(self, handle) -> None:
        self.row = handle.getValueState("row", "placed boolean, place string, body string")

    def handleInputRows(self, key, rows, timerValues):
        held = self.row.get() if self.row.exists() else None
        best = None
        bodies = []
        for frame in rows:
            # the three columns behind the key; their names are not kept
            for placed, place, body in zip(*(frame.iloc[:, k] for k in (-3, -2, -1))):
                one = (bool(placed), place, body)
                first = self.policy in ("drop", "check")
                if best is None or (self._before(one, best) if first else self._before(best, one)):
                    best = one
                if self.policy == "check":
                    bodies.append(body)
        if best is None:
            return
        if self.policy == "check":
            self._check(key, [*([held[2]] if held else []), *bodies])
        if held is not None and (self.policy in ("drop", "check") or self.by_order and not self._before(tuple(held), best)):
            return
        self.row.update(best)
        yield pd.DataFrame({"__key": [key[0]], "__body": [best[2]]})

    @staticmethod
    def _before(a: tuple, b: tuple) -> bool:
        return (a[0], a[1]) < (b[0], b[1])

    def _check(self, key, bodies: list[str]) -> None:
        known: dict = {}
        for body in bodies:
            for name, value in json.loads(body).items():
                if name != self.ignored and known.setdefault(name, value) != value:
                    raise ValueError(f"differing rows for key {', '.join(map(str, json.loads(key[0]).values()))}")

    def close(self) -> None:
        pass


def _place(df: DataFrame, order: str) -> Column:
    """An order as text that sorts like it: numbers and times as digits of one length, negative ones turned."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.StringType):
        return F.col(order)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        number = F.unix_micros(F.col(order).cast("timestamp")).cast("decimal(38,0)")
    elif isinstance(kind, T.IntegralType):
        number = F.col(order).cast("decimal(38,0)")
    else:
        raise ValueError(f"rows cannot be ordered by {order}, a {kind.simpleString()}")
    return F.lpad((number + F.lit("10000000000000000000").cast("decimal(38,0)")).cast("string"), 22, "0")


def keyed_changes(stream: DataFrame, keys: list[str], order: str, policy: str = "overwrite", by_order: bool = False) -> DataFrame:
    """The rows that a stream puts into a table of one row a key, as they come in.

    ``drop`` keeps what is there, ``overwrite`` and ``dropOld`` take the last of a batch (with ``by_order`` only if it comes
    later in the order than what is there, so that late records change nothing), ``check`` raises on rows of a key that
    differ in a column other than ``order`` (NULLs do not count).
    """
    if policy not in POLICIES:
        raise DuplicateKeyPolicyError(policy)
    rest = [c for c in stream.columns if c not in keys]
    # keys are one text, as NULLs among several columns do not stay apart on their way to Python
    packed = stream.select(F.to_json(F.struct(*keys), _AS_JSON).alias("__key"), F.col(order).isNotNull().alias("__placed"),
                           F.coalesce(_place(stream, order), F.lit("")).alias("__place"), F.to_json(F.struct(*rest), _AS_JSON).alias("__body"))
    changed = packed.groupBy("__key").transformWithStateInPandas(
        _KeyPolicy(policy, by_order, order), "__key string, __body string", "Update", "None")
    return _unpacked(changed, stream.schema, keys)


def _unpacked(df: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    own, rest = (T.StructType([f for f in schema if (f.name in keys) == inside]) for inside in (True, False))
    rows = df.select(F.from_json("__key", own, _AS_JSON).alias("__k"), F.from_json("__body", rest, _AS_JSON).alias("__r"))
    return rows.select(*(F.col("__k" if c in keys else "__r")[c].alias(c) for c in schema.names))


def keep_keyed(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, policy: str = "overwrite",
               by_order: bool = False) -> StreamingQuery:
    """Feeds everything that is there now into the table in ``checkpoint`` and ends; ``path`` gets the rows each batch changed,
    in a folder of its number, so that a batch that runs again replaces its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    changes = keyed_changes(stream, keys, order, policy, by_order)
    with rocks_state(stream.sparkSession):
        return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_rows(spark: SparkSession, checkpoint: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The table as it is after the last batch, read from the state; ``schema`` is that of the stream."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "row").load()
    return _unpacked(state.select(F.col("key.__key").alias("__key"), F.col("value.body").alias("__body")), schema, keys)


def settled(stream: DataFrame, key: str, stamp: str) -> DataFrame:
    """Each (key, time stamp) once, however late a record comes; its state has every pair and no batch reads them all."""
    return stream.dropDuplicates([key, stamp])
