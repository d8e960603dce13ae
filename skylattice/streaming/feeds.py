"""Streams: incremental file ingest, upserts under key policies, change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import keys
from . import state


def new_files(spark: SparkSession, path: str, schema, file_format: str = "parquet", max_files: int | None = None,
              **options) -> DataFrame:
    """A stream of the rows of files not read before; what has been read is kept in the query's checkpoint."""
    reader = spark.readStream.format(file_format).schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def ingest(stream: DataFrame, target: str, checkpoint: str,
           transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends everything that is there now to a Parquet table, exactly once, and ends."""
    if transform is not None:
        stream = transform(stream)
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(target)


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class KeyedTable:
    """A table under a key policy, kept as a base and a log of batches.

    A batch writes its own rows only, to a place named by its number, so a
    batch that runs again replaces what it wrote before.  Readers merge base
    and log; :meth:`compact` turns both into a new base from time to time.
    Where a stream's state can hold the keys, ``state.keep_keyed`` does the
    same with no table to merge.
    """

    def __init__(self, spark: SparkSession, path: str, key_columns, order: str, policy: str = "overwrite"):
        if policy not in keys.POLICIES:
            raise keys.DuplicateKeyPolicyError(policy)
        self.spark, self.path, self.key_columns = spark, path.rstrip("/"), list(key_columns)
        self.order, self.policy = order, policy

    def _exists(self, name: str) -> bool:
        return _exists(self.spark, f"{self.path}/{name}")

    def _latest_base(self) -> int:
        """Number of the last batch inside the base; -1 without one."""
        if not self._exists("base"):
            return -1
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/base")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        numbers = [int(f.getPath().getName()[1:]) for f in system.listStatus(path)]
        done = [n for n in numbers if self._exists(f"base/v{n}/_SUCCESS")]
        return max(done, default=-1)

    def start(self, initial: DataFrame) -> None:
        """Makes ``initial`` the base; before any batch."""
        initial.write.mode("overwrite").parquet(f"{self.path}/base/v0")

    def feed(self, batch: DataFrame, batch_id: int) -> None:
        """Writes the rows of a batch, settled among themselves."""
        if self.policy == "check":
            settled = keys.check_keys(batch, self.key_columns, self.order)
            stored = self.read(before=batch_id)
            if stored is not None:
                touched = stored.join(settled.select(*self.key_columns), self.key_columns, "left_semi")
                settled = keys.merge(touched, settled, self.key_columns, self.order, "check")
        elif self.policy == "drop":
            settled = keys.first_by_key(batch, self.key_columns, self.order)
        else:
            settled = keys.last_by_key(batch, self.key_columns, self.order)
        settled.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id + 1}")

    def read(self, before: int | None = None) -> DataFrame | None:
        """The merged table, or what it was before a batch; None when nothing was written."""
        base = self._latest_base()
        parts = []
        if base >= 0:
            parts.append(self.spark.read.parquet(f"{self.path}/base/v{base}").withColumn("batch", F.lit(base)))
        if self._exists("log"):
            log = self.spark.read.parquet(f"{self.path}/log").filter(F.col("batch") > base)
            parts.append(log if before is None else log.filter(F.col("batch") <= before))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        pick = keys.first_by_key if self.policy in ("drop", "check") else keys.last_by_key
        return pick(rows, self.key_columns, ["batch", self.order]).drop("batch")

    def compact(self, last_batch: int) -> None:
        """Makes the table after a batch the new base."""
        state = self.read(before=last_batch + 1)
        if state is not None:
            state.write.mode("overwrite").parquet(f"{self.path}/base/v{last_batch + 1}")


def upsert(stream: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Feeds everything that is there now into a keyed table and ends."""
    return stream.writeStream.foreachBatch(table.feed).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def append_record(spark: SparkSession, path: str, record: dict, schema) -> None:
    """Adds one record to a table without key."""
    spark.createDataFrame([record], schema).write.mode("append").parquet(path)


def change_feed(stream: DataFrame, stamp: str, key: str, lateness: str = "1 hour") -> DataFrame:
    """Records as they change, each (key, time stamp) once within the lateness allowed.

    A record is late when its stamp lies more than ``lateness`` before the
    largest of the batches before; Spark leaves such records out.  Where late
    records must not be lost, use ``settled_feed``.
    """
    stamped = stream.withColumn("rec_ts", F.col(stamp).cast("timestamp"))
    return stamped.withWatermark("rec_ts", lateness).dropDuplicatesWithinWatermark([key, "rec_ts"]).drop("rec_ts")


def settled_feed(stream: DataFrame, path: str, stamp: str, key: str, checkpoint: str) -> StreamingQuery:
    """Feeds everything that is there now into a table with each (key, time stamp) once, however late a record comes.

    What has been seen is kept in the query's state on disk; a batch looks up its own records only.
    """
    with state.rocks_state(stream.sparkSession):
        return state.settled(stream, key, stamp).writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
