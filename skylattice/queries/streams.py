"""Streams over files written from the given tables."""

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import feeds, state
from .registry import query


def _event_files(t, name: str, parts: int = 4):
    """The events as files, and a stream over them."""
    path = scratch_path(t.spark, name)
    df = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    df.repartition(parts, "event_id").write.parquet(path)
    return path, feeds.new_files(t.spark, path, df.schema, max_files=1)


@query("r1_incremental_ingest", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def r1_incremental_ingest(t):
    path, stream = _event_files(t, "incoming")
    target, checkpoint = scratch_path(t.spark, "ingested"), scratch_path(t.spark, "progress")
    feeds.ingest(stream, target, checkpoint).awaitTermination()
    # a second run finds nothing new
    feeds.ingest(stream, target, checkpoint).awaitTermination()
    return t.spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("r2_stream_overwrite", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
                              "ORDER BY event_id DESC) AS r FROM events) q WHERE r = 1")
def r2_stream_overwrite(t):
    # all rows of a key are in one file here, so that the result does not hang on the order of batches
    path = scratch_path(t.spark, "incoming")
    df = t.events.select("user_id", "event_id", "event_type", "value")
    df.repartition(3, "user_id").write.parquet(path)
    stream = feeds.new_files(t.spark, path, df.schema, max_files=1)
    table = feeds.KeyedTable(t.spark, scratch_path(t.spark, "keyed"), ["user_id"], "event_id", "overwrite")
    feeds.upsert(stream, table, scratch_path(t.spark, "progress")).awaitTermination()
    return table.read()


@query("r2_stream_drop", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
                         "ORDER BY event_id) AS r FROM events) q WHERE r = 1")
def r2_stream_drop(t):
    path = scratch_path(t.spark, "incoming")
    df = t.events.select("user_id", "event_id", "event_type", "value")
    df.repartition(3, "user_id").write.parquet(path)
    stream = feeds.new_files(t.spark, path, df.schema, max_files=1)
    table = feeds.KeyedTable(t.spark, scratch_path(t.spark, "keyed"), ["user_id"], "event_id", "drop")
    feeds.upsert(stream, table, scratch_path(t.spark, "progress")).awaitTermination()
    table.compact(2)
    return table.read()


@query("r2_keyed_state", "SELECT user_id, event_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
                         "ORDER BY event_id DESC) AS r FROM events) q WHERE r = 1")
def r2_keyed_state(t):
    """The newest row of each user, kept in the stream's state; files come newest first, so most records are late."""
    path, checkpoint = scratch_path(t.spark, "incoming"), scratch_path(t.spark, "progress")
    df = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    df.repartitionByRange(3, F.desc("event_id")).write.parquet(path)
    stream = feeds.new_files(t.spark, path, df.schema, max_files=1)
    state.keep_keyed(stream, scratch_path(t.spark, "changes"), ["user_id"], "event_id", checkpoint, by_order=True).awaitTermination()
    return state.keyed_rows(t.spark, checkpoint, df.schema, ["user_id"])


@query("r3_single_inserts", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT -1, 'added'")
def r3_single_inserts(t):
    path = scratch_path(t.spark, "records")
    df = t.supplier.select("s_suppkey", "s_name")
    df.write.parquet(path)
    feeds.append_record(t.spark, path, {"s_suppkey": -1, "s_name": "added"}, df.schema)
    return t.spark.read.parquet(path)


@query("r4_change_feed", "SELECT event_id, user_id FROM events")
def r4_change_feed(t):
    path = scratch_path(t.spark, "changes")
    df = t.events.select("event_id", "user_id", "ts")
    # every record arrives twice
    df.unionByName(df).repartition(4, "event_id").write.parquet(path)
    stream = feeds.new_files(t.spark, path, df.schema)
    target = scratch_path(t.spark, "feed")
    feeds.ingest(feeds.change_feed(stream, "ts", "event_id", "60 days"), target, scratch_path(t.spark, "progress")).awaitTermination()
    return t.spark.read.parquet(target).select("event_id", "user_id")


@query("r4_settled_feed", "SELECT event_id, user_id FROM events")
def r4_settled_feed(t):
    path = scratch_path(t.spark, "changes")
    df = t.events.select("event_id", "user_id", "ts")
    # the newest records arrive first, the oldest long after any watermark, and all of them twice
    df.unionByName(df).repartitionByRange(4, F.desc("ts")).write.parquet(path)
    target = scratch_path(t.spark, "feed")
    stream = feeds.new_files(t.spark, path, df.schema, max_files=1)
    feeds.settled_feed(stream, target, "ts", "event_id", scratch_path(t.spark, "progress")).awaitTermination()
    return t.spark.read.parquet(target).select("event_id", "user_id")
