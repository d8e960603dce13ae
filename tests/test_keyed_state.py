import datetime

import pytest

from skylattice.operators.keys import DuplicateKeyPolicyError
from skylattice.streaming import feeds, state

SCHEMA = "k long, s string, n long, t timestamp_ntz, x double, m map<string,int>"
T0 = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)


class Feed:
    """Batches written one file each, read by a stream that goes on from its checkpoint."""

    def __init__(self, spark, folder, policy, **options):
        self.spark, self.folder, self.policy, self.options, self.n = spark, str(folder), policy, options, 0
        self.schema = spark.createDataFrame([], SCHEMA).schema

    def batch(self, *rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        stream = feeds.new_files(self.spark, f"{self.folder}/in", self.schema, max_files=1)
        query = state.keep_keyed(stream, f"{self.folder}/changes", ["k", "s"], "n", f"{self.folder}/progress", self.policy, **self.options)
        query.awaitTermination()
        return {(r["k"], r["s"]): r for r in state.keyed_rows(self.spark, f"{self.folder}/progress", self.schema, ["k", "s"]).collect()}


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_policies_across_restarts(spark, tmp_path, two_partitions):
    big = (1 << 60) + 1
    batches = [[(1, "a", 5, T0, 0.1, {"q": 1}), (1, "a", 7, None, None, None), (2, None, 1, None, 1e-300, None)],
               [(1, "a", 3, T0, 2.0, None), (None, "b", None, T0, 3.0, None), (3, "c", big, T0, 1 / 3, {})],
               [(3, "c", big - 1, None, 4.0, None), (2, None, 9, T0, 5.0, None), (2, None, 9, T0, 5.0, None)]]
    wanted = {("drop", False): {(1, "a"): 5, (2, None): 1, (None, "b"): None, (3, "c"): big},
              ("overwrite", False): {(1, "a"): 3, (2, None): 9, (None, "b"): None, (3, "c"): big - 1},
              ("overwrite", True): {(1, "a"): 7, (2, None): 9, (None, "b"): None, (3, "c"): big}}
    for (policy, by_order), orders in wanted.items():
        feed = Feed(spark, tmp_path / f"{policy}{by_order}", policy, by_order=by_order)
        for rows in batches:
            feed.batch(*rows)
            found = feed.run()  # a restart from the checkpoint each time
        assert {k: r["n"] for k, r in found.items()} == orders
        if policy == "drop":
            first = found[1, "a"]
            assert (first["t"], first["x"], first["m"]) == (T0, 0.1, {"q": 1}) and found[3, "c"]["x"] == 1 / 3
        changes = spark.read.parquet(f"{feed.folder}/changes").filter("batch = 2").count()
        assert changes == {("drop", False): 0, ("overwrite", False): 2, ("overwrite", True): 1}[policy, by_order]


def test_check_policy(spark, tmp_path, two_partitions):
    feed = Feed(spark, tmp_path, "check")
    feed.batch((1, "a", 1, T0, 2.0, None), (1, "a", 2, None, 2.0, None))
    assert feed.run()[1, "a"]["n"] == 1
    feed.batch((1, "a", 3, T0, 2.5, None))
    with pytest.raises(Exception, match="differing rows for key 1, a"):
        feed.run()
    with pytest.raises(DuplicateKeyPolicyError):
        state.keyed_changes(spark.createDataFrame([], SCHEMA), ["k"], "n", "any")


def test_settled_feed_takes_late_records_once(spark, tmp_path, two_partitions):
    schema = "k long, t timestamp_ntz"
    rows = [[(1, T0), (1, T0), (None, T0)], [(1, T0), (2, datetime.datetime(1990, 1, 1)), (None, None)], [(2, datetime.datetime(1990, 1, 1)), (None, T0), (None, None)]]
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.new_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, max_files=1)
        feeds.settled_feed(stream, str(tmp_path / "out"), "t", "k", str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, found)) == sorted(map(str, {r for batch in rows for r in spark.createDataFrame(batch, schema).collect()}))
