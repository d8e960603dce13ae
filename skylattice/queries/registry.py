"""The registered queries: name -> (function of the tables, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Tables(spark, sf_dir))


def sky(df: DataFrame, key: str, ra_step: int = 7919, dec_step: int = 104729) -> DataFrame:
    """Positions spread over the sphere by integer arithmetic on a key."""
    return df.withColumns({
        "ra": (F.col(key) * ra_step % 36000) / 100.0,
        "dec": (F.col(key) * dec_step % 18001) / 100.0 - 90.0})


class Tables:
    """The given tables and the sky fixtures derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def sky_a(self) -> DataFrame:
        return sky(self.customer, "c_custkey")

    @property
    def sky_b(self) -> DataFrame:
        return sky(self.supplier, "s_suppkey", 6101, 99991)

    @property
    def images(self) -> DataFrame:
        """Images with centre, size in degrees and the footprint's corners."""
        from ..functions import regions

        df = sky(self.part, "p_partkey").withColumn("size", F.col("p_size") / 10.0)
        return df.withColumn("coverage", regions.box("ra", "dec", F.col("size"), F.col("size")))

    @property
    def intervals(self) -> DataFrame:
        from ..functions import times

        return self.lineitem.select(
            "l_orderkey", "l_linenumber", times.mjd("l_shipdate").alias("lo"),
            (times.mjd("l_shipdate") + F.col("l_quantity")).alias("hi"))

    @property
    def spectra(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("spectrum_id"), F.col("l_linenumber").cast("double").alias("spectral"),
            F.col("l_extendedprice").alias("flux"), F.col("l_tax").alias("error"))

    @property
    def pixels(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value"))

    @property
    def keyed(self) -> DataFrame:
        return self.events.select("user_id", "event_id", "event_type", "value")


def dist_sql(ra1: str, dec1: str, ra2, dec2) -> str:
    """The great-circle distance in SQL."""
    return (f"degrees(2 * asin(least(1.0, sqrt(pow(sin(radians({dec2} - ({dec1})) / 2), 2) + cos(radians({dec1})) * "
            f"cos(radians({dec2})) * pow(sin(radians({ra2} - ({ra1})) / 2), 2)))))")


def mjd_sql(ts: str) -> str:
    return f"(epoch_us({ts}) / 86400e6 + 40587)"


def _sky_sql(table: str, key: str, ra_step: int = 7919, dec_step: int = 104729) -> str:
    return (f"(SELECT *, ({key} * {ra_step} % 36000) / 1e2 AS ra, ({key} * {dec_step} % 18001) / 1e2 - 90 AS dec "
            f"FROM {table})")


FRAGMENTS = {
    "{sky_a}": _sky_sql("customer", "c_custkey"),
    "{sky_b}": _sky_sql("supplier", "s_suppkey", 6101, 99991),
    "{sky_part}": _sky_sql("part", "p_partkey"),
    "{intervals}": f"(SELECT l_orderkey, l_linenumber, {mjd_sql('l_shipdate')} AS lo, "
                   f"{mjd_sql('l_shipdate')} + l_quantity AS hi FROM lineitem)",
    "{spectra}": "(SELECT l_orderkey AS spectrum_id, CAST(l_linenumber AS DOUBLE) AS spectral, "
                 "l_extendedprice AS flux, l_tax AS error FROM lineitem)",
    "{pixels}": "(SELECT vec_id AS y, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS x "
                "FROM embeddings)",
    "{keyed}": "(SELECT user_id, event_id, event_type, value FROM events)",
}

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of :class:`Tables`; ``{...}`` fixtures in the SQL are filled in."""
    def wrap(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} is there already")
        text = sql
        if text is not None:
            for mark, fragment in FRAGMENTS.items():
                text = text.replace(mark, fragment)
        REGISTRY[name] = Query(name, run, text)
        return run
    return wrap
