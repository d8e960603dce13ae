"""K1-K6: results written and read back."""

from pyspark.sql import functions as F

from ..functions.casts import to_float, to_int
from ..session import scratch_path
from ..sinks import tables as sinks
from ..sources import text
from .registry import query


@query("k1_csv", "SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS txt FROM documents")
def k1_csv(t):
    return sinks.csv_rows(t.documents.select("doc_id", F.col("text").alias("txt"))).select(F.col("doc_id").cast("bigint").alias("doc_id"), "txt")


@query("k1_csv_file", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def k1_csv_file(t):
    path = scratch_path(t.spark, "out.csv")
    sinks.write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path, header=True, params={"origin": "customer"})
    read = text.read_csv(t.spark, path)
    return read.select(to_int("c_custkey").alias("c_custkey"), "c_name", to_float("c_acctbal").alias("c_acctbal"))


@query("k2_tsv", "SELECT d.doc_id || chr(9) || lang || chr(9) || coalesce(CAST(quality AS VARCHAR), 'N/A') AS value FROM documents d "
                 "LEFT JOIN labels l ON d.doc_id = l.doc_id")
def k2_tsv(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return sinks.tsv_lines(joined)


@query("k2_padded", "SELECT rtrim(rpad(CAST(s_suppkey AS VARCHAR), CAST((SELECT max(length(CAST(s_suppkey AS VARCHAR))) FROM supplier) AS INT), ' ') || '  ' || "
                    "s_name) AS value FROM supplier")
def k2_padded(t):
    return sinks.padded_lines(t.supplier.select("s_suppkey", "s_name"))


@query("k3_json", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def k3_json(t):
    path = scratch_path(t.spark, "out.json")
    sinks.write_json(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path, params={"origin": "supplier"})
    return t.spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").json(f"{path}/rows")


@query("k4_table_write", "SELECT o_orderkey, o_custkey FROM orders")
def k4_table_write(t):
    path = scratch_path(t.spark, "table")
    t.orders.select("o_orderkey", "o_custkey").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return t.spark.read.parquet(path)


@query("k5_export_import", "SELECT * FROM part")
def k5_export_import(t):
    path = scratch_path(t.spark, "export")
    sinks.export_table(t.part, path)
    return t.spark.read.parquet(path)


@query("k6_votable_rows", "SELECT '<TR><TD>' || s_suppkey || '</TD><TD>' || s_name || ' &amp; co</TD><TD>' || strftime(TIMESTAMP '2001-02-03 04:05:06', "
                          "'%Y-%m-%dT%H:%M:%S') || '</TD></TR>' AS value FROM supplier")
def k6_votable_rows(t):
    rows = t.supplier.select("s_suppkey", F.concat("s_name", F.lit(" & co")).alias("name"), F.lit("2001-02-03 04:05:06").cast("timestamp_ntz").alias("d"))
    return sinks.votable_rows(rows)
