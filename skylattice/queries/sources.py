"""The given tables written out in foreign formats and read back."""

import struct

import numpy as np
from pyspark.sql import functions as F

from ..functions.casts import to_float, to_int
from ..operators.limits import limited
from ..session import scratch_path
from ..sinks import tables as sinks
from ..sources import binary, files, fits, quoted, text, upload, votable
from ..sources.ranges import spread, write_bytes
from .registry import query


def _write_lines(df, path, line_sep="\n"):
    df.write.option("lineSep", line_sep).text(path)
    return path


def _write_binary(df, path, build):
    """Files made by ``build(pandas frame)``, written by the tasks into the shared folder.

    Names come from partition and batch number, so a task that runs again
    replaces its own files.
    """
    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if len(batch):
                name = f"{path}/{part}-{number}.bin"
                write_bytes(name, build(batch))
                yield pd.DataFrame({"file": [name]})

    # an action, as the files have to be there before they are read
    df.mapInPandas(run, "file string").count()
    return path


def _write_groups(df, path, group, order):
    """Text files by group: the lines of a group in order, in one file.

    Writing a file is much work for a few rows, so Spark is told the number of tasks.
    """
    spread(df, group, tasks=int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).sortWithinPartitions(group, order).select("value", group).write.partitionBy(group).text(path)
    return path


@query("s1_source_listing", "SELECT count(DISTINCT event_type) - 1 AS listed, count(DISTINCT event_type) - 2 AS fresh FROM events")
def s1_source_listing(t):
    path = scratch_path(t.spark, "listing")
    t.events.select("event_type", F.col("event_id").cast("string")).write.partitionBy("event_type").text(path)
    listed = files.list_sources(t.spark, path, "part-*", ignore_patterns=["*event_type=view/*"])
    kind = F.regexp_extract("path", "event_type=([a-z]+)", 1)
    loaded = listed.filter(kind == "click").select("path")
    fresh = files.list_sources(t.spark, path, "part-*", ignore_patterns=["*event_type=view/*"], loaded=loaded)
    count = F.count_distinct(kind)
    return listed.agg(count.alias("listed")).crossJoin(fresh.agg(count.alias("fresh")))


@query("s2_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s2_csv(t):
    path = scratch_path(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", "true").option("sep", ";").csv(path)
    rows = text.read_csv(t.spark, path, delimiter=";")
    return rows.select(to_int("c_custkey").alias("c_custkey"), "c_name", to_float("c_acctbal").alias("c_acctbal"), "c_mktsegment")


@query("s2_csv_skipped_lines", "SELECT s_suppkey, s_name FROM supplier")
def s2_csv_skipped_lines(t):
    path = scratch_path(t.spark, "csv")
    # files of a hundred suppliers with two lines of preface each
    group = F.floor(F.col("s_suppkey") / 100).alias("g")
    body = t.supplier.select(group, F.col("s_suppkey").alias("o"), F.concat_ws(",  ", "s_suppkey", "s_name").alias("value"))
    preface = body.select("g").distinct().select("g", F.explode(F.array(F.lit(-2), F.lit(-1))).alias("o"),
                                                 F.lit("a preface, not data").alias("value"))
    _write_groups(body.unionByName(preface), path, "g", "o")
    read = text.read_csv(t.spark, path, ["key", "name"], strip=True, top_ignored=2)
    return read.select(to_int("key").alias("s_suppkey"), F.col("name").alias("s_name"))


@query("s2_quoted_newlines", "SELECT doc_id, coalesce(text, '') || chr(10) || '\"the end\", said ' || lang AS text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source "
                             "FROM documents")
def s2_quoted_newlines(t):
    """Whole texts as quoted fields, each over many lines, in files that are read in blocks."""
    path = scratch_path(t.spark, "csv")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit('\n"the end", said '), "lang")
    line = F.concat("doc_id", F.lit(',"'), F.replace(body, F.lit('"'), F.lit('""')), F.lit('",'), F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise(""))
    _write_lines(t.documents.select(line.alias("value")), path)
    read = quoted.read_quoted(t.spark, path, ["doc_id", "text", "source"], block_bytes=1 << 20)
    return read.select(to_int("doc_id").alias("doc_id"), "text", "source")


@query("s3_fixed_columns", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def s3_fixed_columns(t):
    path = scratch_path(t.spark, "columns")
    line = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, " "), "o_orderstatus", F.rpad("o_orderpriority", 15, " "), F.lit(" rest"))
    comment = F.concat(F.lit("# order "), "o_orderkey")
    _write_lines(t.orders.select(F.explode(F.array(comment, line)).alias("value")), path)
    read = text.read_columns(t.spark, path, "key: -12, status: 13, priority: 14-28, rest: 30-", comment="#")
    return read.filter("rest = 'rest'").select(to_int("key").alias("o_orderkey"), F.col("status").alias("o_orderstatus"),
                                               F.col("priority").alias("o_orderpriority"))


@query("s4_pattern_records", "SELECT p_partkey, p_size, p_brand FROM part")
def s4_pattern_records(t):
    path = scratch_path(t.spark, "records")
    record = F.concat(F.lit("part="), F.concat_ws(" | ", "p_partkey", "p_size", "p_brand"), F.lit(" % remark"))
    _write_lines(t.part.select(record.alias("value")), path, line_sep=";;")
    read = text.read_records(t.spark, path, ["key", "size", "brand"], record_sep=";;", field_sep=r"\s*\|\s*", comment=r"%.*",
                             cleaner=r"part=(\d+ \|)(.*)")
    return read.select(to_int("key").alias("p_partkey"), to_int("size", kind="int").alias("p_size"), F.col("brand").alias("p_brand"))


@query("s4_top_lines", "SELECT s_suppkey, s_nationkey FROM supplier")
def s4_top_lines(t):
    path = scratch_path(t.spark, "records")
    # two lines of a heading in front of the first record, which begins in the middle of the third
    heading = F.when(F.col("s_suppkey") % 100 == 0, F.lit("a b;c\nd e;f\n")).otherwise(F.lit(""))
    value = F.concat(heading, F.concat_ws(" ", "s_suppkey", "s_nationkey"))
    rows = t.supplier.select(F.floor(F.col("s_suppkey") / 100).alias("g"), F.col("s_suppkey").alias("o"), value.alias("value"))
    joined = rows.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda r: r["value"]), ";").alias("value"))
    joined.select("value", "g").write.partitionBy("g").option("lineSep", ";").text(path)
    first = t.supplier.agg(F.min(F.col("s_suppkey") % 100)).first()[0]
    read = text.read_records(t.spark, path, ["key", "nation"], record_sep=";", top_ignored=2 if first == 0 else 0)
    return read.select(to_int("key").alias("s_suppkey"), to_int("nation", kind="int").alias("s_nationkey"))


@query("s4_stop_pattern", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 100 < 50")
def s4_stop_pattern(t):
    path = scratch_path(t.spark, "records")
    # in each file of a hundred suppliers, what comes after the fiftieth does not count
    line = F.concat_ws(" ", F.when(F.col("s_suppkey") % 100 == 50, "END").otherwise(F.lit("row")), "s_suppkey")
    rows = t.supplier.select(F.floor(F.col("s_suppkey") / 100).alias("g"), F.col("s_suppkey").alias("o"), line.alias("value"))
    _write_groups(rows, path, "g", "o")
    read = text.read_records(t.spark, path, ["kind", "key"], stop="^END")
    return read.select(to_int("key").alias("s_suppkey"))


@query("s5_free_records", "SELECT event_id, user_id FROM events")
def s5_free_records(t):
    path = scratch_path(t.spark, "free")
    _write_lines(t.events.select(F.concat(F.lit("<e id="), "event_id", F.lit(" user="), "user_id", F.lit(">")).alias("value")), path)
    read = text.read_free(t.spark, path, r"<e [^>]*>", r"id=(?P<event>\d+) user=(?P<user>\d+)", separator="\n")
    return read.select(to_int("event").alias("event_id"), to_int("user").alias("user_id"))


@query("s6_key_values", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def s6_key_values(t):
    path = scratch_path(t.spark, "kv")
    # one file per record
    body = F.concat(F.lit("key = "), "s_suppkey", F.lit("\nNAME: "), "s_name", F.lit("  ; a remark\n\nnation = "), "s_nationkey")
    _write_groups(t.supplier.select("s_suppkey", body.alias("value"), F.lit(0).alias("o")), path, "s_suppkey", "o")
    read = text.read_key_values(t.spark, path, ["key", "name", "nation"], comment=r"\s*;.*", rename={"NAME": "name"})
    return read.select(to_int("key").alias("s_suppkey"), F.col("name").alias("s_name"),
                       to_int("nation", kind="int").alias("s_nationkey"))


@query("s6_pairs", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def s6_pairs(t):
    path = scratch_path(t.spark, "pairs")
    number = F.regexp_extract("props", "[0-9]+", 0)
    _write_lines(t.events.select(F.concat(F.lit("e"), "event_id", F.lit(" : "), number).alias("value")), path)
    read = text.read_pairs(t.spark, path)
    return read.select(F.expr("CAST(substring(key, 2) AS BIGINT)").alias("event_id"), to_int("value").alias("k"))


@query("s7_split_rows", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS price FROM lineitem")
def s7_split_rows(t):
    path = scratch_path(t.spark, "split")
    price = F.when(F.col("l_linenumber") == 3, F.lit("\\N")).otherwise(F.col("l_extendedprice").cast("string"))
    good = F.concat_ws("|", "l_orderkey", "l_linenumber", price)
    bad = F.when(F.col("l_orderkey") % 100 == 0, F.lit("not a number|1|2"))
    _write_lines(t.lineitem.select(F.explode(F.array_compact(F.array(good, bad))).alias("value")), path)
    return text.read_split(t.spark, path, "l_orderkey bigint, l_linenumber int, price double")


@query("s8_binary_records", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def s8_binary_records(t):
    layout, _ = binary.record_layout("key(q) line(h) quantity(d) flag(4s)", "big")

    def build(frame):
        records = np.zeros(len(frame), dtype=layout)
        records["key"], records["line"] = frame["l_orderkey"], frame["l_linenumber"]
        records["quantity"], records["flag"] = frame["l_quantity"], frame["l_returnflag"].str.encode("ascii")
        return b"HEADER" + records.tobytes()

    path = _write_binary(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), scratch_path(t.spark, "binary"), build)
    read = binary.read_records(t.spark, path, "key(q) line(h) quantity(d) flag(4s)", "big", skip_bytes=6, chunk_bytes=200_000)
    return read.select(F.col("key").alias("l_orderkey"), F.col("line").cast("int").alias("l_linenumber"),
                       F.col("quantity").alias("l_quantity"), F.col("flag").alias("l_returnflag"))


@query("s9_fortran_records", "SELECT o_orderkey, o_totalprice FROM orders")
def s9_fortran_records(t):
    def build(frame):
        return b"".join(struct.pack("<iqdi", 16, k, p, 16) for k, p in zip(frame["o_orderkey"], frame["o_totalprice"]))

    path = _write_binary(t.orders.select("o_orderkey", "o_totalprice"), scratch_path(t.spark, "fortran"), build)
    read = binary.read_fortran_records(t.spark, path, "key(q) price(d)", chunk_records=1000)
    return read.select(F.col("key").alias("o_orderkey"), F.col("price").alias("o_totalprice"))


@query("s9_text_records", "SELECT doc_id, n_chars FROM documents")
def s9_text_records(t):
    """Records of very different lengths, whole texts behind two numbers."""
    def build(frame):
        out = []
        for key, n, body in zip(frame["doc_id"], frame["n_chars"], frame["text"]):
            data = struct.pack(">qq", key, n) + (body or "").encode()
            out.append(struct.pack(">I", len(data)) + data + struct.pack(">I", len(data)))
        return b"TITLE" + b"".join(out)

    path = _write_binary(t.documents.select("doc_id", "n_chars", "text"), scratch_path(t.spark, "fortran"), build)
    read = binary.read_fortran_records(t.spark, path, "key(q) n(q)", "big", skip_bytes=5, block_bytes=1 << 20)
    return read.select(F.col("key").alias("doc_id"), F.col("n").alias("n_chars"))


@query("s10_mysql_dump", "SELECT c_custkey, 'it''s; (' || c_name || '), ok' AS label, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS bal "
                         "FROM customer")
def s10_mysql_dump(t):
    path = scratch_path(t.spark, "dump")
    row = F.concat(F.lit("("), "c_custkey", F.lit(",'it\\'s; ("), "c_name", F.lit("), ok',"),
                   F.when(F.col("c_custkey") % 3 == 0, F.lit("NULL")).otherwise(F.col("c_acctbal").cast("string")), F.lit(")"))
    inserts = t.customer.groupBy(F.floor(F.col("c_custkey") / 500).alias("g")).agg(F.array_join(F.collect_list(row), ",").alias("rows")).select(
        F.concat(F.lit("INSERT INTO `c` VALUES "), "rows").alias("value"))
    create = t.region.filter("r_regionkey = 0").select(
        F.lit("CREATE TABLE `c` (\n  `id` int,\n  `label` varchar(99),\n  `bal` double,\n  PRIMARY KEY (`id`)\n)").alias("value"))
    _write_lines(create.unionByName(inserts), path, line_sep=";\n")
    read = text.read_mysql_dump(t.spark, path)
    return read.select(to_int("id").alias("c_custkey"), "label", to_float("bal").alias("bal"))


@query("s10_long_strings", "SELECT doc_id, text || ';' || chr(10) || 'it''s the end' AS text FROM documents")
def s10_long_strings(t):
    """Whole texts in a dump, with the end of a statement inside each string, and another table's rows between."""
    path = scratch_path(t.spark, "dump")
    escaped = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    row = F.concat(F.lit("("), "doc_id", F.lit(",'"), escaped, F.lit(";\nit\\'s the end')"))
    grouped = t.documents.groupBy(F.floor(F.col("doc_id") / 40).alias("g")).agg(F.array_join(F.collect_list(row), ",").alias("rows"))
    inserts = grouped.select(F.explode(F.array(F.concat(F.lit("INSERT INTO `docs` VALUES "), "rows"), F.concat(
        F.lit("INSERT INTO `other` VALUES ("), F.col("g").cast("string"), F.lit(",'x')")))).alias("value"))
    create = t.region.filter("r_regionkey = 0").select(F.explode(F.array(
        F.lit("CREATE TABLE `docs` (\n  `id` int,\n  `body` text\n)"))).alias("value"))
    _write_lines(create.unionByName(inserts), path, line_sep=";\n")
    return text.read_mysql_dump(t.spark, path).select(to_int("id").alias("doc_id"), F.col("body").alias("text"))


@query("s11_votable", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def s11_votable(t):
    path = scratch_path(t.spark, "votable")
    rows = t.supplier.select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    sinks.write_votable(rows, path)
    fields = votable.read_fields(t.spark, f"{path}/head")
    return votable.read_votable(t.spark, f"{path}/rows", fields)


@query("s11_votable_document", "SELECT s_suppkey, s_name || ' & <co>' AS label FROM supplier")
def s11_votable_document(t):
    path = scratch_path(t.spark, "votable")
    # documents of a hundred suppliers with two tables each, of which the second does not count
    named = t.supplier.select("s_suppkey", F.concat("s_name", F.lit(" & <co>")).alias("label"))
    rows = named.select(F.floor(F.col("s_suppkey") / 100).alias("g"), F.concat(
        F.lit("<TR><TD>"), "s_suppkey", F.lit("</TD><TD>"), F.replace(F.replace("label", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit("</TD></TR>")).alias("value"))
    bodies = rows.groupBy("g").agg(F.array_join(F.collect_list("value"), "").alias("body"))
    field = ("<FIELD name='s_suppkey' datatype='long' ucd='meta.id'/><FIELD name='label' datatype='char' arraysize='*'>"
             "<DESCRIPTION>x</DESCRIPTION></FIELD>")
    start, end = f"<TABLE>{field}<DATA><TABLEDATA>", "</TABLEDATA></DATA></TABLE>"
    document = F.concat(F.lit(f"<?xml version='1.0'?><VOTABLE><RESOURCE>{start}"), "body",
                        F.lit(end + start + "<TR><TD>99</TD><TD/></TR>" + end + "</RESOURCE></VOTABLE>"))
    _write_groups(bodies.select("g", document.alias("value"), F.lit(0).alias("o")), path, "g", "o")
    return votable.read_votable(t.spark, path)


def _card(key, value):
    return f"{key:<8}= {value:>20}".ljust(80)


def _header(cards) -> bytes:
    body = "".join(cards) + "END".ljust(80)
    return body.ljust((len(body) + 2879) // 2880 * 2880).encode("ascii")


def _padded(data: bytes) -> bytes:
    return data.ljust((len(data) + 2879) // 2880 * 2880, b"\0")


_PRIMARY = [_card("SIMPLE", "T"), _card("BITPIX", "8"), _card("NAXIS", "0")]


@query("s12_fits_headers", "SELECT s_suppkey, s_name, ra, dec FROM {sky_b} s")
def s12_fits_headers(t):
    # one small file per supplier

    def build_one(row):
        return _header(_PRIMARY + [_card("OBJ-ID", str(row.s_suppkey)), f"OBJECT  = '{row.s_name}'   / name".ljust(80),
                                   _card("CRVAL1", repr(row.ra)), _card("CRVAL2", repr(row.dec))])

    path = scratch_path(t.spark, "fits")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples():
                write_bytes(f"{path}/{row.s_suppkey}.fits", build_one(row))
            yield pd.DataFrame({"n": [len(batch)]})

    rows = t.sky_b.select("s_suppkey", "s_name", "ra", "dec")
    spread(rows, "s_suppkey", tasks=int(t.spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, "n bigint").count()
    read = fits.read_headers(t.spark, path, ["OBJ-ID", "OBJECT", "CRVAL1", "CRVAL2"], pattern="*.fits")
    return read.select(to_int("OBJ_ID").alias("s_suppkey"), F.col("OBJECT").alias("s_name"), to_float("CRVAL1").alias("ra"),
                       to_float("CRVAL2").alias("dec"))


@query("s13_fits_table", "SELECT c_custkey, c_name, ra, dec FROM {sky_a} s")
def s13_fits_table(t):
    layout = np.dtype([("id", ">i8"), ("name", "S20"), ("pos", ">f8", (2,))])

    def build(frame):
        records = np.zeros(len(frame), dtype=layout)
        records["id"], records["name"] = frame["c_custkey"], frame["c_name"].str.encode("ascii")
        records["pos"][:, 0], records["pos"][:, 1] = frame["ra"], frame["dec"]
        cards = ["XTENSION= 'BINTABLE'".ljust(80), _card("BITPIX", "8"), _card("NAXIS", "2"), _card("NAXIS1", str(layout.itemsize)),
                 _card("NAXIS2", str(len(frame))), _card("PCOUNT", "0"), _card("GCOUNT", "1"), _card("TFIELDS", "3")]
        for i, (form, name) in enumerate((("1K", "id"), ("20A", "name"), ("2D", "pos")), 1):
            cards += [f"TFORM{i}  = '{form:<8}'".ljust(80), f"TTYPE{i}  = '{name:<8}'".ljust(80)]
        return _header(_PRIMARY) + _header(cards) + _padded(records.tobytes())

    path = _write_binary(t.sky_a.select("c_custkey", "c_name", "ra", "dec"), scratch_path(t.spark, "bintable"), build)
    read = fits.read_table(t.spark, path, chunk_bytes=20_000)
    return read.select(F.col("id").alias("c_custkey"), F.col("name").alias("c_name"), F.col("pos")[0].alias("ra"), F.col("pos")[1].alias("dec"))


@query("s14_rows_in_memory", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders WHERE o_orderstatus IN ('O', 'F')")
def s14_rows_in_memory(t):
    codes = text.rows_of_tuples(t.spark, [{"o_orderstatus": "O", "code": 1}, {"o_orderstatus": "F", "code": 2}])
    return t.orders.join(codes, "o_orderstatus").select("o_orderkey", F.col("code").cast("int").alias("code"))


@query("s15_user_source", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 50")
def s15_user_source(t):
    path = f"{t.sf_dir}/lineitem.parquet"

    def rows(piece):
        import pyarrow.parquet as pq

        at, group = piece
        table = pq.ParquetFile(at).read_row_group(group, columns=["l_orderkey", "l_linenumber", "l_quantity"])
        for key, line, quantity in zip(*(c.to_pylist() for c in table.columns)):
            if quantity == 50:
                yield key, line

    import pyarrow.parquet as pq

    groups = [(path, g) for g in range(pq.ParquetFile(path).num_row_groups)]
    return upload.read_generator(t.spark, "lineitem_rows", "l_orderkey bigint, l_linenumber int", groups, rows)


@query("s16_upload", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c_acctbal > 9000")
def s16_upload(t):
    uploaded = t.customer.filter("c_acctbal > 9000").select("c_custkey", "c_nationkey")
    upload.upload(uploaded, "upload_customers")
    return t.spark.sql("SELECT u.c_custkey, n.n_name FROM upload_customers u JOIN {n} n ON u.c_nationkey = n.n_nationkey", n=t.nation)


@query("s17_source_constants", "SELECT p_partkey, 'run 7' AS run, 3 AS version FROM part")
def s17_source_constants(t):
    return files.with_constants(t.part.select("p_partkey"), run="run 7", version=3)


@query("s18_source_columns", "SELECT event_type AS folder, 'part' AS head, count(*) AS n, TRUE AS sized FROM events GROUP BY event_type")
def s18_source_columns(t):
    path = scratch_path(t.spark, "described")
    t.events.select(F.col("event_id").cast("string"), F.col("event_type").alias("kind")).write.partitionBy("kind").text(path)
    rows = files.with_source_columns(t.spark.read.option("recursiveFileLookup", "true").text(path), base=path)
    folder = F.regexp_extract("source_path", "^kind=([a-z]+)/[^/]*$", 1)
    tail = files.last_elements(F.col("source_path"), 2)
    return rows.groupBy(folder.alias("folder"), F.substring("source_stem", 1, 4).alias("head")).agg(
        F.count("*").alias("n"), F.bool_and((F.col("source_size") > 0) & (tail == F.col("source_path"))).alias("sized"))


@query("s19_fixed_sql", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def s19_fixed_sql(t):
    return t.spark.sql("SELECT o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1", orders=t.orders)


@query("s20_injected_where", "SELECT o_custkey, total FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) q WHERE o_custkey < 50")
def s20_injected_where(t):
    sql = "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey"
    return upload.injected(t.spark, sql, F.col("o_custkey") < 50, orders=t.orders)


@query("s21_row_cap", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 500")
def s21_row_cap(t):
    return limited(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), 500, "l_orderkey", "l_linenumber", "l_partkey")


@query("s22_prefilter", "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def s22_prefilter(t):
    path = scratch_path(t.spark, "piped")
    _write_lines(t.supplier.select(F.concat_ws(",", "s_suppkey", "s_name").alias("value")), path)
    lines = files.prefiltered_lines(t.spark, files.list_sources(t.spark, path, "part-*"), "tr a-z A-Z")
    parts = F.split("value", ",")
    return lines.select(to_int(parts[0]).alias("s_suppkey"), parts[1].alias("s_name"))


@query("s22_codec", "SELECT c_custkey FROM customer")
def s22_codec(t):
    path = scratch_path(t.spark, "packed")
    t.customer.select(F.col("c_custkey").cast("string").alias("value")).write.option("compression", "gzip").text(path)
    return t.spark.read.text(path).select(to_int("value").alias("c_custkey"))


@query("s23_image_pixels", "SELECT y, x + 1 AS x, round(value::DOUBLE, 6) AS value FROM {pixels} p")
def s23_image_pixels(t):
    def build(frame):
        rows = np.stack([np.asarray(v, dtype=">f4") for v in frame["embedding"]])
        # the row number travels as an extra, first pixel
        marked = np.concatenate([frame["vec_id"].to_numpy().astype(">f4")[:, None], rows], axis=1).astype(">f4")
        cards = [_card("SIMPLE", "T"), _card("BITPIX", "-32"), _card("NAXIS", "2"), _card("NAXIS1", str(marked.shape[1])),
                 _card("NAXIS2", str(marked.shape[0])), _card("BSCALE", "2.0"), _card("BZERO", "0.0")]
        return _header(cards) + _padded(marked.tobytes())

    path = _write_binary(t.embeddings.select("vec_id", "embedding"), scratch_path(t.spark, "image"), build)
    rows = fits.read_image_rows(t.spark, path, chunk_bytes=10_000)
    found = fits.pixels(rows.withColumn("y", (F.col("values")[0] / 2).cast("bigint")))
    return found.filter("x > 1").select("y", (F.col("x") - 1).alias("x"), F.round(F.col("value") / 2, 6).alias("value"))


@query("s24_tsv", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def s24_tsv(t):
    path = scratch_path(t.spark, "tsv")
    full = F.concat_ws("\t", "c_custkey", "c_name", "c_nationkey")
    line = F.when(F.col("c_acctbal") < 0, F.concat_ws("\t", "c_custkey", "c_name")).otherwise(full)
    _write_lines(t.customer.select(F.explode(F.array(F.lit("# comment"), F.lit("  "), line)).alias("value")), path)
    read = text.read_tsv(t.spark, path, ["a", "b", "c"])
    return read.select(to_int("a").alias("c_custkey"), F.col("b").alias("c_name"), to_int("c", kind="int").alias("c_nationkey"))


@query("s25_parameter_rows", "SELECT p_partkey, p_size FROM part WHERE (p_size = 3 AND p_brand = 'Brand#1') OR (p_size = 4 AND p_brand = 'Brand#2') "
                             "OR (p_size = 5 AND p_brand = 'Brand#1')")
def s25_parameter_rows(t):
    wanted = text.rows_of_params(t.spark, {"p_size": [3, 4, 5], "p_brand": ["Brand#1", "Brand#2"], "note": "x"}, "p_size")
    wanted = wanted.withColumn("p_size", F.col("p_size").cast("int"))
    return t.part.join(wanted, ["p_size", "p_brand"]).select("p_partkey", "p_size")
