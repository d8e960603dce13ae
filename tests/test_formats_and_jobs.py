"""Sources and sinks on hand-made files, data set jobs, streams, registered queries."""

import importlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from skylattice.plans import catalogue, pixels, products, spectra
from skylattice.sinks import tables as sinks
from skylattice.sources import binary, text, upload, votable
from skylattice.streaming import feeds


def _write(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "wb") as out:
        out.write(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fixed_columns(spark, tmp_path):
    path = _write(tmp_path, "a.txt", "# head\nabc  12 x\n\nd      7 yz\n")
    assert _rows(text.read_columns(spark, path, "a: 1-4, b: 5-8, c: 9-", comment="#")) == [("abc", "12", "x"), ("d", "7", "yz")]
    assert text.column_ranges("a: -3, b: 5, c: 7-") == {"a": (1, 3), "b": (5, 5), "c": (7, None)}


def test_records(spark, tmp_path):
    path = _write(tmp_path, "a.txt", "a 1\nb 2\nEND\nc 3\n")
    assert _rows(text.read_records(spark, path, ["x", "y"], stop="^END")) == [("a", "1"), ("b", "2")]
    with pytest.raises(Exception, match="record without 2 fields"):
        text.read_records(spark, path, ["x", "y"]).collect()
    assert len(_rows(text.read_records(spark, path, ["x", "y"], lax=True))) == 4
    by_pattern = text.read_records(spark, path, ["x", "y"], record_sep=r"\n(?:END\n)?")
    assert _rows(by_pattern) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_free_records(spark, tmp_path):
    path = _write(tmp_path, "a.txt", "x=1;\ny=2;\n")
    read = text.read_free(spark, path, r"\w=\d+;\n", r"(?P<key>\w)=(?P<value>\d+)")
    assert _rows(read) == [("x", "1"), ("y", "2")]
    junk = _write(tmp_path, "a.txt", "x=1;\nwhat is this\n")
    with pytest.raises(Exception, match="text between records"):
        text.read_free(spark, junk, r"\w=\d+;\n", r"(?P<key>\w)=(?P<value>\d+)").collect()
    assert len(_rows(text.read_free(spark, junk, r"\w=\d+;\n", r"(?P<key>\w)=(?P<value>\d+)", ignore_junk=True))) == 1


def test_key_values(spark, tmp_path):
    path = _write(tmp_path, "a.kv", "a = 1 # one\nb: two words\n# nothing\nOBJ=x=y\n")
    read = text.read_key_values(spark, path, ["a", "b", "object", "none"], rename={"OBJ": "object"})
    assert tuple(read.first())[1:] == ("1", "two words", "x=y", None)
    assert _rows(text.read_pairs(spark, path).drop("source_path")) == [("OBJ", "x=y"), ("a", "1"), ("b", "two words")]


def test_dump(spark, tmp_path):
    path = _write(tmp_path, "a.sql", "-- dump\nCREATE TABLE `t` (\n  `a` int,\n  `b` text,\n  KEY `k` (`a`)\n);\n"
                                     "INSERT INTO `t` VALUES (1,'x;\\'(y)'),(2,NULL);\nINSERT INTO `t` VALUES (3,'it''s, ok');\n")
    assert _rows(text.read_mysql_dump(spark, path)) == [("1", "x;'(y)"), ("2", None), ("3", "it's, ok")]


@pytest.mark.parametrize("order,mark", [("little", "<"), ("big", ">")])
def test_binary_records(spark, tmp_path, order, mark):
    rows = [(i, i * 0.5, f"n{i}".encode()) for i in range(100)]
    path = _write(tmp_path, "a.bin", b"HEAD" + b"".join(struct.pack(mark + "id4s", *r) for r in rows) + b"xx")
    read = binary.read_records(spark, path, "a(i) b(d) c(4s)", order, skip_bytes=4, chunk_bytes=100)
    assert _rows(read) == sorted(((a, b, c.decode()) for a, b, c in rows), key=repr)


def test_unsigned_and_aligned_records(spark, tmp_path):
    path = _write(tmp_path, "a.bin", struct.pack("=BHIQb", 255, 65535, 2**32 - 1, 2**64 - 1, -1))
    row = binary.read_records(spark, path, "a(B) b(H) c(I) d(Q) e(b)", "packed").first()
    assert (row["a"], row["b"], row["c"], int(row["d"]), row["e"]) == (255, 65535, 2**32 - 1, 2**64 - 1, -1)
    assert binary.record_layout("a(b) b(d)", "native")[0].itemsize == 16


def test_fortran_records(spark, tmp_path):
    good = b"".join(struct.pack("<iqi", 8, v, 8) for v in range(10))
    path = _write(tmp_path, "a.dat", good)
    assert len(_rows(binary.read_fortran_records(spark, path, "v(q)", chunk_records=3))) == 10
    _write(tmp_path, "a.dat", good + struct.pack("<iqi", 8, 1, 9))
    with pytest.raises(Exception, match="unequal length markers"):
        binary.read_fortran_records(spark, path, "v(q)").collect()


DOCUMENT = """<?xml version="1.0"?><VOTABLE xmlns="http://www.ivoa.net/xml/VOTable/v1.3"><RESOURCE><TABLE>
<FIELD name="id" datatype="int"><VALUES null="-1"/></FIELD><FIELD name="pos" datatype="double" arraysize="2" unit="deg"/>
<FIELD name="t" datatype="char" arraysize="*"><DESCRIPTION>A text</DESCRIPTION></FIELD>
<FIELD name="when" datatype="char" arraysize="*" xtype="timestamp"/>
<DATA><TABLEDATA><TR><TD>1</TD><TD>1.5 -2</TD><TD>a &amp; b</TD><TD>2001-02-03T04:05:06</TD></TR>
<TR><TD>-1</TD><TD/><TD></TD><TD/></TR></TABLEDATA></DATA></TABLE>
<TABLE><FIELD name="other" datatype="int"/><DATA><TABLEDATA><TR><TD>9</TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"""


@pytest.mark.parametrize("packed", [False, True])
def test_votable(spark, tmp_path, packed):
    import gzip

    path = _write(tmp_path, "a.vot.gz" if packed else "a.vot", gzip.compress(DOCUMENT.encode()) if packed else DOCUMENT)
    df = votable.read_votable(spark, path)
    rows = df.orderBy(F.col("id").asc_nulls_last()).collect()
    assert (rows[0]["id"], rows[0]["pos"], rows[0]["t"], rows[0]["when"].year) == (1, [1.5, -2.0], "a & b", 2001)
    assert (rows[1]["id"], rows[1]["pos"], rows[1]["when"]) == (None, None, None) and len(rows) == 2
    assert df.schema["pos"].metadata["unit"] == "deg" and df.schema["t"].metadata["description"] == "A text"


def test_uploads(spark):
    with pytest.raises(upload.UploadError):
        upload.check_upload(spark.createDataFrame([(1, 2)], ["a", "A"]))
    upload.upload(spark.range(3), "up")
    assert spark.sql("SELECT count(*) FROM up").first()[0] == 3


def test_parameter_rows(spark):
    df = text.rows_of_params(spark, {"k": [1, 2, 3], "c": ["x", "y"], "s": 1.5}, "k")
    assert _rows(df) == [(1, "x", 1.5), (2, "y", 1.5), (3, "x", 1.5)]


def test_padded_text(spark):
    df = spark.createDataFrame([("a", 1), ("long  one", None)], "t string, n int")
    assert [r[0] for r in sinks.padded_lines(df).orderBy("value").collect()] == ["a         1", "long one  N/A"]
    assert [r[0] for r in sinks.tsv_lines(df).orderBy("value").collect()] == ["a\t1", "long one\tN/A"]


def test_pixel_cutouts(spark):
    df = spark.range(20).select((F.col("id") % 5 + 1).alias("x"), (F.floor(F.col("id") / 5) + 1).alias("y"), "id", F.lit(3).alias("ref"))
    cut = pixels.cut_pixels(df, {"x": (2, 3), "y": (None, 2)}, {"x": 5, "y": 4}, {"x": "ref"})
    assert _rows(cut.select("x", "y", "id", "ref")) == [(1, 1, 1, 2), (1, 2, 6, 2), (2, 1, 2, 2), (2, 2, 7, 2)]
    beyond = pixels.cut_pixels(df, {"x": (9, 12)}, {"x": 5})
    assert {r["x"] for r in beyond.collect()} == {1} and beyond.count() == 4
    small = pixels.downscale(df.withColumn("image", F.lit(1)).withColumnRenamed("id", "value"), 2, F.lit(5), F.lit(4))
    assert _rows(small.select("x", "y", "value")) == [(1, 1, 3.0), (1, 2, 13.0), (2, 1, 5.0), (2, 2, 15.0)]


def test_spectral_slices_in_frequency(spark):
    df = spark.range(10).select((F.col("id") + 1).alias("x"))
    # 100 GHz in plane 1, then 10 GHz per plane
    cut = pixels.spectral_cut(df, "x", 299792458.0 / 130e9, 299792458.0 / 110e9, "GHz", 100.0, 1.0, 10.0, 10)
    assert cut.count() == 3


def test_relative_spectra_stay(spark):
    df = spark.createDataFrame([(1, 2.0, "RELATIVE"), (2, 2.0, "abs"), (2, 4.0, "abs")], "k int, flux double, cal string")
    assert spectra.normalise_flux(df, "k", calibration="relative") is df
    assert _rows(spectra.normalise_flux(df, "k", calibration="cal")) == [(1, 2.0, "RELATIVE"), (2, 0.5, "abs"), (2, 1.0, "abs")]


def test_dataset_rows_are_complete(spark):
    df = spark.createDataFrame([("a/b c", "image/fits", 4096)], "accref string, mime string, accsize bigint")
    row = catalogue.publish(df, {"dataproduct_type": F.lit("cube"), "s_ra": "1.5"}).first()
    assert list(row.asDict()) == list(catalogue.DATASET_COLUMNS) and len(catalogue.DATASET_COLUMNS) == 36
    assert (row["access_estsize"], row["calib_level"], row["s_ra"], row["obs_id"]) == (4, 0, 1.5, "a/b c")
    assert len(catalogue.DATASET_CONDITIONS) == 17 and len(spectra.SPECTRUM_PARAMETERS) == 20
    with pytest.raises(KeyError):
        catalogue.publish(df, {"nonsense": "1"})


def test_changed_records_limits(spark):
    df = spark.createDataFrame([("2001-01-01 00:00:00",), ("2001-01-02 23:59:59",), ("2001-01-03 00:00:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"))
    assert products.changed_records(df, "t", "2001-01-02", "2001-01-02").count() == 1
    assert products.changed_records(df, "t", None, "2001-01-03T00:00:00").count() == 3
    with pytest.raises(ValueError):
        products.changed_records(df, "t", "2001-01-02", "2001-01-02T00:00:00")


def test_keyed_table_repeats_and_compacts(spark, tmp_path):
    table = feeds.KeyedTable(spark, str(tmp_path / "t"), ["k"], "n", "overwrite")
    schema = "k string, v int, n int"
    table.start(spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], schema))
    table.feed(spark.createDataFrame([("a", 2, 1), ("a", 3, 2)], schema), 0)
    table.feed(spark.createDataFrame([("c", 9, 3)], schema), 1)
    table.feed(spark.createDataFrame([("c", 5, 3)], schema), 1)
    wanted = [("a", 3, 2), ("b", 1, 0), ("c", 5, 3)]
    assert _rows(table.read()) == wanted
    table.compact(1)
    assert _rows(table.read()) == wanted
    table.feed(spark.createDataFrame([("b", 7, 4)], schema), 2)
    assert _rows(table.read()) == [("a", 3, 2), ("b", 7, 4), ("c", 5, 3)]


def test_keyed_table_checks(spark, tmp_path):
    table = feeds.KeyedTable(spark, str(tmp_path / "t"), ["k"], "n", "check")
    schema = "k string, v int, n int"
    table.feed(spark.createDataFrame([("a", 1, 0)], schema), 0)
    table.feed(spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], schema), 1)
    assert _rows(table.read()) == [("a", 1, 0), ("b", 2, 2)]
    with pytest.raises(Exception, match="differing rows"):
        table.feed(spark.createDataFrame([("a", 4, 3)], schema), 2)


CHECKED = ["p1_select_list", "p22_range_list", "j8_not_in", "j10_crossmatch", "a2_aggregates", "a12_chunked", "l3_offset", "u3_except_all",
           "g13_cone_search", "g5_non_convex", "n13_healpix", "n10_galactic", "i15_conflicts", "i20_tombstones", "w1_normalise_flux",
           "x9_links", "x17_changed_records", "s3_fixed_columns", "k1_csv", "r2_stream_overwrite", "z1_sql_functions"]


@pytest.fixture(scope="module")
def duck(tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(tables.sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{tables.sf_dir}/{f}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.8g}") + 0.0
    return v


@pytest.mark.parametrize("name", CHECKED if not os.environ.get("ALL_QUERIES") else sorted(
    importlib.import_module("skylattice.queries").REGISTRY))
def test_registered_queries(spark, tables, duck, name):
    registry = importlib.import_module("skylattice.queries").REGISTRY
    df = registry[name](spark, tables.sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if registry[name].sql is None:
        return
    cursor = duck.execute(registry[name].sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert mine == theirs


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["c_custkey", "c_name", "ra", "dec", "dist"]
