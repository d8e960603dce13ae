import struct
from decimal import Decimal

import numpy as np
import pytest

from skylattice.sources import fits


def card(key, value):
    return f"{key:<8}= {value:>20}".ljust(80)


def padded(data, fill=b"\0"):
    return data + fill * (-len(data) % 2880)


def header(cards):
    return padded(("".join(cards) + "END".ljust(80)).encode(), b" ")


def table(columns, rows, heap=b"", extra=(), theap_gap=0):
    """columns: (form, name, cards); rows: packed bytes."""
    width = len(rows[0]) if rows else 1
    cards = ["XTENSION= 'BINTABLE'".ljust(80), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", str(width)), card("NAXIS2", str(len(rows))),
             card("PCOUNT", str(len(heap) + theap_gap)), card("GCOUNT", "1"), card("TFIELDS", str(len(columns)))]
    for i, (form, name, more) in enumerate(columns, 1):
        cards += [f"TFORM{i:<3}= '{form:<8}'".ljust(80), f"TTYPE{i:<3}= '{name:<8}'".ljust(80)] + [card(f"{k}{i}", v) for k, v in more.items()]
    cards += list(extra)
    if theap_gap:
        cards.append(card("THEAP", str(width * len(rows) + theap_gap)))
    primary = header([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0")])
    return primary + header(cards) + padded(b"".join(rows) + b"\xee" * theap_gap + heap)


def test_scales_nulls_and_unsigned(spark, tmp_path):
    columns = [("1I", "temp", {"TSCAL": "0.5", "TZERO": "10.0", "TNULL": "-99"}), ("1J", "n", {"TNULL": "-1"}), ("1I", "u16", {"TZERO": "32768"}),
               ("1J", "u32", {"TZERO": "2147483648"}), ("1K", "u64", {"TZERO": "9223372036854775808"}), ("1B", "s8", {"TZERO": "-128"}), ("1L", "flag", {}),
               ("3I", "three", {"TNULL": "0", "TSCAL": "2"}), ("4A", "word", {}), ("1E", "x", {})]
    rows = [struct.pack(">hihiqBc3h4sf", 4, 7, -32768, -2147483648, -(1 << 63), 0, b"T", 1, 0, 3, b"ab \0", 1.5),
            struct.pack(">hihiqBc3h4sf", -99, -1, 32767, 2147483647, (1 << 63) - 1, 255, b"\0", 4, 5, 6, b"wxyz", -2.0)]
    (tmp_path / "a.fits").write_bytes(table(columns, rows))
    df = fits.read_table(spark, str(tmp_path / "a.fits"))
    assert dict(df.dtypes)["temp"] == "double" and dict(df.dtypes)["u64"] == "decimal(20,0)" and dict(df.dtypes)["three"] == "array<double>"
    a, b = df.orderBy("x", ascending=False).collect()
    assert tuple(a) == (12.0, 7, 0, 0, Decimal(0), -128, True, [2.0, None, 6.0], "ab", 1.5)
    assert tuple(b) == (None, None, 65535, (1 << 32) - 1, Decimal((1 << 64) - 1), 127, None, [8.0, 10.0, 12.0], "wxyz", -2.0)


@pytest.mark.parametrize("gap", [0, 100])
def test_columns_of_variable_length(spark, tmp_path, monkeypatch, gap):
    rng = np.random.default_rng(gap)
    values = [rng.integers(-5, 100, rng.integers(0, 40)).astype(">i2") for _ in range(300)]
    texts = ["t" * int(rng.integers(0, 9)) for _ in range(300)]
    heap, places = b"", []
    for k in rng.permutation(300):  # the heap's order is not that of the rows
        places.append((k, len(heap), len(heap) + 2 * len(values[k])))
        heap += values[k].tobytes() + texts[k].encode()
    places = {k: (a, b) for k, a, b in places}
    rows = [struct.pack(">iiiqq", k, len(values[k]), places[k][0], len(texts[k]), places[k][1]) for k in range(300)]
    columns = [("1J", "k", {}), ("1PI(40)", "v", {"TSCAL": "0.1", "TNULL": "-1"}), ("1QA(9)", "t", {})]
    (tmp_path / "a.fits").write_bytes(table(columns, rows, heap, theap_gap=gap))
    if gap:
        monkeypatch.setattr(fits, "HEAP_GAP", 0)
        monkeypatch.setattr(fits, "HEAP_BYTES", 50)
    found = {r["k"]: r for r in fits.read_table(spark, str(tmp_path / "a.fits"), chunk_bytes=28 * 70).collect()}
    for k in range(300):
        assert found[k]["t"] == texts[k]
        assert found[k]["v"] == [None if x == -1 else float(x) * 0.1 for x in values[k].tolist()]


def test_files_of_different_layouts(spark, tmp_path):
    one = [("1J", "a", {}), ("1E", "b", {"TSCAL": "2"})]
    (tmp_path / "1.fits").write_bytes(table(one, [struct.pack(">if", 1, 2.0)]))
    # other places and scales are each file's own
    (tmp_path / "2.fits").write_bytes(table([("1E", "b", {"TSCAL": "3"}), ("1J", "a", {})][::-1], [struct.pack(">if", 2, 2.0)]))
    assert sorted(tuple(r) for r in fits.read_table(spark, str(tmp_path)).collect()) == [(1, 4.0), (2, 6.0)]
    (tmp_path / "3.fits").write_bytes(table([("1K", "a", {}), ("1E", "b", {"TSCAL": "2"})], [struct.pack(">qf", 1, 2.0)]))
    with pytest.raises(ValueError, match="different columns"):
        fits.read_table(spark, str(tmp_path))


def test_files_of_one_row_each_are_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from skylattice.queries import sources
    from skylattice.sources import fits

    rows = spark.range(400).coalesce(1).select(F.col("id").alias("g"), F.col("id").cast("string").alias("value"), F.lit(0).alias("o"))
    path = sources._write_groups(rows, str(tmp_path / "groups"), "g", "o")
    tasks = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("t"), "g")
    assert tasks.count() == 400 and tasks.select("t").distinct().count() > 4
    monkeypatch.setattr(fits, "FILES_A_TASK", 10)
    files = spark.range(400).selectExpr("concat('x', id) AS path", "id AS length")
    assert fits._headers(files, 0).rdd.getNumPartitions() == 40
