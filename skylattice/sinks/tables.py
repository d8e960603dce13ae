"""Writing results: delimited and plain text, JSON, VOTable rows, managed and partitioned tables."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import NOT_AVAILABLE, one_line


def _text_columns(df: DataFrame) -> list[Column]:
    return [one_line(f.name).alias(f.name) if isinstance(f.dataType, T.StringType)
            else _as_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]


def _as_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def csv_rows(df: DataFrame) -> DataFrame:
    """What a CSV file of the table holds: text columns with runs of white space as one blank."""
    return df.select(*_text_columns(df))


def write_csv(df: DataFrame, path: str, header: bool = False, params: dict | None = None,
              mode: str = "errorifexists") -> None:
    """CSV files; with ``params``, a comment file beside them holds ``# name = value`` lines."""
    csv_rows(df).write.mode(mode).option("header", str(header).lower()).csv(path)
    if params:
        _write_lines(df, [f"# {k} = {v}" for k, v in params.items()], path.rstrip("/") + "_params")


def _write_lines(df: DataFrame, lines, path: str) -> None:
    spark = df.sparkSession
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def tsv_lines(df: DataFrame) -> DataFrame:
    """One tab-separated line per row, NULL as N/A."""
    parts = [F.coalesce(c, F.lit(NOT_AVAILABLE)) for c in _text_columns(df)]
    return df.select(F.concat_ws("\t", *parts).alias("value"))


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    tsv_lines(df).write.mode(mode).text(path)


def padded_lines(df: DataFrame, separator: str = "  ") -> DataFrame:
    """Plain text with columns padded to their widest value; the widths come from one aggregation."""
    texts = df.select(*(F.coalesce(c, F.lit(NOT_AVAILABLE)).alias(n) for c, n in zip(_text_columns(df), df.columns)))
    widths = texts.agg(*(F.coalesce(F.max(F.length(n)), F.lit(0)).alias(f"__w{i}")
                         for i, n in enumerate(df.columns)))
    padded = [F.rpad(F.col(n), F.col(f"__w{i}"), F.lit(" ")) for i, n in enumerate(df.columns)]
    return texts.crossJoin(F.broadcast(widths)).select(F.rtrim(F.concat_ws(separator, *padded)).alias("value"))


def column_descriptions(df: DataFrame) -> DataFrame:
    """name, type, unit, ucd, description of the columns, from schema and metadata."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("unit"), f.metadata.get("ucd"),
             f.metadata.get("description")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string, unit string, ucd string, description string")


def write_json(df: DataFrame, path: str, params: dict | None = None, mode: str = "errorifexists") -> None:
    """``rows``, ``columns`` and ``params`` below a path, one JSON document per line."""
    path = path.rstrip("/")
    df.write.mode(mode).option("ignoreNullFields", "false").json(path + "/rows")
    column_descriptions(df).coalesce(1).write.mode(mode).json(path + "/columns")
    if params:
        rows = [(k, str(v)) for k, v in params.items()]
        df.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.mode(mode).json(
            path + "/params")


# fixed values: Spark types as VOTable datatypes and array sizes
VOTABLE_TYPES = {
    "boolean": ("boolean", None), "tinyint": ("short", None), "smallint": ("short", None), "int": ("int", None),
    "bigint": ("long", None), "float": ("float", None), "double": ("double", None), "string": ("unicodeChar", "*"),
}


def _cell(f: T.StructField) -> Column:
    value = F.col(f.name)
    if isinstance(f.dataType, T.ArrayType):
        text = F.array_join(F.transform(value, lambda v: v.cast("string")), " ")
    elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        text = value.cast("string")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return F.concat(F.lit("<TD>"), F.coalesce(text, F.lit("")), F.lit("</TD>"))


def votable_rows(df: DataFrame) -> DataFrame:
    """One TR element per row."""
    return df.select(F.concat(F.lit("<TR>"), *(_cell(f) for f in df.schema.fields), F.lit("</TR>")).alias("value"))


def votable_field(f: T.StructField) -> str:
    kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
    datatype, size = VOTABLE_TYPES.get(kind.simpleString(), ("char", "*"))
    if isinstance(f.dataType, T.ArrayType):
        size = "*"
    attributes = {"name": f.name, "datatype": datatype, "arraysize": size, "unit": f.metadata.get("unit"),
                  "ucd": f.metadata.get("ucd"), "utype": f.metadata.get("utype")}
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        attributes["xtype"] = "timestamp"
    text = " ".join(f"{k}={quoteattr(v)}" for k, v in attributes.items() if v)
    description = f.metadata.get("description")
    inner = f"<DESCRIPTION>{escape(description)}</DESCRIPTION>" if description else ""
    return f"<FIELD {text}>{inner}</FIELD>"


def write_votable(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A VOTable in parts: ``head``, ``rows`` (many files) and ``tail``; concatenated they are one document."""
    path = path.rstrip("/")
    head = ['<?xml version="1.0" encoding="utf-8"?>',
            '<VOTABLE version="1.3" xmlns="http://www.ivoa.net/xml/VOTable/v1.3">',
            '<RESOURCE type="results">', "<TABLE>", *map(votable_field, df.schema.fields), "<DATA><TABLEDATA>"]
    _write_lines(df, head, path + "/head")
    votable_rows(df).write.mode(mode).text(path + "/rows")
    _write_lines(df, ["</TABLEDATA></DATA>", "</TABLE>", "</RESOURCE>", "</VOTABLE>"], path + "/tail")


def write_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by=(), bucket_by=None,
                buckets: int = 0) -> None:
    """A managed table with statistics; bucketing by a key makes later joins on it need no shuffle."""
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def export_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_replacing_sources(df: DataFrame, path: str, source: str = "source_id") -> None:
    """Writes rows so that exactly the sources occurring in ``df`` are replaced; the others stay untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def sky_clustered(df: DataFrame, order: int = 6, ra: str = "ra", dec: str = "dec", keep: bool = True,
                  partitions: int | None = None) -> DataFrame:
    """Rows laid out by sky cell, so that the row groups of a Parquet file cover small areas."""
    from ..functions.healpix import with_healpix

    placed = with_healpix(df, order, ra, dec, "hpx")
    parts = placed.repartitionByRange(partitions, "hpx", ra) if partitions else placed.repartitionByRange("hpx", ra)
    laid = parts.sortWithinPartitions("hpx")
    return laid if keep else laid.drop("hpx")
