"""VOTable TABLEDATA: typed by FIELD elements, rows found by their closing tag.

Splitting at ``</TR>`` lets many tasks read one document.
"""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import literal_cast
from .ranges import file_sizes, open_input
from .text import _lines, stop_at

# fixed values: VOTable datatypes as Spark types
DATATYPES = {
    "boolean": T.BooleanType(), "bit": T.BooleanType(), "unsignedByte": T.ShortType(), "short": T.ShortType(),
    "int": T.IntegerType(), "long": T.LongType(), "char": T.StringType(), "unicodeChar": T.StringType(),
    "float": T.FloatType(), "double": T.DoubleType(),
}


def _head(path: str) -> str:
    """The text of a document before its first data; the whole text where it has none."""
    with open_input(path) as raw:
        stream = gzip.open(raw) if path.endswith(".gz") else raw
        text = b""
        while b"<DATA" not in text:
            chunk = stream.read(1 << 16)
            if not chunk:
                break
            text += chunk
    return text.split(b"<DATA")[0].decode("utf-8", "replace")


def read_fields(spark: SparkSession, path) -> list[dict]:
    """The FIELD elements of the first table of the first file (by path) that has one, as dicts; only heads are read."""
    files = file_sizes(spark, path).filter("length > 0").select("path")
    name = files.agg(F.min("path")).first()[0]
    while name is not None:
        text = _head(name)
        at = text.find("<TABLE")
        if at < 0:
            name = files.filter(F.col("path") > name).agg(F.min("path")).first()[0]
            continue
        fields = []
        parser = ElementTree.XMLPullParser(("end",))
        parser.feed(text[at:])
        for _, element in parser.read_events():
            if element.tag.rsplit("}", 1)[-1] == "FIELD":
                field = dict(element.attrib)
                for child in element:
                    tag = child.tag.rsplit("}", 1)[-1]
                    if tag == "DESCRIPTION":
                        field["description"] = (child.text or "").strip()
                    elif tag == "VALUES" and "null" in child.attrib:
                        field["null"] = child.attrib["null"]
                fields.append(field)
        return fields
    raise ValueError(f"no table in {path}")


def field_type(field: dict) -> T.DataType:
    base = DATATYPES[field.get("datatype", "char")]
    if isinstance(base, T.StringType):
        if field.get("xtype", "").lower() in ("timestamp", "adql:timestamp"):
            return T.TimestampNTZType()
        return base
    size = field.get("arraysize")
    return T.ArrayType(base) if size and size != "1" else base


def _typed(text: Column, field: dict) -> Column:
    kind = field_type(field)
    value = text if isinstance(kind, T.StringType) else F.nullif(F.trim(text), F.lit(""))
    if "null" in field:
        value = F.nullif(value, F.lit(field["null"]))
    if isinstance(kind, T.ArrayType):
        items = F.split(F.trim(value), r"\s+")
        return F.when(value.isNotNull(), F.transform(items, lambda i: literal_cast(i, kind.elementType)))
    return literal_cast(value, kind)


_CELL = r"(?s)<TD(?:\s[^>]*)?(?:/>|>(.*?)</TD>)"


def _unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def read_votable(spark: SparkSession, path, fields: list[dict] | None = None) -> DataFrame:
    """Rows of the first table of VOTable files, typed, with units and labels as column metadata."""
    fields = fields or read_fields(spark, path)
    records = stop_at(_lines(spark, path, "</TR>"), "</TABLE>").filter(F.col("value").contains("<TR"))
    cells = records.select(F.regexp_extract_all("value", F.lit(_CELL), F.lit(1)).alias("TD"))
    columns = []
    for i, field in enumerate(fields):
        metadata = {k: field[k] for k in ("unit", "ucd", "utype", "description") if field.get(k)}
        text = _unescaped(F.get("TD", F.lit(i)))
        columns.append(_typed(text, field).alias(field.get("name") or field["ID"], metadata=metadata))
    return cells.select(*columns)
