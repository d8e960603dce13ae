"""Text formats: delimited, fixed columns, records by patterns, key-value."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dumps import read_mysql_dump  # noqa: F401
from .quoted import read_quoted


def _lines(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("source_path"),
                                    F.col("_metadata.file_block_start").alias("__block"))


def _string_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _whole_texts(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)


def skip_top_lines(lines: DataFrame, n: int) -> DataFrame:
    """Lines without the first ``n`` of each file.

    Only the first block of each file takes part in the counting; the scan
    hands out the lines of a block in order.
    """
    if n <= 0:
        return lines
    placed = lines.withColumn("__id", F.monotonically_increasing_id())
    head = placed.filter("__block = 0")
    starts = head.groupBy("source_path").agg(F.min("__id").alias("__first"))
    kept = head.join(starts, "source_path").filter(F.col("__id") >= F.col("__first") + n)
    return kept.select(*lines.columns).unionByName(placed.filter("__block > 0").select(*lines.columns))


def stop_at(records: DataFrame, pattern: str) -> DataFrame:
    """Records of each file before the first one a pattern is found in."""
    placed = records.withColumn("__id", F.monotonically_increasing_id())
    place = F.struct("__block", "__id")
    stops = placed.filter(F.col("value").rlike(pattern)).groupBy("source_path").agg(F.min(place).alias("__stop"))
    joined = placed.join(stops, "source_path", "left")
    return joined.filter(F.col("__stop").isNull() | (place < F.col("__stop"))).select(*records.columns)


def read_csv(spark: SparkSession, path, names=None, delimiter: str = ",", strip: bool = False,
             top_ignored: int = 0, one_line: bool = False) -> DataFrame:
    """Delimited text with names from ``names`` or the first record; all columns are strings.

    Ignored top lines come before the header.  Quoted fields may hold newlines (see ``quoted``); ``one_line`` promises
    that none does, and reads by the line.
    """
    if not one_line:
        return read_quoted(spark, path, names, delimiter, strip, top_ignored)
    reader = spark.read.option("sep", delimiter).option("ignoreLeadingWhiteSpace", str(strip).lower()).option(
        "ignoreTrailingWhiteSpace", str(strip).lower()).option("recursiveFileLookup", "true")
    if top_ignored == 0:
        if names is None:
            return reader.option("header", "true").csv(path)
        return reader.schema(_string_schema(names)).csv(path)
    lines = _lines(spark, path)
    if names is None:
        first = lines.filter("__block = 0").limit(top_ignored + 1).collect()[top_ignored]["value"]
        names = [n.strip() for n in next(_csv_rows(first, delimiter))]
        top_ignored += 1
    body = skip_top_lines(lines, top_ignored).filter(F.trim("value") != "")
    options = {"sep": delimiter, "ignoreLeadingWhiteSpace": str(strip).lower(),
               "ignoreTrailingWhiteSpace": str(strip).lower()}
    parsed = F.from_csv("value", ", ".join(f"`{n}` STRING" for n in names), options)
    return body.select(parsed.alias("r")).select("r.*")


def _csv_rows(line: str, delimiter: str):
    import csv

    return csv.reader([line], delimiter=delimiter)


def column_ranges(text: str) -> dict[str, tuple[int, int | None]]:
    """Ranges like ``name: 1-5, flag: 7, rest: 9-`` as 1-based first and last columns."""
    out = {}
    for item in re.split(r"[,\n]+", text):
        if not item.strip():
            continue
        name, _, span = item.partition(":")
        first, dash, last = span.strip().partition("-")
        low = int(first) if first.strip() else 1
        out[name.strip()] = (low, (int(last) if last.strip() else None) if dash else low)
    return out


def read_columns(spark: SparkSession, path, columns, comment: str | None = None,
                 top_ignored: int = 0) -> DataFrame:
    """Fixed columns (1-based, inclusive, open ends allowed) as stripped strings; blank fields stay empty."""
    columns = column_ranges(columns) if isinstance(columns, str) else columns
    lines = skip_top_lines(_lines(spark, path), top_ignored)
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    lines = lines.filter(F.trim("value") != "")
    return lines.select(*(cut(F.col("value"), *span).alias(name) for name, span in columns.items()))


def cut(value: Column, first: int, last: int | None) -> Column:
    """Columns ``first`` to ``last`` of a line, stripped."""
    length = F.lit(last - first + 1) if last is not None else F.length(value)
    return F.trim(value.substr(F.lit(first), length))


def _is_literal(pattern: str) -> bool:
    return not re.search(r"[\\^$.|?*+()\[\]{}]", pattern.replace("\\n", "\n").replace("\\t", "\t"))


def _without_top(text: Column, n: Column) -> Column:
    """A text without its first ``n`` lines."""
    lines = F.split(text, "\n", -1)
    return F.when(n <= 0, text).otherwise(F.array_join(F.slice(lines, n.cast("int") + 1, F.greatest(F.size(lines), F.lit(1))), "\n"))


def _records(spark: SparkSession, path, separator: str, top_ignored: int = 0) -> DataFrame:
    """Records by a separator: literal ones split files between tasks, patterns need a file as a whole.

    The first ``top_ignored`` lines of each file are no part of any record.
    """
    literal = separator.replace("\\n", "\n").replace("\\t", "\t")
    if not _is_literal(separator):
        texts = _whole_texts(spark, path).select(
            _without_top(F.col("value"), F.lit(top_ignored)).alias("value"), F.col("_metadata.file_path").alias("source_path"))
        return texts.select("source_path", F.posexplode(F.split("value", separator)).alias("__block", "value"))
    records = _lines(spark, path, literal)
    if literal == "\n" or top_ignored <= 0:
        return skip_top_lines(records, top_ignored)
    # lines that end before a record, counted in each file's first block
    placed = records.withColumn("__id", F.monotonically_increasing_id())
    ends = F.length("value") - F.length(F.translate("value", "\n", "")) + literal.count("\n")
    before = Window.partitionBy("source_path").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    head = placed.filter("__block = 0").withColumn("__ended", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    left = F.lit(top_ignored) - F.col("__ended")
    inside = F.length("value") - F.length(F.translate("value", "\n", ""))
    head = head.filter(left <= inside).withColumn("value", _without_top(F.col("value"), left))
    return head.select(*records.columns).unionByName(placed.filter("__block > 0").select(*records.columns))


def read_records(spark: SparkSession, path, names, record_sep: str = "\n", field_sep: str = r"\s+",
                 comment: str | None = None, stop: str | None = None, cleaner: str | None = None,
                 top_ignored: int = 0, lax: bool = False) -> DataFrame:
    """Records by separator patterns.

    ``top_ignored`` counts lines of a file, whatever the separator;
    ``comment`` is a pattern removed from records; reading a file stops at
    the first record that begins with ``stop``; ``cleaner`` is a pattern whose
    groups, joined by blanks, replace the record, and that must be found in
    each.  Records with a wrong number of fields are errors unless ``lax``.
    """
    records = _records(spark, path, record_sep, top_ignored)
    if stop:
        records = stop_at(records, rf"\A(?:{stop})")
    value = F.col("value")
    if comment:
        value = F.regexp_replace(value, comment, "")
    if cleaner:
        groups = re.compile(cleaner).groups
        joined = F.concat_ws(" ", *(F.regexp_extract(value, cleaner, i + 1) for i in range(groups)))
        message = F.concat(F.lit("record not fit for the cleaner: "), value)
        value = F.when(F.trim(value) == "", "").when(value.rlike(cleaner), joined).otherwise(F.raise_error(message).cast("string"))
    records = records.select("source_path", F.trim(value).alias("value")).filter("value != ''")
    fields = F.split("value", field_sep)
    if not lax:
        message = F.concat(F.lit(f"record without {len(names)} fields: "), F.col("value"))
        fields = F.when(F.size(fields) == len(names), fields).otherwise(
            F.raise_error(message).cast("array<string>"))
    records = records.withColumn("__fields", fields)
    return records.select(*(F.trim(F.get("__fields", F.lit(i))).alias(n) for i, n in enumerate(names)))


def read_free(spark: SparkSession, path, row_pattern: str, parse_pattern: str, separator: str | None = None,
              ignore_junk: bool = False) -> DataFrame:
    """Records found by one pattern, fields by the named groups of another.

    With a literal ``separator`` that ends every record, files are split
    between tasks; without one each file is searched as a whole.  Text that
    is no record is an error unless ``ignore_junk``.
    """
    groups = re.compile(parse_pattern).groupindex
    java_pattern = parse_pattern.replace("(?P<", "(?<")
    if separator is None:
        texts = _whole_texts(spark, path)
    else:
        texts = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(path)
    if not ignore_junk:
        rest = F.regexp_replace("value", row_pattern, "")
        failure = F.raise_error(F.concat(F.lit("text between records: "), F.substring(rest, 1, 60)))
        texts = texts.filter(F.when(F.trim(rest) == "", True).otherwise(failure.cast("boolean")))
    rows = texts.select(F.explode(F.regexp_extract_all("value", F.lit(row_pattern), F.lit(0))).alias("value"))
    matches = F.col("value").rlike(java_pattern)
    if ignore_junk:
        rows = rows.filter(matches)
    else:
        failure = F.raise_error(F.concat(F.lit("record does not parse: "), F.col("value"))).cast("boolean")
        rows = rows.filter(F.when(matches, True).otherwise(failure))
    return rows.select(*(F.regexp_extract("value", java_pattern, i).alias(n) for n, i in groups.items()))


def _without_comments(text: Column, comment: str | None) -> Column:
    return F.regexp_replace(text, f"(?m){comment}", "") if comment else text


def _pairs(spark: SparkSession, path, pair_sep: str, comment: str | None) -> DataFrame:
    texts = _whole_texts(spark, path).select(
        F.col("_metadata.file_path").alias("source_path"), _without_comments(F.col("value"), comment).alias("value"))
    return texts.select("source_path", F.filter(F.split("value", pair_sep), lambda p: F.trim(p) != "").alias("pairs"))


def read_key_values(spark: SparkSession, path, keys, pair_sep: str = r"\n", kv_sep: str = r"[:=]",
                    comment: str | None = r"#.*", rename: dict | None = None) -> DataFrame:
    """One row per file of ``key = value`` pairs, with the wanted keys as columns (missing ones NULL).

    ``rename`` maps keys in the file to column names.
    """
    rename = rename or {}
    back = {v: k for k, v in rename.items()}
    pairs = F.transform("pairs", lambda p: F.struct(
        F.trim(F.get(F.split(p, kv_sep, 2), F.lit(0))).alias("k"),
        F.trim(F.get(F.split(p, kv_sep, 2), F.lit(1))).alias("v")))
    rows = _pairs(spark, path, pair_sep, comment).withColumn("__pairs", pairs)

    def value(key):
        found = F.filter("__pairs", lambda p: p["k"] == back.get(key, key))
        return F.get(found, F.size(found) - 1)["v"]

    return rows.select("source_path", *(value(k).alias(k) for k in keys))


def read_pairs(spark: SparkSession, path, pair_sep: str = "\n", kv_sep: str = r"[:=]",
               comment: str | None = r"#.*") -> DataFrame:
    """One row (source_path, key, value) per pair."""
    if _is_literal(pair_sep):
        lines = _lines(spark, path, pair_sep.replace("\\n", "\n")).select("source_path", F.regexp_replace(
            "value", comment, "").alias("value") if comment else F.col("value")).filter(F.trim("value") != "")
    else:
        lines = _pairs(spark, path, pair_sep, comment).select("source_path", F.explode("pairs").alias("value"))
    parts = F.split("value", kv_sep, 2)
    return lines.select("source_path", F.trim(F.get(parts, F.lit(0))).alias("key"),
                        F.trim(F.get(parts, F.lit(1))).alias("value"))


def read_split(spark: SparkSession, path, schema, separator: str = "|", null: str = "\\N",
               skip_bad: bool = True) -> DataFrame:
    """Rows of fields by one character, typed on reading; bad records are dropped or raise."""
    return spark.read.schema(schema).option("sep", separator).option("nullValue", null).option(
        "mode", "DROPMALFORMED" if skip_bad else "FAILFAST").option("quote", "").option(
        "recursiveFileLookup", "true").csv(path)


def read_tsv(spark: SparkSession, path, names) -> DataFrame:
    """Tab-separated text without ``#`` and blank lines; short rows leave NULLs."""
    lines = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    return lines.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def rows_of_params(spark: SparkSession, params: dict, key: str) -> DataFrame:
    """Parameter lists as rows: one per value of the key parameter; other lists are cycled, scalars repeated."""
    columns = {n: v if isinstance(v, (list, tuple)) else [v] for n, v in params.items()}
    one = spark.createDataFrame([tuple(columns.values())], schema=_param_schema(columns))
    exploded = one.select("*", F.posexplode(key).alias("__at", "__key"))
    def pick(name):
        if name == key:
            return F.col("__key")
        return F.element_at(name, (F.pmod(F.col("__at"), F.size(name)) + 1).cast("int"))
    return exploded.select(*(pick(n).alias(n) for n in columns))


def _param_schema(columns: dict) -> T.StructType:
    fields = []
    for name, values in columns.items():
        sample = next((v for v in values if v is not None), "")
        kind = T.BooleanType() if isinstance(sample, bool) else T.LongType() if isinstance(sample, int) else (
            T.DoubleType() if isinstance(sample, float) else T.StringType())
        fields.append(T.StructField(name, T.ArrayType(kind)))
    return T.StructType(fields)


def rows_of_tuples(spark: SparkSession, rows, names=None, schema=None) -> DataFrame:
    """Tuples or dicts as a DataFrame."""
    rows = list(rows)
    if rows and isinstance(rows[0], dict) and schema is None:
        names = names or list(rows[0])
        rows = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(rows, schema or list(names))
