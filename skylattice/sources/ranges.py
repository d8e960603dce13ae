"""Reading byte ranges of files inside tasks, so that large binary files are shared between executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 32 << 20
MOST_TASKS = 100_000


def open_input(uri: str):
    """A seekable binary stream for a path as Spark reports it (any file system Arrow knows)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    if "://" not in uri:
        return fs.LocalFileSystem().open_input_file(uri)
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def write_bytes(uri: str, data: bytes) -> None:
    """Writes a whole file, replacing what is there, on any file system Arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    system, path = (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as stream:
        stream.write(data)


def file_sizes(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """path and length of files; contents are not touched."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length")


def spread(rows: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Rows that stand for much work each, dealt to about as many tasks.

    The number is given to Spark, which would otherwise put such rows together, as they are small.
    """
    tasks = rows.count() if tasks is None else tasks
    return rows.repartition(max(1, min(tasks, MOST_TASKS)), *keys)


def record_chunks(files: DataFrame, skip, stop, record_bytes, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Byte ranges (path, start, stop, first_record) of whole records, spread over tasks.

    ``skip``, ``stop`` and ``record_bytes`` are columns; data between
    ``skip`` and ``stop`` is cut at record borders, a last partial record is
    left out.
    """
    count = F.floor((stop - skip) / record_bytes)
    per_chunk = F.greatest(F.lit(1), F.floor(F.lit(chunk_bytes) / record_bytes))
    chunks = F.when(count > 0, F.sequence(F.lit(0), F.ceil(count / per_chunk).cast("bigint") - 1))
    cut = files.withColumns({"__count": count.cast("bigint"), "__per": per_chunk.cast("bigint"),
                             "__skip": skip.cast("bigint"), "__size": record_bytes.cast("bigint")})
    cut = cut.withColumn("__chunk", F.explode(chunks)).withColumn("first_record", F.col("__chunk") * F.col("__per"))
    cut = cut.withColumns({
        "start": F.col("__skip") + F.col("first_record") * F.col("__size"),
        "stop": F.col("__skip") + F.least(F.col("__count"), F.col("first_record") + F.col("__per")) * F.col("__size"),
    }).drop("__count", "__per", "__skip", "__size", "__chunk")
    return spread(cut, "path", "start")
