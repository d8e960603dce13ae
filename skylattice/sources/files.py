"""Listing sources, per-source columns, prefilters."""

from __future__ import annotations

import shlex
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import shell_regex
from .ranges import open_input, spread


def list_sources(spark: SparkSession, path, pattern: str | None = None, recursive: bool = True,
                 items=(), ignore_names=(), ignore_patterns=(), loaded: DataFrame | None = None) -> DataFrame:
    """path, size and modification time of input files.

    ``path`` may hold globs; ``items`` are literal paths besides it.  Left
    out are names and shell patterns (of the whole path) to ignore, and the
    paths in the first column of ``loaded``.  No file content is read.
    """
    def scan(where, glob):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        return reader.load(where).select("path", "length", "modificationTime")

    listed = scan(path, pattern)
    if items:
        listed = listed.unionByName(scan(list(items), None)).distinct()
    base = F.element_at(F.split("path", "/"), -1)
    if ignore_names:
        listed = listed.filter(~base.isin(list(ignore_names)) & ~F.col("path").isin(list(ignore_names)))
    for p in ignore_patterns:
        listed = listed.filter(~F.col("path").rlike(f"(?:^|/){shell_regex(p)}$"))
    if loaded is not None:
        seen = loaded.select(F.col(loaded.columns[0]).alias("path"))
        listed = listed.join(seen, "path", "left_anti")
    return listed


def source_path() -> Column:
    """Path of the file a row was read from."""
    return F.col("_metadata.file_path")


def relative_path(path: Column, base: str) -> Column:
    """Path below a directory."""
    root = base.rstrip("/") + "/"
    return F.when(F.instr(path, root) > 0, F.substring_index(path, root, -1)).otherwise(path)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def last_elements(path: Column, n: int) -> Column:
    """The last ``n`` elements of a path."""
    return F.substring_index(path, "/", -n)


def with_source_columns(df: DataFrame, base: str | None = None) -> DataFrame:
    """Adds source_path, source_stem, source_size and source_date of each row's file.

    Call it right on a file scan, where the file metadata is at hand.
    """
    path = source_path()
    return df.withColumns({
        "source_path": relative_path(path, base) if base else path,
        "source_stem": stem(path),
        "source_size": F.col("_metadata.file_size"),
        "source_date": F.col("_metadata.file_modification_time")})


def with_constants(df: DataFrame, **constants) -> DataFrame:
    """The same values on every row of a source."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def with_source_constants(df: DataFrame, table: DataFrame, source: str = "source_path") -> DataFrame:
    """Values by source from a table with one row per source."""
    return df.join(table, source, "left")


def prefiltered_lines(spark: SparkSession, sources: DataFrame, command: str) -> DataFrame:
    """Lines a shell-free command makes of each file fed to its input: source_path, value.

    One process per file, spread over tasks; output is passed on as it comes.
    """
    arguments = shlex.split(command)

    def run(batches):
        import threading

        import pandas as pd

        for batch in batches:
            for path in batch["path"]:
                process = subprocess.Popen(arguments, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

                def feed(path=path, process=process):
                    with open_input(path) as stream:
                        while chunk := stream.read(1 << 20):
                            process.stdin.write(chunk)
                    process.stdin.close()

                feeder = threading.Thread(target=feed, daemon=True)
                feeder.start()
                lines = []
                for line in process.stdout:
                    lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                    if len(lines) >= 10_000:
                        yield pd.DataFrame({"source_path": path, "value": lines})
                        lines = []
                feeder.join()
                if process.wait():
                    raise RuntimeError(f"{command} failed on {path} with status {process.returncode}")
                if lines:
                    yield pd.DataFrame({"source_path": path, "value": lines})

    return spread(sources.select("path"), "path").mapInPandas(run, "source_path string, value string")
