"""Jobs per file: a function over every source, spread over tasks, with a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ranges import spread


def process_files(sources: DataFrame, job: Callable[[str], str], keep_going: bool = True) -> DataFrame:
    """path, status (``ok`` or ``failed``) and the result or error text of ``job(path)`` for each source.

    The job gets the path and opens what it needs itself; failures are rows,
    or stop the work when not ``keep_going``.
    """
    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append((path, "ok", str(job(path))))
                except Exception as error:  # noqa: BLE001
                    if not keep_going:
                        raise
                    rows.append((path, "failed", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "status", "result"])

    return spread(sources.select("path"), "path").mapInPandas(run, "path string, status string, result string")


def job_report(results: DataFrame) -> DataFrame:
    """How many files went well and how many failed."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
