"""Tables laid out along a space-filling curve, with a manifest of what each file holds.

Rows are sorted by their place on a Hilbert curve through several columns, so that a file holds rows that are alike in all of them.
The manifest has a row a file with the least and largest value of each column; a search on any of the columns asks
it first and opens only the files that can hold what is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 10  #: of each column's place: so many halvings between quantiles
ACCURACY = 100_000  #: of quantiles; any estimate gives the same rows, in other files


def hilbert_index(places: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (n, columns) with integer coordinates below 2^bits; columns * bits is 62 at most.

    After J. Skilling, "Programming the Hilbert curve" (2004): the coordinates' bits are untwisted from the highest on,
    then read in turns.
    """
    x = [places[:, k].astype(np.int64).copy() for k in range(places.shape[1])]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(n):
            set_ = (x[k] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap if k else 0
        bit >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turned = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turned = np.where((x[n - 1] & bit) != 0, turned ^ (bit - 1), turned)
        bit >>= 1
    out = np.zeros_like(x[0])
    for k in range(n):
        x[k] ^= turned
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            out = (out << 1) | ((x[k] >> b) & 1)
    return out


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def write_layout(df: DataFrame, path: str, columns: list[str], files: int, curve: str = "curve_place") -> None:
    """Writes ``path``/rows in about ``files`` files sorted along the curve through the columns, and ``path``/manifest.

    Columns (numbers, dates, timestamps) are cut at their quantiles, so that crowded ranges get as many steps as rows; NULL
    and NaN come first.
    """
    bits = min(BITS, 62 // len(columns))
    numbers = [_number(df, c) for c in columns]
    steps = 1 << bits
    quantiles = df.select(*(F.nanvl(n, F.lit(None).cast("double")).alias(f"q{k}") for k, n in enumerate(numbers))).agg(
        *(F.percentile_approx(f"q{k}", [i / steps for i in range(1, steps)], ACCURACY).alias(f"q{k}") for k in range(len(columns)))).first()
    cuts = [np.array(q or [], float) for q in quantiles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.num_columns - len(columns)
            x = [batch.column(own + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))]
            places = np.stack([np.where(np.isnan(v), 0, np.searchsorted(c, v, side="right")) for v, c in zip(x, cuts)], axis=-1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(hilbert_index(places, bits))], names=[*batch.schema.names[:own], curve])

    numbered = df.select("*", *(n.alias(f"__n{k}") for k, n in enumerate(numbers)))
    placed = numbered.mapInArrow(run, T.StructType([*df.schema, T.StructField(curve, T.LongType())]))
    placed.repartitionByRange(files, curve).sortWithinPartitions(curve).write.parquet(f"{path}/rows")
    spark = df.sparkSession
    rows = spark.read.schema(T.StructType([*df.schema, T.StructField(curve, T.LongType())])).parquet(f"{path}/rows")
    found = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
    found.write.parquet(f"{path}/manifest")


def read_layout(spark: SparkSession, path: str, limits: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie within limits (both included; None is no limit): only files that can hold such are opened."""
    manifest = spark.read.parquet(f"{path}/manifest")
    test, exact = F.lit(True), F.lit(True)
    for name, (low, high) in limits.items():
        if low is not None:
            test, exact = test & (F.col(f"max_{name}") >= F.lit(low)), exact & (F.col(name) >= F.lit(low))
        if high is not None:
            test, exact = test & (F.col(f"min_{name}") <= F.lit(high)), exact & (F.col(name) <= F.lit(high))
    files = [r["file"] for r in manifest.filter(test).select("file").orderBy("file").collect()]  # names of the files to open
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.filter(exact)
