"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words.  Its documents then have the same fractional number of copies, target / size of the
source, and the fractions are rounded dependently: two documents with fractions exchange words, one up and one down, at
random but fair on average, until one of the two has a whole number of copies; what remains of the other meets the next.
The words of a source stay what they were through every exchange, and at its end a single fraction is left to chance.

Documents are dealt by hash into buckets of bounded size; a bucket leaves one residual at most, and residuals meet in a
tree whose nodes join a fixed number of children, so a source with a third of all rows is as many independent tasks as it
needs.  Order and random numbers depend on the rows and the seed only: reruns and repeated tasks decide alike.

Defined results: null sources are a source of their own, last in order; null and empty texts have size 0, and are copied
floor(target / size) times; repeated rows (doc_id, text and source) are decided together.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, settled, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5  #: words of the mix for each word of the input
MOST = 2.0  #: copies a document has at most
BUCKET = 5_000  #: documents that one task pairs
FAN = 64  #: residuals that one node of the tree pairs


def size(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their number from 0 in code point order, null last; sorted in ranges, never in one task."""
    ranges = settled(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    offsets = counts.withColumn("offset", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return ranges.withColumn("inner", inner).join(offsets, "part").withColumn("number", F.col("inner") + F.col("offset")).drop(
        "part", "inner", "offset")


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds the target of words to each row (source, source_size): by weight, at most ``most`` times its size, the excess
    shared out among the others by weight until none is above."""
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("number", F.lit(len(weights))).cast("int"))
    weighed = settled(_numbered(sources).withColumn("weight", weight.cast("double")).drop("number"), "weights")
    full = F.lit(most) * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    unit, capped = 0.0, -1
    while True:  # each turn fills one source more at least; usually a few turns
        over = F.col("weight") * unit > full
        n, words, open_weight = weighed.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, full)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not open_weight:
            break
        unit, capped = (share * total - words) / open_weight, n
    return weighed.withColumn("target", F.least(F.col("weight") * unit, full)).drop("weight")


def _paired(rows: pd.DataFrame, rng: np.random.Generator, last: bool) -> pd.DataFrame:
    """Decides all rows but one: extra is 1 or 0, the residual keeps a fraction (and is decided by chance if last)."""
    sizes, fractions = rows["words"].tolist(), rows["fraction"].tolist()
    extra: list[float] = [math.nan] * len(rows)
    luck = rng.random(len(rows) + 1).tolist()
    held = None
    for k in range(len(rows)):
        if held is None:
            held = k
            continue
        a, b, x, y = sizes[held], sizes[k], fractions[held], fractions[k]
        up, down = min(a * (1 - x), b * y), min(a * x, b * (1 - y))  # words that can move to the held one, and from it
        if luck[k] * (up + down) < down:
            x, y = (1.0, y - up / b) if up == a * (1 - x) else (x + up / a, 0.0)
        else:
            x, y = (0.0, y + down / b) if down == a * x else (x - down / a, 1.0)
        fractions[held], fractions[k] = x, y
        held_whole, whole = x in (0.0, 1.0), y in (0.0, 1.0)
        if held_whole:
            extra[held] = x
        if whole:
            extra[k] = y
        held = None if held_whole and whole else k if held_whole else held
    if held is not None and last:
        extra[held] = float(luck[-1] < fractions[held])
    return rows.assign(fraction=fractions, extra=extra)


_ROUND = "k1 long, k2 long, source string, bucket long, words long, fraction double, extra double"


def _rounded(units: DataFrame, seed: int) -> DataFrame:
    """(k1, k2, extra) of units (k1, k2, source, bucket, words, fraction) with fractions between 0 and 1."""
    top = units.agg(F.max("bucket")).first()[0]
    levels = 0 if top is None else math.ceil(math.log(top + 1, FAN)) if top else 0
    done, left = [], units

    def pairing(level: int):
        def pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            source = zlib.crc32(b"" if key[0] is None or key[0] != key[0] else b"s" + str(key[0]).encode())
            rng = np.random.default_rng([seed, level, source, int(key[1])])
            return _paired(rows.sort_values(["k1", "k2"], kind="stable"), rng, level == levels)
        return pair

    for level in range(levels + 1):
        state = settled(left.groupBy("source", "bucket").applyInPandas(pairing(level), _ROUND), f"round{level}")
        decided = F.col("extra").isNotNull() & ~F.isnan("extra")
        done.append(state.filter(decided).select("k1", "k2", "extra"))
        left = state.filter(~decided).drop("extra").withColumn("bucket", F.floor(F.col("bucket") / FAN))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def decisions(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (doc_id, source, text): its keys, doc_id, source and size; per key: copies, source_size, target."""
    k1, k2 = row_key("doc_id", "source", "text")
    rows = settled(docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "source", size().alias("size")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    aimed = settled(with_targets(sources), "targets").withColumnRenamed("source", "s")
    units = rows.groupBy("k1", "k2", "source", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(aimed, F.col("source").eqNullSafe(F.col("s"))).withColumns({"ratio": ratio}).withColumns({
        "whole": F.floor("ratio"), "fraction": F.col("ratio") - F.floor("ratio"),
        "bucket": F.pmod(F.xxhash64("k1", F.lit("bucket")), F.ceil(F.col("n_rows") / BUCKET).cast("long"))})
    units = settled(units.select("k1", "k2", "source", "bucket", "words", "fraction", "whole", "source_size", "target"), "units")
    open_ones = units.filter("fraction > 0 AND words > 0").select("k1", "k2", "source", "bucket", "words", "fraction")
    extra = _rounded(open_ones, seed)
    made = units.join(extra, ["k1", "k2"], "left").select(
        "k1", "k2", (F.col("whole") + F.coalesce("extra", F.lit(0.0))).cast("int").alias("copies"), "source_size", "target")
    return rows, settled(made, "copies")


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target (its source's) and taken (words the mix takes of it)."""
    rows, made = decisions(docs, seed)
    return rows.join(made, ["k1", "k2"]).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix: each row of ``docs`` as often as it was decided, all columns unchanged."""
    _, made = decisions(docs, seed)
    k1, k2 = row_key("doc_id", "source", "text")
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    made = made.filter("copies > 0").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("copies").alias("__copies"))
    again = keyed.join(made, ["__k1", "__k2"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return again.select(*docs.columns)
