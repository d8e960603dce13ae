"""Word search by an inverted index.

A posting list tells which keys hold a term: a stem, or a word as it is (written with ``=`` in front).  Keys are dealt into
blocks of 65,536; a row of the index holds a term's keys in one block, sorted and kept as differences, so that no
list grows with the table however common a word is.  Rows lie in folders by a hash of the term and are sorted by it: a
search opens the folders of its words and reads the row groups that hold them.  Lists of a block are intersected as sorted arrays.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem, stem_column
from ..functions.text import query_words, words_of
from ..session import scratch_path

BLOCK_BITS = 16
FOLDERS = 64


def write_index(df: DataFrame, key: str, columns, path: str, folders: int = FOLDERS) -> None:
    """Writes the index of the words in some columns, taken as one document a row; ``key`` is an integer that tells rows apart.

    Rows without a key are not in the index; texts that are NULL hold no word.
    """
    text = F.concat_ws(" ", *(F.col(c) for c in ([columns] if isinstance(columns, str) else columns)))
    place = F.col(key).cast("bigint")
    words = df.filter(place.isNotNull()).select(F.explode(F.array_distinct(words_of(text))).alias("word"), place.alias("key"))
    block, offset = F.shiftright("key", BLOCK_BITS), F.col("key").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    # texts are cut into words once: the lists of words are kept, as they are read several times below
    kept = scratch_path(df.sparkSession, "word-lists")
    words.groupBy("word", block.alias("block")).agg(F.collect_set(offset).alias("keys")).write.parquet(kept)
    lists = df.sparkSession.read.schema("word string, block bigint, keys array<int>").parquet(kept)
    # stems are worked out once a word
    stems = lists.select("word").distinct().withColumn("term", stem_column(F.col("word")))
    by_stem = lists.join(stems, "word").groupBy("term", "block").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    exact = lists.select(F.concat(F.lit("="), "word").alias("term"), "block", "keys")
    ordered = by_stem.unionByName(exact).withColumn("keys", F.array_sort("keys"))
    gaps = F.transform("keys", lambda k, i: k - F.when(i > 0, F.get(F.col("keys"), i - 1)).otherwise(0))
    rows = ordered.select("term", "block", gaps.alias("gaps"), F.pmod(F.crc32("term"), F.lit(folders)).cast("int").alias("folder"))
    rows.repartition(folders, "folder").sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(path)


def search_index(spark: SparkSession, path: str, query: str, stemmed: bool = True, folders: int = FOLDERS) -> DataFrame:
    """The keys (column ``key``) of rows that hold all words of a query, stop words off; none without a word."""
    terms = sorted({stem(w) if stemmed else "=" + w for w in query_words(query)})
    index = spark.read.schema("term string, block bigint, gaps array<int>, folder int").parquet(path)

    def wanted(term: str) -> Column:
        return (F.col("folder") == zlib.crc32(term.encode()) % folders) & (F.col("term") == term)

    def both(_: tuple, lists: pa.Table) -> pa.Table:
        found = []
        if lists.num_rows == len(terms):
            keys = sorted((np.cumsum(g.values.to_numpy()) for g in lists["gaps"]), key=len)  # the shortest first
            found = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), keys) + (lists["block"][0].as_py() << BLOCK_BITS)
        return pa.table({"key": pa.array(found, pa.int64())})

    rows = index.filter(reduce(lambda a, b: a | b, map(wanted, terms), F.lit(False)))
    return rows.select("block", "gaps").groupBy("block").applyInArrow(both, "key bigint")
