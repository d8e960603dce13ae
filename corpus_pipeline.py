"""A corpus pipeline: quality rules, line dedup, near documents, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before has kept; what it returns is written as
Parquet to the shared folder and read again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import mixing, near_lines, ngram_groups, outliers, pieces
from skylattice.llm.common import settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or are outliers of their language and source go."""
    return outliers.keep_ordinary(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier one go, and documents left without a word."""
    return near_lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near documents stays."""
    return ngram_groups.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_pieces and piece_score of each row."""
    return pieces.encoded(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("n-gram join", near_dedup), ("mix", mix), ("pieces", tokens)]

#: estimates by iteration, random rounding and tokens are nothing SQL can say: tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), "stage")
    return docs
