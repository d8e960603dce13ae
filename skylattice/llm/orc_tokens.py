"""Token ids in ORC files.

Texts are dealt out in ranges of doc_id, encoded, and written in ascending order, one file a range.  ORC keeps integers in
run-length encoding, in stripes that readers take in parallel, with row indexes (least and largest doc_id of every few
rows) and Bloom filters on doc_id: a filter on documents reads only stripes and row groups that can hold them.  Each row
also tells its number and its first id's place in the file, so the place in the whole corpus needs one sum per file.

The encoder takes a text apart with the tokenizer's own pattern, gives new parts to the tokenizer's model and remembers the
ids of frequent ones; texts with characters on whose class libraries may differ, or with a special token's string, go to
the tokenizer as a whole.

Defined results: null texts are empty and get the end id only; rows without doc_id come last; rows with one doc_id stand
in the order of their texts' hashes; empty tables give one empty file.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

END_ID = 2
REMEMBERED = 400_000
LONGEST_REMEMBERED = 32
STRIPE_BYTES = 16 << 20
ROWS_AN_INDEX = 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """part of a text -> its ids as bytes, filled by the tokenizer's model as parts come

    When half of what may be remembered is reached, the parts become the old ones; old parts that come again are taken
    over, so frequent parts are not encoded anew.
    """

    #: fixed values: the pattern of byte-level encoders, with the letters and numbers below U+0250
    LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
    NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
    PATTERN = rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
    ASCII = r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
    ODD = r"[\x1c-\x1fɐ-\U0010ffff]"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(self.ODD).search
        byte_level = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.in_parts = byte_level and self.tokenizer.normalizer is None
        self.ascii_parts = re.compile(self.ASCII, re.ASCII).findall
        self.parts = re.compile(self.PATTERN).findall
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if part.isascii() and part.isprintable():
                letters = part.replace(" ", "\u0120")
            else:
                letters = part.encode().decode("latin-1").translate(self.letters)
            ids = array("i", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(part) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not self.in_parts or self.odd(text) or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        parts = self.ascii_parts(text) if text.isascii() else self.parts(text)
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), np.int32)


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level encoders write for bytes: printable ones are themselves, the others follow U+00FF."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 0x100 + k for k, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Writes (doc_id, row, offset, n_tokens, ids) of ``docs`` (doc_id, text) below ``path``, in ``files`` files or as many
    as the session has shuffle partitions."""
    tokenizer = tokenizer or default_tokenizer()
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row, offset = encoder(tokenizer), 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids = [np.append(table.encode(t.as_py() or ""), np.int32(end_id)) for t in batch.column("text")]
                n = np.array([len(i) for i in ids], np.int64)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(np.arange(row, row + len(n))), pa.array(offset + ends - n), pa.array(n), lists],
                    names=["doc_id", "row", "offset", "n_tokens", "ids"])
                row, offset = row + len(n), offset + int(ends[-1])

    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order)
    encoded = dealt.mapInArrow(run, "doc_id long, row long, offset long, n_tokens long, ids array<int>")
    encoded.write.options(**{
        "compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.create.index": "true",
        "orc.row.index.stride": str(ROWS_AN_INDEX), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) in any order; what is broadcast is one number a file.

    A filter on doc_id reaches the indexes and Bloom filters for the ids, not for the sums, which need every file.
    """
    rows = spark.read.schema("doc_id long, row long, offset long, n_tokens long, ids array<int>").orc(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = rows.withColumn("part", part)
    ends = rows.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("total"))  # one row a file
    bases = ends.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def ids_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of some documents: stripes and row groups without them are not read."""
    rows = spark.read.schema("doc_id long, row long, offset long, n_tokens long, ids array<int>").orc(path)
    return rows.filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` to the shared folder and returns, read back, doc_id, start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "ids")
    write_ids(docs, path, tokenizer)
    return read_ids(spark, path).mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
