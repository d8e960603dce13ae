"""Files cut into blocks at any byte, for formats whose meaning at a byte depends on all before it.

Three steps: each block tells, for every state it may be entered in, the state it is left in; those maps, one
small row a block, are composed along each file; then every block is decoded from the state it is really entered in.  A
record belongs to the block it begins in, and its reader reads on beyond the block to the record's end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import open_input, spread

BLOCK_BYTES = 16 << 20
READ_ON = 64 << 10  #: bytes read at a time beyond a block

_KEYS = "path string, block bigint, start bigint, stop bigint, length bigint"


def file_blocks(files: DataFrame, block_bytes: int, begin="begin") -> tuple[DataFrame, int]:
    """Blocks (path, block, start, stop, length, ...) of files (path, length, begin, ...), a task each, and their number."""
    count = F.ceil((F.col("length") - F.col(begin)) / F.lit(block_bytes))
    blocks = files.filter(count > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    start = F.col(begin) + F.col("block") * block_bytes
    rest = [c for c in files.columns if c not in ("path", "length", begin)]
    blocks = blocks.select("path", "block", start.alias("start"), F.least(F.col("length"), start + block_bytes).alias("stop"), "length", *rest)
    n = blocks.count()
    return spread(blocks, "path", "block", tasks=n), n


def read_block(path: str, start: int, stop: int) -> bytes:
    with open_input(path) as stream:
        stream.seek(start)
        return stream.read(stop - start)


def later_bytes(path: str, start: int, length: int) -> Iterator[bytes]:
    """The bytes of a file from a place on, in growing pieces."""
    with open_input(path) as stream:
        stream.seek(start)
        size = READ_ON
        while start < length:
            data = stream.read(min(size, length - start))
            if not data:
                return
            yield data
            start += len(data)
            size *= 2


def summarised(blocks: DataFrame, summary: Callable[[str, int, int, int], dict], schema: str) -> DataFrame:
    """A row of ``summary(path, start, stop, length)`` for each block."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                yield pd.DataFrame([{"path": b.path, "block": b.block, "start": b.start, "stop": b.stop, "length": b.length,
                                     **summary(b.path, b.start, b.stop, b.length)}])

    return blocks.select("path", "block", "start", "stop", "length").mapInPandas(run, f"{_KEYS}, {schema}")


def entered(summaries: DataFrame, first, step: Callable, schema: str, tasks: int) -> DataFrame:
    """Blocks with the state each is entered in, and the next one's, as the columns of ``schema`` (without and with ``next_``).

    ``step(state, summary)`` gives the state after a block; states are tuples in the order of the schema.  One task takes
    the summaries of a file, one small row a block; the blocks are then dealt to ``tasks`` tasks.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = first, []
        for b in frame.sort_values("block").itertuples():
            after = step(state, b)
            out.append((b.path, b.block, b.start, b.stop, b.length, *state, *after))
            state = after
        return pd.DataFrame(out, columns=["path", "block", "start", "stop", "length", *names, *(f"next_{n}" for n in names)])

    both = ", ".join([_KEYS, schema, *(f"next_{c}" for c in schema.split(", "))])
    return spread(summaries.groupBy("path").applyInPandas(run, both), "path", "block", tasks=tasks)
