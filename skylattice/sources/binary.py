"""Binary records: fixed-length ones, and Fortran-armoured ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import entered, file_blocks, summarised
from .ranges import CHUNK_BYTES, file_sizes, open_input, record_chunks

# fixed values: field codes -> (numpy type without byte order, Spark type)
FIELD_TYPES = {
    "b": ("i1", "tinyint"), "B": ("u1", "smallint"), "h": ("i2", "smallint"), "H": ("u2", "int"),
    "i": ("i4", "int"), "I": ("u4", "bigint"), "q": ("i8", "bigint"), "Q": ("u8", "decimal(20,0)"),
    "f": ("f4", "float"), "d": ("f8", "double"),
}
_ALIGNMENTS = {"native": ("=", True), "little": ("<", False), "big": (">", False), "packed": ("=", False)}


def record_layout(fields: str, byte_order: str = "little"):
    """numpy record type and Spark schema of ``name(code)`` items; ``Ns`` is text of N bytes."""
    import numpy as np

    order, aligned = _ALIGNMENTS[byte_order]
    names, kinds, columns = [], [], []
    for name, code in re.findall(r"(\w+)\((\w+)\)", fields):
        if re.fullmatch(r"\d+s", code):
            kind, column = f"S{code[:-1]}", "string"
        else:
            base, column = FIELD_TYPES[code]
            kind = order + base
        names.append(name)
        kinds.append(kind)
        columns.append(f"`{name}` {column}")
    return np.dtype({"names": names, "formats": kinds}, align=aligned), ", ".join(columns)


def frame_of_records(array, columns=None):
    """A pandas DataFrame of a numpy record array in native byte order; text is decoded and stripped."""
    import numpy as np
    import pandas as pd

    out = {}
    for name in columns or array.dtype.names:
        values = array[name]
        if values.dtype.kind == "S":
            out[name] = [v.decode("latin-1").rstrip("\0 ") for v in values]
        elif values.dtype == np.dtype("u8") or values.dtype == np.dtype(">u8"):
            from decimal import Decimal

            out[name] = [Decimal(int(v)) for v in values]
        else:
            out[name] = values.astype(values.dtype.newbyteorder("="))
    return pd.DataFrame(out)


def read_records(spark: SparkSession, path, fields: str, byte_order: str = "little", skip_bytes: int = 0,
                 pattern: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Fixed-length records after a header of ``skip_bytes``; large files are read by many tasks."""
    layout, schema = record_layout(fields, byte_order)
    size = layout.itemsize
    chunks = record_chunks(file_sizes(spark, path, pattern), F.lit(skip_bytes), F.col("length"), F.lit(size),
                           chunk_bytes)

    def decode(batches):
        import numpy as np

        for batch in batches:
            for row in batch.itertuples():
                with open_input(row.path) as stream:
                    stream.seek(row.start)
                    data = stream.read(row.stop - row.start)
                yield frame_of_records(np.frombuffer(data, dtype=layout))

    return chunks.mapInPandas(decode, schema)


# --- length-armoured records -------------------------------------------------

ENTRY_BYTES = 16 << 10  #: how far into a block its first record is looked for in the block's table


def _markers(data: bytes, order: str):
    """The number that the four bytes at each place make."""
    import numpy as np

    return np.ndarray((max(0, len(data) - 3),), "<u4" if order == "little" else ">u4", data, strides=(1,))


def record_jumps(data: bytes, size: int, block: int, order: str):
    """Places in the first ENTRY_BYTES of a block where a record may begin, and where a reader that begins there gets to:
    behind the block, or to a place that no whole record begins at.

    ``data`` is the block and some bytes more, ``size`` the shortest record.  A record may begin where two equal
    lengths stand that far apart; chains of such places are followed for all of them at once.
    """
    import numpy as np

    marker = _markers(data, order)
    place = np.flatnonzero((marker[:block] >= size) & (marker[:block] <= max(0, len(data) - 8)))
    length = marker[place].astype(np.int64)
    inside = place + length + 8 <= len(data)
    place, length = place[inside], length[inside]
    whole = marker[place + 4 + length] == length
    place, to = place[whole], (place + length + 8)[whole]
    if not len(place):
        return place, place
    while True:  # jumps double
        at = np.minimum(np.searchsorted(place, to), len(place) - 1)
        goes_on = place[at] == to
        if not goes_on.any():
            break
        to = np.where(goes_on, to[at], to)
    first = place < ENTRY_BYTES
    return place[first], to[first]


def walk_records(stream, at: int, stop: int, length: int, size: int, order: str, path: str) -> int:
    """The place of the first record at or behind ``stop``, from that of a record before, marker by marker."""
    while at < stop:
        stream.seek(at)
        marker = int.from_bytes(stream.read(4), order)
        if marker < size:
            raise ValueError(f"{path}: record of {marker} bytes at {at}, {size} wanted")
        stream.seek(at + 4 + marker)
        if at + 8 + marker > length or int.from_bytes(stream.read(4), order) != marker:
            raise ValueError(f"{path}: record at {at} has unequal length markers")
        at += marker + 8
    return at


def read_fortran_records(spark: SparkSession, path, fields: str, byte_order: str = "little", skip_bytes: int = 0,
                         pattern: str | None = None, chunk_records: int | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """Records framed by 4-byte lengths.

    Blocks of a file are looked at in parallel: each tells, for all places where its first record might begin, where the
    next block's first record would be then.  Those tables are composed along the file, and blocks are decoded in
    parallel.  Where a table does not have the place (records longer than ENTRY_BYTES) that block is walked.
    Broken markers are errors that name their place.
    """
    layout, schema = record_layout(fields, byte_order)
    order = "big" if byte_order == "big" else "little"
    size = layout.itemsize
    block_bytes = chunk_records * (size + 8) if chunk_records else block_bytes

    def summary(path_: str, start: int, stop: int, length: int) -> dict:
        import zlib

        import numpy as np

        with open_input(path_) as stream:
            stream.seek(start)
            data = stream.read(min(length, stop + ENTRY_BYTES) - start)
        place, to = record_jumps(data, size, stop - start, order)
        target, of = np.unique(to, return_inverse=True)  # few, as chains run together
        packed = [np.diff(place, prepend=0).astype("<i4"), of.astype("<i4"), target.astype("<i8")]
        return {"n": len(place), "jumps": zlib.compress(b"".join(x.tobytes() for x in packed), 1)}

    def step(state: tuple, b) -> tuple:
        import zlib

        import numpy as np

        at, n = state[0], b.n
        raw = zlib.decompress(b.jumps)
        place, of = np.cumsum(np.frombuffer(raw, "<i4", n)), np.frombuffer(raw, "<i4", n, 4 * n)
        target = np.frombuffer(raw, "<i8", -1, 8 * n)
        while at < b.stop:
            k = int(np.searchsorted(place, at - b.start))
            if k < n and place[k] == at - b.start:
                at = b.start + int(target[of[k]])
            else:
                with open_input(b.path) as stream:
                    at = walk_records(stream, at, b.stop, b.length, size, order, b.path)
        return (at,)

    def decode(batches):
        import numpy as np

        for batch in batches:
            for b in batch.itertuples():
                if b.at >= b.next_at:
                    continue
                with open_input(b.path) as stream:
                    stream.seek(b.at)
                    data = stream.read(b.next_at - b.at)
                first = int.from_bytes(data[:4], order)
                if len(data) % (first + 8) == 0:
                    rows = np.frombuffer(data, np.uint8).reshape(-1, first + 8)
                    if (rows[:, :4] == rows[0, :4]).all() and (rows[:, -4:] == rows[0, :4]).all():  # all of one length
                        yield frame_of_records(np.frombuffer(rows[:, 4:4 + size].tobytes(), dtype=layout))
                        continue
                at, pieces = 0, []
                while at < len(data):
                    marker = int.from_bytes(data[at:at + 4], order)
                    pieces.append(data[at + 4:at + 4 + size])
                    at += marker + 8
                yield frame_of_records(np.frombuffer(b"".join(pieces), dtype=layout))

    files = file_sizes(spark, path, pattern).withColumn("begin", F.lit(skip_bytes).cast("bigint"))
    blocks, tasks = file_blocks(files, block_bytes)
    tables = summarised(blocks, summary, "n int, jumps binary")
    return entered(tables, (skip_bytes,), step, "at bigint", tasks).mapInPandas(decode, schema)
