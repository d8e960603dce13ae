"""FITS files: header catalogues, binary tables, primary images.

Headers are read block by block up to END, never the data behind them; data
are read in byte ranges by many tasks.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import CHUNK_BYTES, file_sizes, open_input, record_chunks, spread

BLOCK = 2880
FILES_A_TASK = 100
CARD = 80


def parse_cards(text: str) -> list[tuple[str, str]]:
    """(keyword, value text) of header cards with a value; quotes and comments are off."""
    pairs = []
    for at in range(0, len(text), CARD):
        card = text[at:at + CARD]
        if card.startswith("END") and not card[3:].strip():
            break
        if card[8:10] != "= ":
            continue
        body = card[10:].strip()
        if body.startswith("'"):
            value = re.match(r"'((?:[^']|'')*)'", body)
            value = value.group(1).replace("''", "'").rstrip() if value else body
        else:
            value = body.split("/", 1)[0].strip()
        pairs.append((card[:8].strip(), value))
    return pairs


def read_header(stream, start: int = 0) -> tuple[str, int]:
    """Header text at an offset and the offset behind it."""
    stream.seek(start)
    text = ""
    while True:
        block = stream.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError("header without END")
        block = block.decode("ascii", "replace")
        text += block
        start += BLOCK
        if any(block[i:i + CARD].rstrip() == "END" for i in range(0, BLOCK, CARD)):
            return text, start


def _data_size(cards: dict) -> int:
    axes = int(cards.get("NAXIS", 0))
    if not axes:
        return 0
    size = abs(int(cards["BITPIX"])) // 8 * int(cards.get("GCOUNT", 1))
    count = 1
    for i in range(1, axes + 1):
        count *= int(cards[f"NAXIS{i}"])
    size *= int(cards.get("PCOUNT", 0)) + count
    return (size + BLOCK - 1) // BLOCK * BLOCK


def find_hdu(stream, index: int) -> tuple[dict, int]:
    """Cards of a header and the offset of its data."""
    at = 0
    for _ in range(index):
        text, at = read_header(stream, at)
        at += _data_size(dict(parse_cards(text)))
    text, at = read_header(stream, at)
    return dict(parse_cards(text)), at


def _headers(files: DataFrame, hdu: int) -> DataFrame:
    """path, length, data offset and cards of one header per file."""
    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"]):
                with open_input(path) as stream:
                    cards, at = find_hdu(stream, hdu)
                rows.append((path, length, at, cards))
            yield pd.DataFrame(rows, columns=["path", "length", "data_start", "cards"])

    # a task for each of a few files, a hundred files a task when there are very many
    count = files.count()
    tasks = min(count, max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // FILES_A_TASK))
    return spread(files, "path", tasks=tasks).mapInPandas(
        read, "path string, length bigint, data_start bigint, cards map<string,string>")


def read_headers(spark: SparkSession, path, keys, hdu: int = 0, pattern: str | None = None) -> DataFrame:
    """One row per file with header values as text columns; ``-`` in keywords becomes ``_``."""
    found = _headers(file_sizes(spark, path, pattern), hdu)
    return found.select(
        F.col("path").alias("source_path"),
        *(F.col("cards")[k].alias(k.replace("-", "_")) for k in keys))


# fixed values: TFORM codes -> (big-endian numpy type, bytes, Spark type)
TFORM_TYPES = {"L": ("S1", 1, "boolean"), "B": ("u1", 1, "smallint"), "I": (">i2", 2, "smallint"),
               "J": (">i4", 4, "int"), "K": (">i8", 8, "bigint"), "E": (">f4", 4, "float"),
               "D": (">f8", 8, "double"), "A": ("S", 1, "string")}


#: integers whose zero point makes them unsigned (or bytes signed): (code, TZERO) -> Spark type
UNSIGNED = {("B", -128): "smallint", ("I", 1 << 15): "int", ("J", 1 << 31): "bigint", ("K", 1 << 63): "decimal(20,0)"}


@dataclass(frozen=True)
class TableColumn:
    """A column of a binary table: where it stands in a row, and what its numbers mean."""

    name: str
    code: str
    offset: int
    count: int
    pointer: str = ""  #: P or Q where the row holds a length and a place in the heap
    scale: float = 1.0
    zero: float = 0.0
    null: int | None = None

    @property
    def scaled(self) -> bool:
        return self.code not in "AL" and (self.scale, self.zero) != (1, 0) and not self.unsigned

    @property
    def unsigned(self) -> str | None:
        return UNSIGNED.get((self.code, self.zero)) if self.scale == 1 else None

    @property
    def kind(self) -> str:
        """The Spark type."""
        one = self.unsigned or ("double" if self.scaled else TFORM_TYPES[self.code][2])
        return one if self.code == "A" or not self.pointer and self.count == 1 else f"array<{one}>"

    @property
    def many(self) -> bool:
        return self.code != "A" and (bool(self.pointer) or self.count != 1)


def table_layout(cards: dict) -> list[TableColumn]:
    """The columns of a binary table."""
    columns, offset = [], 0
    for i in range(1, int(cards["TFIELDS"]) + 1):
        repeat, pointer, code = re.match(r"(\d*)([PQ]?)([A-Z])", cards[f"TFORM{i}"]).groups()
        count = int(repeat) if repeat else 1
        if code not in TFORM_TYPES:
            raise ValueError(f"table columns of type {code} are not understood")
        null = cards.get(f"TNULL{i}")
        columns.append(TableColumn(
            cards.get(f"TTYPE{i}", f"col{i}"), code, offset, count, pointer, float(cards.get(f"TSCAL{i}", 1)), float(cards.get(f"TZERO{i}", 0)),
            int(null) if null is not None and code in "BIJK" else None))
        offset += {"": TFORM_TYPES[code][1], "P": 8, "Q": 16}[pointer] * count
    return columns


def _meant(column: TableColumn, stored):
    """Stored numbers as a list of what they mean, None for nulls."""
    import numpy as np

    if column.code == "L":
        return [{b"T": True, b"F": False}.get(v) for v in stored.tolist()]
    native = stored.astype(stored.dtype.newbyteorder("="))
    if column.unsigned:
        zero = int(column.zero)
        values = [Decimal(int(v) + zero) for v in native] if column.code == "K" else (native.astype(np.int64) + zero).tolist()
    else:
        values = (native * column.scale + column.zero if column.scaled else native).tolist()
    return values if column.null is None else [None if n == column.null else v for n, v in zip(native.tolist(), values)]


def _heap_values(stream, column: TableColumn, lengths, places, heap: int) -> list:
    """The arrays (or texts) that pointers name, read in the order they stand in the heap."""
    import numpy as np

    base, width, _ = TFORM_TYPES[column.code]
    kind = np.dtype("S1" if column.code == "A" else base)
    out: list = [None] * len(lengths)
    order = np.argsort(places, kind="stable")
    at = 0
    while at < len(order):
        first = int(places[order[at]])
        end, last = first, at
        while last < len(order):  # pointers that follow closely are one read
            start = int(places[order[last]])
            stop = start + int(lengths[order[last]]) * width
            if start > end + HEAP_GAP or max(stop, end) - first > HEAP_BYTES and last > at:
                break
            end, last = max(end, stop), last + 1
        stream.seek(heap + first)
        data = stream.read(end - first)
        for k in order[at:last]:
            start = int(places[k]) - first
            piece = data[start:start + int(lengths[k]) * width]
            if column.code == "A":
                out[k] = piece.decode("latin-1").rstrip("\0 ")
            else:
                out[k] = _meant(column, np.frombuffer(piece, kind))
        at = last
    return out


HEAP_GAP, HEAP_BYTES = 64 << 10, 32 << 20


def _decoded(stream, cards: dict, start: int, stop: int, data_start: int):
    """A pandas frame of the rows of a byte range."""
    import numpy as np
    import pandas as pd

    columns, width = table_layout(cards), int(cards["NAXIS1"])
    heap = data_start + int(cards.get("THEAP", width * int(cards["NAXIS2"])))
    stream.seek(start)
    rows = np.frombuffer(stream.read(stop - start), np.uint8).reshape(-1, width)
    out = {}
    for c in columns:
        size = {"": TFORM_TYPES[c.code][1], "P": 8, "Q": 16}[c.pointer] * c.count
        raw = np.ascontiguousarray(rows[:, c.offset:c.offset + size])
        if c.pointer:
            pairs = raw.view(">i4" if c.pointer == "P" else ">i8").astype(np.int64).reshape(len(rows), -1) if c.count else np.zeros((len(rows), 2), np.int64)
            out[c.name] = _heap_values(stream, c, pairs[:, 0], pairs[:, 1], heap)
        elif c.code == "A":
            out[c.name] = [bytes(r).decode("latin-1").split("\0")[0].rstrip(" ") for r in raw]
        elif c.many:
            flat = _meant(c, raw.reshape(-1).view(TFORM_TYPES[c.code][0])) if c.count else []
            out[c.name] = [flat[k * c.count:(k + 1) * c.count] for k in range(len(rows))]
        else:
            out[c.name] = _meant(c, raw.reshape(-1).view(TFORM_TYPES[c.code][0]))
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items()})


def read_table(spark: SparkSession, path, hdu: int = 1, pattern: str | None = None,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of a binary table, scaled and with nulls as the headers say, columns of variable length from the heap.

    All files must have the same columns of the same types; places, scales and nulls are each file's own.
    """
    headers = _headers(file_sizes(spark, path, pattern), hdu)

    def kinds(batches):
        import pandas as pd

        for batch in batches:
            found = [json.dumps([(c.name, c.kind) for c in table_layout(dict(cards))]) for cards in batch["cards"]]
            yield pd.DataFrame({"path": batch["path"], "kinds": found})

    layouts = headers.select("path", "cards").mapInPandas(kinds, "path string, kinds string").groupBy("kinds").agg(
        F.min("path").alias("path")).orderBy("path").limit(2).collect()  # two tell that there is more than one
    if not layouts:
        raise ValueError(f"no file in {path}")
    if len(layouts) > 1:
        raise ValueError(f"{layouts[0]['path']} and {layouts[1]['path']} have different columns")
    columns = json.loads(layouts[0]["kinds"])
    schema = ", ".join(f"`{name}` {kind}" for name, kind in columns)
    width = F.col("cards")["NAXIS1"].cast("bigint")
    count = F.col("cards")["NAXIS2"].cast("bigint")
    chunks = record_chunks(headers, F.col("data_start"), F.col("data_start") + width * count, width, chunk_bytes)

    def decode(batches):
        for batch in batches:
            for row in batch.itertuples():
                with open_input(row.path) as stream:
                    yield _decoded(stream, dict(row.cards), row.start, row.stop, row.data_start)[[name for name, _ in columns]]

    return chunks.select("path", "start", "stop", "data_start", "cards").mapInPandas(decode, schema)


def read_image_rows(spark: SparkSession, path, hdu: int = 0, pattern: str | None = None,
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of pixels (source_path, y, values) of an image, with BSCALE and BZERO applied; y counts from 1."""
    headers = _headers(file_sizes(spark, path, pattern), hdu)
    card = lambda key, default: F.coalesce(F.col("cards")[key].cast("double"), F.lit(default))
    width = F.abs(F.col("cards")["BITPIX"].cast("bigint")) / 8 * F.col("cards")["NAXIS1"].cast("bigint")
    rows = F.col("cards")["NAXIS2"].cast("bigint")
    headers = headers.withColumns({
        "bitpix": F.col("cards")["BITPIX"].cast("int"), "nx": F.col("cards")["NAXIS1"].cast("int"),
        "bscale": card("BSCALE", 1.0), "bzero": card("BZERO", 0.0)})
    chunks = record_chunks(headers, F.col("data_start"), F.col("data_start") + width * rows, width, chunk_bytes)

    def decode(batches):
        import numpy as np
        import pandas as pd

        kinds = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
        for batch in batches:
            for row in batch.itertuples():
                with open_input(row.path) as stream:
                    stream.seek(row.start)
                    data = np.frombuffer(stream.read(row.stop - row.start), dtype=kinds[row.bitpix])
                values = data.reshape(-1, row.nx).astype("f8") * row.bscale + row.bzero
                ys = np.arange(row.first_record + 1, row.first_record + 1 + len(values))
                yield pd.DataFrame({"source_path": row.path, "y": ys, "values": list(values)})

    return chunks.select("path", "start", "stop", "first_record", "bitpix", "nx", "bscale", "bzero").mapInPandas(
        decode, "source_path string, y bigint, values array<double>")


def pixels(rows: DataFrame) -> DataFrame:
    """Pixels (source_path, x, y, value) of image rows; x counts from 1."""
    return rows.select("source_path", F.posexplode("values").alias("x", "value"), "y").select(
        "source_path", (F.col("x") + 1).cast("bigint").alias("x"), "y", "value")
