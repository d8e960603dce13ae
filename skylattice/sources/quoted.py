"""Delimited text whose quoted fields may hold anything, newlines included, read by many tasks a file.

A quote opens a quoted field only at a field's start; two quotes inside stand for one; text after the closing quote belongs to
the field.  Whether a byte in the middle of a file is quoted depends on all quotes before it, so files are read as
``blocks`` describes, with the five states below.
"""

from __future__ import annotations

import csv
import functools
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, entered, file_blocks, later_bytes, read_block, summarised
from .ranges import file_sizes, spread

RECORD, FIELD, PLAIN, QUOTED, CLOSED = range(5)  #: at the start of a record, of a field; in a plain, a quoted one; after a quote in that
_NEWLINES = b"\r\n"


@functools.lru_cache(maxsize=16)
def _patterns(delimiter: str) -> dict[str, re.Pattern]:
    d = re.escape(delimiter.encode())
    plain = rb"[^" + d + rb"\r\n]*+"
    field = rb'(?:"(?:[^"]++|"")*+"' + plain + rb'|(?!")' + plain + rb")"
    return {name: re.compile(p, re.S) for name, p in {
        "plain": plain, "inside": rb'(?:[^"]++|"")*+', "fields": rb"(?:" + field + rb"[" + d + rb"\r\n])*+",
        "record": rb"(?:" + field + d + rb")*+" + field + rb"[\r\n]", "open": rb'"(?:[^"]++|"")*+("?)'}.items()}


def _next_field(data: bytes, state: int, p: dict) -> tuple[int, int]:
    """Where the first field after an entry state begins, with RECORD or FIELD; or -1 and the state the data ends in."""
    at = 0
    if state in (RECORD, FIELD):
        return 0, state
    if state == CLOSED:
        state = QUOTED if data[:1] == b'"' else PLAIN
        at = 1 if state == QUOTED else 0
        if not data:
            return -1, CLOSED
    if state == QUOTED:
        at = p["inside"].match(data, at).end()
        if at == len(data):
            return -1, QUOTED
        at += 1
        if at == len(data):
            return -1, CLOSED
    at = p["plain"].match(data, at).end()
    if at == len(data):
        return -1, PLAIN
    return at + 1, RECORD if data[at] in _NEWLINES else FIELD


def _ends_in(data: bytes, at: int, state: int, p: dict) -> int:
    """The state after data in which a field begins at ``at``."""
    end = p["fields"].match(data, at).end()
    if end == len(data):
        return state if end == at else RECORD if data[end - 1] in _NEWLINES else FIELD
    if data[end:end + 1] != b'"':
        return PLAIN
    tail = p["open"].match(data, end)
    if tail.end() < len(data):
        return PLAIN
    return CLOSED if tail[1] else QUOTED


def exits(data: bytes, delimiter: str = ",") -> list[int]:
    """The state after the data for each of the five states before it."""
    p, known, out = _patterns(delimiter), {}, []
    for state in range(5):
        at, found = _next_field(data, state, p)
        if at >= 0:
            if at not in known or at == len(data):
                known[at] = _ends_in(data, at, found, p)
            found = known[at]
        out.append(found)
    return out


def _record_start(data: bytes, state: int, delimiter: str) -> tuple[int, int]:
    """Where the first record begins in data entered in a state, or -1 and the state after it."""
    p = _patterns(delimiter)
    at, state = _next_field(data, state, p)
    if at < 0 or state == RECORD:
        return at, state
    found = p["record"].match(data, at)
    return (found.end(), RECORD) if found else (-1, _ends_in(data, at, state, p))


def first_record(path: str, start: int, length: int, state: int, delimiter: str) -> int:
    """The place of the first record that begins at ``start`` or later, the end of the file if there is none."""
    at = start
    for data in later_bytes(path, start, length):
        found, state = _record_start(data, state, delimiter)
        if found >= 0:
            return at + found
        at += len(data)
    return length


def _rows(text: str, delimiter: str) -> Iterator[list[str]]:
    csv.field_size_limit(2 ** 31 - 1)
    return (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r)


def _head(path: str, length: int, top_ignored: int, header: bool, delimiter: str, encoding: str) -> tuple[int, list[str]]:
    """Where a file's records begin, and the names in the first one if there is a header."""
    begin, left = 0, top_ignored
    for data in later_bytes(path, 0, length) if left else ():
        ends = [m.end() for m in re.finditer(b"\n", data)][:left]
        left -= len(ends)
        if not left:
            begin += ends[-1]
            break
        begin += len(data)
    names: list[str] = []
    while header and begin < length and not names:  # blank lines are no header
        end = first_record(path, begin, length, FIELD, delimiter)  # that after this one
        text = read_block(path, begin, end).decode(encoding).removeprefix("\ufeff")
        names, begin = [n.strip() for row in _rows(text, delimiter) for n in row], end
    return begin, names


def read_quoted(spark: SparkSession, path, names=None, delimiter: str = ",", strip: bool = False, top_ignored: int = 0,
                encoding: str = "utf-8", pattern: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Delimited text with names from ``names`` or each file's first record; all columns are strings, empty fields NULL.

    Columns are those of the header of the file that comes first by path; columns that a file does not have are NULL, and so
    are fields that a record does not have.  Fields beyond the names are left out.  ``top_ignored`` lines come
    before anything else in each file.  ``strip`` takes blanks off the fields after they have been read.
    """
    if len(delimiter.encode()) != 1 or delimiter in '"\r\n':
        raise ValueError(f"{delimiter!r} cannot part fields")
    head = functools.partial(_head, top_ignored=top_ignored, header=names is None, delimiter=delimiter, encoding=encoding)

    def heads_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(p, n, *head(p, n)) for p, n in zip(frame["path"], frame["length"])]
            yield pd.DataFrame(found, columns=["path", "length", "begin", "names"])

    heads = spread(file_sizes(spark, path, pattern), "path").mapInPandas(heads_of, "path string, length bigint, begin bigint, names array<string>")
    with_header = names is None
    if with_header:
        first = heads.filter(F.size("names") > 0).orderBy("path").select("names").first()  # one row
        names = first["names"] if first else []
        if not names:
            raise ValueError(f"no header in {path}")
    names = list(names)
    blocks, tasks = file_blocks(heads.drop("names"), block_bytes)
    maps = summarised(blocks, lambda p, start, stop, _: {"exits": exits(read_block(p, start, stop), delimiter)}, "exits array<int>")
    states = entered(maps, (RECORD,), lambda state, b: (int(b.exits[state[0]]),), "state int", tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                start = first_record(b.path, b.start, b.length, b.state, delimiter)
                stop = first_record(b.path, b.stop, b.length, b.next_state, delimiter) if b.stop < b.length else b.length
                if start >= stop:
                    continue
                text = read_block(b.path, start, stop).decode(encoding)
                if start == 0:
                    text = text.removeprefix("\ufeff")
                own = head(b.path, b.length)[1] if with_header else names
                rows = list(_rows(text, delimiter))
                if strip:
                    rows = [[f.strip() for f in r] for r in rows]
                width = len(own)
                rows = [r[:width] + [None] * (width - len(r)) for r in rows]
                columns = dict(zip(own, zip(*rows))) if rows else {}
                yield pd.DataFrame({n: [f or None for f in columns[n]] if n in columns else [None] * len(rows) for n in names}, dtype=object)

    return states.mapInPandas(run, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
