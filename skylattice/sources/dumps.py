"""Rows of SQL dumps, read by many tasks a file, whatever the length of lines, strings and statements.

A byte of a dump is code, part of a string (with or without a backslash before it) or part of a comment, which depends
on all before it; see ``blocks``.  Besides that state a block is entered with the place where the current statement began
and the number of open brackets, so that it knows whether it begins among the rows of an INSERT and inside a row.  Names in backticks are
taken to hold no quotes, brackets or semicolons.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, entered, file_blocks, later_bytes, read_block, summarised
from .ranges import file_sizes

CODE, STRING, ESCAPE, COMMENT = range(4)
_BACK = 2  #: bytes before a block that can belong to the mark of a comment
_AHEAD = 64  #: bytes behind a block that can belong to the words CREATE TABLE
HEAD_BYTES = 64 << 10  #: the longest beginning of an INSERT up to its rows, comments before it aside
CREATE_BYTES = 1 << 20  #: the longest CREATE TABLE

_STRING = rb"'(?:[^'\\]++|\\.)*+'"
_COMMENT = rb"(?<=\n)--[^\n]*+"
_TOKEN = re.compile(rb"(?s)" + _STRING + rb"|" + _COMMENT)
_OPEN = re.compile(rb"(?s)'(?:[^'\\]++|\\.)*+(\\?)\Z")
_REST_OF_STRING = re.compile(rb"(?s)(?:[^'\\]++|\\.)*+")
_CREATE = re.compile(rb"(?is)\bCREATE\s+TABLE\b")


def _enter(data: bytes, state: int) -> tuple[int, int]:
    """Where code begins in data entered in a state, or -1 and the state the data ends in."""
    at = 0
    if state == CODE:
        return 0, CODE
    if state == COMMENT:
        at = data.find(b"\n")
        return (at, CODE) if at >= 0 else (-1, COMMENT)
    if state == ESCAPE:
        if not data:
            return -1, ESCAPE
        at = 1
    at = _REST_OF_STRING.match(data, at).end()
    if at == len(data):
        return -1, STRING
    return (at + 1, CODE) if data[at:at + 1] == b"'" else (-1, ESCAPE)  # a backslash is the last byte


def _blanked(code: bytes) -> tuple[bytes, int]:
    """Code of the same length with strings and comments blanked out, and the state it ends in."""
    last = [b"", 0]

    def blank(m: re.Match) -> bytes:
        last[:] = m[0][:2], m.end()
        return b" " * (m.end() - m.start())

    plain = _TOKEN.sub(blank, code)
    quote = plain.find(b"'")  # of a string that does not end here
    if quote >= 0:
        tail = _OPEN.match(code, quote)
        return plain[:quote] + b" " * (len(code) - quote), ESCAPE if tail[1] else STRING
    return plain, COMMENT if last == [b"--", len(code)] else CODE


def summary(before: bytes, data: bytes, behind: bytes = b"") -> list[tuple[int, int, int, int]]:
    """For each state before the data: the state after it, the place after its last ``;`` (-1: none), open brackets since
    then or in all, the place of the first CREATE TABLE (-1: none).  ``before`` holds the bytes before, a newline at
    the beginning of a file, ``behind`` some bytes behind."""
    before = re.sub(rb"[^\n-]", b" ", before)  # only the mark of a comment can reach across
    out, known = [], {}
    for state in range(4):
        at, after = _enter(data, state)
        if at < 0:
            out.append((after, -1, 0, -1))
            continue
        if (at, state == CODE) not in known:
            lead = before if state == CODE else b""
            plain, after = _blanked(lead + data[at:])
            plain = plain[len(lead):]
            last = plain.rfind(b";")
            rest = plain[last + 1:]
            create = _CREATE.search(plain + behind if after == CODE else plain)
            create = create if create and create.start() < len(plain) else None
            known[at, state == CODE] = (after, at + last + 1 if last >= 0 else -1, rest.count(b"(") - rest.count(b")"),
                                        at + create.start() if create else -1)
        out.append(known[at, state == CODE])
    return out


def _summary_of(path: str, start: int, stop: int, length: int) -> dict:
    back = min(start, _BACK)
    data = read_block(path, start - back, min(length, stop + _AHEAD))
    end = stop - start + back
    found = summary(data[:back] if start > _BACK else b"\n" + data[:back], data[back:end], data[end:])
    absolute = lambda x: x + start if x >= 0 else -1
    return {"after": [f[0] for f in found], "ends": [absolute(f[1]) for f in found], "open": [f[2] for f in found],
            "creates": [absolute(f[3]) for f in found]}


def _step(state: tuple, b) -> tuple:
    kind, statement, depth = state[:3]
    end, create = int(b.ends[kind]), int(b.creates[kind])
    return (int(b.after[kind]), end if end >= 0 else statement, int(b.open[kind]) + (0 if end >= 0 else depth), create)


_LEAD = rb"(?:\s++|--[^\n]*+(?:\n|\Z)|/\*.*?\*/;?)*+"
_BEFORE_HEAD = re.compile(rb"(?s)" + _LEAD)
_HEAD = rb"(?is)" + _LEAD + rb"INSERT\s+(?:IGNORE\s+)?INTO\s+`?%s`?\s*(?:\((?:[^()`]++|`[^`]*+`)*+\)\s*)?VALUES\s*"
_VALUE = rb"'(?:[^'\\]++|\\.)*+'|[^,()']++"
_ROW = re.compile(rb"(?s)[\s,]*+(\((?:" + _VALUE + rb"|,)*+\))")
_FIELD = re.compile(rb"(?s)(?:'(?:[^'\\]++|\\.)*+'|[^,()'])++")
_END = re.compile(rb"\s*+;")
_REST_OF_STATEMENT = re.compile(rb"(?s)(?:" + _STRING + rb"|" + _COMMENT + rb"|[^';\-]++|-)*+;")
_STATEMENT = re.compile(rb"(?s)" + _LEAD + _REST_OF_STATEMENT.pattern[4:])
_REST_OF_ROW = re.compile(rb"(?s)(?:" + _VALUE + rb"|,)*+\)")
_ESCAPED = re.compile(r"(?s)\\(.)|''")


def _plain(value: bytes, encoding: str) -> str | None:
    text = value.decode(encoding).strip()
    if text.startswith("'"):
        return _ESCAPED.sub(lambda m: m[1] or "'", text[1:-1])
    return None if text.upper() == "NULL" else text


class _Window:
    """The bytes of a file around a block, read on beyond it as far as they are asked for; places are those in the file."""

    def __init__(self, path: str, start: int, stop: int, length: int):
        self.start = max(0, start - _BACK)
        self.data = read_block(path, self.start, stop)
        self.later = later_bytes(path, stop, length)

    def more(self) -> bool:
        piece = next(self.later, b"")
        self.data += piece
        return bool(piece)

    def end_of(self, pattern: re.Pattern, at: int) -> int | None:
        """Where a pattern ends that begins at a place and in what has been read."""
        found = pattern.match(self.data, at - self.start)
        return found and self.start + found.end()

    def match(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """The match at a place, reading on while there is none and the file goes on."""
        while True:
            found = pattern.match(self.data, at - self.start)
            if found or not self.more():
                return found

    def head(self, pattern: re.Pattern, at: int) -> int | None:
        """Where the rows of a statement begin that may be an INSERT."""
        while len(self.data) < _BEFORE_HEAD.match(self.data, at - self.start).end() + HEAD_BYTES and self.more():
            pass
        return self.end_of(pattern, at)


def _rows_of_block(b, table: bytes, encoding: str) -> Iterator[list[str | None]]:
    """Rows of INSERTs into the table that begin in a block."""
    head = re.compile(_HEAD % re.escape(table))
    window = _Window(b.path, b.start, b.stop, b.length)
    at, rows_at = b.start, None
    if b.statement < b.start:  # the block begins in a statement
        rows_at = _Window(b.path, b.statement, min(b.length, b.statement + HEAD_BYTES), b.length).head(head, b.statement)
        if rows_at is None and b.next_statement == b.statement:
            return  # another statement, which does not end here
        if rows_at is None or rows_at <= b.start:
            code, _ = _enter(window.data[b.start - window.start:], b.state)
            if code < 0:
                return
            at += code
            if rows_at is None or b.depth > 0:
                at = window.end_of(_REST_OF_STATEMENT if rows_at is None else _REST_OF_ROW, at)
                if at is None:
                    return  # the row or statement does not end here, so nothing else begins here
        else:
            at = rows_at
    while at < b.stop:
        if rows_at is None:
            rows_at = window.head(head, at)
            if rows_at is None:
                if b.next_statement <= at:
                    return  # the last statement of the block
                at = window.end_of(_STATEMENT, at)
                if at is None:
                    return
                continue
            at = rows_at
        row = window.match(_ROW, at)
        if row:
            if window.start + row.start(1) >= b.stop:
                return
            yield [_plain(f, encoding) for f in _FIELD.findall(row[1][1:-1])]
            at = window.start + row.end()
            continue
        end = window.match(_END, at)
        if end is None and window.data[at - window.start:].strip():
            raise ValueError(f"{b.path}: statement not read to its end near byte {at}")
        if end is None:
            return
        at, rows_at = window.start + end.end(), None


def read_mysql_dump(spark: SparkSession, path, pattern: str | None = None, encoding: str = "utf-8", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of a dump's INSERT statements into the table of its first CREATE TABLE, as strings, with the names given there.

    Statements that cannot be read to their end are errors.
    """
    files = file_sizes(spark, path, pattern).withColumn("begin", F.lit(0).cast("bigint"))
    blocks, tasks = file_blocks(files, block_bytes)
    maps = summarised(blocks, _summary_of, "after array<int>, ends array<bigint>, open array<bigint>, creates array<bigint>")
    states = entered(maps, (CODE, 0, 0, -1), _step, "state int, statement bigint, depth bigint, create_at bigint", tasks)
    create = states.filter("next_create_at >= 0").orderBy("path", "next_create_at").select("path", F.col("next_create_at").alias("at"), "length").first()
    if create is None:
        raise ValueError(f"no CREATE TABLE in {path}")

    def beginning(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [read_block(r.path, r.at, min(r.length, r.at + CREATE_BYTES)) for r in frame.itertuples()]
            ends = [_blanked(t)[0].find(b";") for t in texts]
            yield pd.DataFrame({"text": [t[:end if end >= 0 else None].decode(encoding, "replace") for t, end in zip(texts, ends)]})

    text = spark.createDataFrame([tuple(create)], "path string, at bigint, length bigint").mapInPandas(beginning, "text string").first()["text"]
    found = re.match(r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?`?([^`\s(]+)`?\s*\(", text)
    names = re.findall(r"^\s*`([^`]+)`\s", text[found.end():], re.M)
    table, width = found[1].encode(encoding), len(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                rows = [r[:width] + [None] * (width - len(r)) for r in _rows_of_block(b, table, encoding)]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return states.mapInPandas(run, ", ".join(f"`{n}` string" for n in names))
