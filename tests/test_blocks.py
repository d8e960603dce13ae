import csv
import io
import os
import random
import struct
from types import SimpleNamespace

import numpy as np
import pytest

from skylattice.sources import binary, blocks, dumps, quoted, text


def rows_of(df):
    return sorted(df.collect(), key=str)


# --- quoted text --------------------------------------------------------------

def state_after(data, state):
    """The five states byte by byte."""
    newline = b"\r\n"
    for c in data:
        if state == quoted.QUOTED:
            state = quoted.CLOSED if c == 34 else quoted.QUOTED
        elif c == 34 and state != quoted.PLAIN:
            state = quoted.QUOTED
        else:
            state = quoted.FIELD if c == 44 else quoted.RECORD if c in newline else quoted.PLAIN
    return state


def test_states_after_a_block():
    rng = random.Random(1)
    for _ in range(20_000):
        data = "".join(rng.choice('"",\n\rab') for _ in range(rng.randrange(14))).encode()
        assert quoted.exits(data) == [state_after(data, s) for s in range(5)]


def messy_csv(rng, records):
    out = []
    for _ in range(records):
        fields = []
        for _ in range(rng.randrange(1, 5)):
            body = "".join(rng.choice(['a', 'é', ',', '\n', '\r\n', '""', ' ', 'xyz']) for _ in range(rng.randrange(8)))
            plain = body.replace(",", "").replace("\n", "").replace("\r", "").lstrip('"')
            fields.append(rng.choice([f'"{body}"', plain, f'"{body}"{plain}', plain + '"q']))
        out.append(",".join(fields) + rng.choice(["\n", "\n", "\r\n", "\n\n"]))
    return "".join(out)


def serial(content, names, encoding="utf-8"):
    rows = [r for r in csv.reader(io.StringIO(content, newline="")) if r]
    return sorted((tuple((r[i] or None) if i < len(r) else None for i in range(len(names))) for r in rows), key=str)


@pytest.mark.parametrize("block_bytes, read_on", [(61, 5), (1 << 20, 1 << 16)])
def test_quoted_text_equals_a_serial_reader(spark, tmp_path, monkeypatch, block_bytes, read_on):
    monkeypatch.setattr(blocks, "READ_ON", read_on)
    rng = random.Random(block_bytes)
    names = ["a", "b", "c"]
    folder = tmp_path / "t"
    folder.mkdir()
    contents = [messy_csv(rng, 25), "", "x,y,z", '"one\n' + "long\n" * 60 + 'field",2\n3,4', '\n\n"open, never closed\n,']
    for i, c in enumerate(contents):
        (folder / f"{i}.csv").write_bytes(c.encode())
    found = rows_of(quoted.read_quoted(spark, str(folder), names, block_bytes=block_bytes))
    assert [tuple(r) for r in found] == sorted((r for c in contents for r in serial(c, names)), key=str)


def test_blocks_of_quoted_text_without_spark(tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "READ_ON", 3)
    rng = random.Random(9)
    path = str(tmp_path / "a.csv")
    for _ in range(150):
        content = messy_csv(rng, rng.randrange(1, 9)) + rng.choice(["", '"open', "x,y", '"closed"'])
        data = content.encode()
        with open(path, "wb") as f:
            f.write(data)
        step, state, found = rng.randrange(1, 30), quoted.RECORD, []
        for at in range(0, len(data), step):
            stop = min(len(data), at + step)
            after = quoted.exits(data[at:stop])[state]
            first = quoted.first_record(path, at, len(data), state, ",")
            last = quoted.first_record(path, stop, len(data), after, ",") if stop < len(data) else len(data)
            found += quoted._rows(data[first:last].decode(), ",") if first < last else []
            state = after
        assert found == [r for r in csv.reader(io.StringIO(content, newline="")) if r]


def test_headers_of_each_file(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "1.csv").write_bytes('preface "\n"a ""x""\n1";b\n1;"2\n3"\n\n4;5;6\n'.encode())
    (folder / "2.csv").write_bytes('preface\nb;other;"a ""x""\n1"\n7;8; 9 \n'.encode())
    (folder / "3.csv").write_bytes(b"preface\n")
    found = text.read_csv(spark, str(folder), delimiter=";", strip=True, top_ignored=1)
    assert found.columns == ['a "x"\n1', "b"]
    assert sorted(map(tuple, found.collect())) == [("1", "2\n3"), ("4", "5"), ("9", "7")]
    with pytest.raises(ValueError):
        quoted.read_quoted(spark, str(folder), ["a"], delimiter="||")


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("".join(f'{i},"line\n{i}"\n' for i in range(20_000)))
    df = quoted.read_quoted(spark, str(path), ["k", "v"], block_bytes=30_000)
    from pyspark.sql import functions as F

    found = df.select(F.spark_partition_id().alias("p"), "k").groupBy("p").count().collect()
    assert len(found) > 4 and sum(r["count"] for r in found) == 20_000 and max(r["count"] for r in found) < 8_000
    assert df.filter("v <> concat('line\n', k)").count() == 0


# --- dumps --------------------------------------------------------------------

def sql_state_after(data, state, before=b"\n"):
    for c in data:
        before += bytes([c])
        if state == dumps.STRING:
            state = dumps.CODE if c == 39 else dumps.ESCAPE if c == 92 else state
        elif state == dumps.ESCAPE:
            state = dumps.STRING
        elif state == dumps.COMMENT:
            state = dumps.CODE if c == 10 else state
        elif c == 39:
            state = dumps.STRING
        elif before.endswith(b"\n--"):
            state = dumps.COMMENT
    return state


def test_dump_states_after_a_block():
    rng = random.Random(2)
    for _ in range(20_000):
        whole = "".join(rng.choice("''\\\n\n--;(a") for _ in range(rng.randrange(16))).encode()
        cut = rng.randrange(len(whole) + 1)
        before = whole[cut - 2:cut] if cut > 2 else b"\n" + whole[:cut]
        state = sql_state_after(whole[:cut], dumps.CODE)
        assert dumps.summary(before, whole[cut:])[state][0] == sql_state_after(whole, dumps.CODE)


def dump_of(rng, rows_wanted):
    """A dump and the rows of its first table."""
    def literal(v):
        if v is None:
            return rng.choice(["NULL", "null"])
        if isinstance(v, int):
            return str(v)
        body = v.replace("\\", "\\\\")
        body = "".join(rng.choice(["''", "\\'"]) if c == "'" else c for c in body)
        return f"'{body}'"

    def value():
        return rng.choice([None, rng.randrange(100), "".join(rng.choice(["a", "'", ";\n", "(", ")", ",", "\\", "\n-- x'", "é", "INSERT INTO `t` VALUES (9)"])
                                                             for _ in range(rng.randrange(6)))])

    parts = ["-- it's a dump; really\n/*!40101 SET NAMES utf8 */;\n",
             "CREATE TABLE `t` (\n  `id` int(11) NOT NULL,\n  `label` varchar(9) DEFAULT 'x;y',\n  `more` text,\n  KEY `k` (`id`)\n) ENGINE=x;\n"]
    rows = []
    while len(rows) < rows_wanted:
        table = rng.choice(["t", "t", "t", "tt"])
        own = [(rng.randrange(1000), value(), value()) for _ in range(rng.randrange(1, 9))]
        if table == "t":
            rows += own
        columns = rng.choice(["", " (`id`, `label`, `more`)"])
        parts.append(rng.choice(["", "-- table `t`; 'open\n", "\n", "LOCK TABLES `t` WRITE;\n"]))
        parts.append(f"INSERT INTO `{table}`{columns} VALUES " + rng.choice([",", ",\n", " , "]).join(
            "(" + ",".join(map(literal, r)) + ")" for r in own) + rng.choice([";\n", ";", " ;\n"]))
        parts.append("\n")
    return "".join(parts), [tuple(None if v is None else str(v) for v in r) for r in rows]


def test_blocks_of_dumps_without_spark(tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "READ_ON", 3)
    path = str(tmp_path / "d.sql")
    for seed in range(150):
        rng = random.Random(seed)
        content, rows = dump_of(rng, rng.randrange(3, 30))
        n = len(content.encode())
        with open(path, "wb") as f:
            f.write(content.encode())
        step, state, found = rng.choice([3, 5, 17, 40, 100, 1000]), (dumps.CODE, 0, 0, -1), []
        for at in range(0, n, step):
            stop = min(n, at + step)
            b = SimpleNamespace(path=path, start=at, stop=stop, length=n, **dumps._summary_of(path, at, stop, n))
            after = dumps._step(state, b)
            b.state, b.statement, b.depth, b.next_state, b.next_statement = *state[:3], *after[:2]
            found += map(tuple, dumps._rows_of_block(b, b"t", "utf-8"))
            state = after
        assert found == rows


@pytest.mark.parametrize("block_bytes, read_on", [(200, 64), (1 << 20, 1 << 16)])
def test_dumps_in_any_blocks(spark, tmp_path, monkeypatch, block_bytes, read_on):
    monkeypatch.setattr(blocks, "READ_ON", read_on)
    rng = random.Random(block_bytes)
    folder = tmp_path / "d"
    folder.mkdir()
    expected = []
    for i in range(3):
        content, rows = dump_of(rng, 40)
        (folder / f"{i}.sql").write_bytes(content.encode())
        expected += rows
    found = text.read_mysql_dump(spark, str(folder)) if block_bytes == 1 << 20 else dumps.read_mysql_dump(spark, str(folder), block_bytes=block_bytes)
    assert found.columns == ["id", "label", "more"]
    assert [tuple(r) for r in rows_of(found)] == sorted(expected, key=str)


def test_torn_dump_is_an_error(spark, tmp_path):
    (tmp_path / "d.sql").write_text("CREATE TABLE `t` (\n `a` int\n);\nINSERT INTO `t` VALUES (1),(2),('open);\n")
    with pytest.raises(Exception, match="not read to its end"):
        dumps.read_mysql_dump(spark, str(tmp_path / "d.sql")).collect()
    (tmp_path / "e.sql").write_text("SELECT 1;\n")
    with pytest.raises(ValueError, match="no CREATE TABLE"):
        dumps.read_mysql_dump(spark, str(tmp_path / "e.sql"))


# --- armoured records ---------------------------------------------------------

def armoured(payloads, order="<"):
    return b"".join(struct.pack(order + "I", len(p)) + p + struct.pack(order + "I", len(p)) for p in payloads)


@pytest.mark.parametrize("block_bytes, entry", [(70, 24), (5000, 4096)])
@pytest.mark.parametrize("order, name", [("<", "little"), (">", "big")])
def test_record_chains_equal_the_serial_walk(spark, tmp_path, monkeypatch, block_bytes, entry, order, name):
    monkeypatch.setattr(binary, "ENTRY_BYTES", entry)
    rng = random.Random(block_bytes)
    folder = tmp_path / "f"
    folder.mkdir()
    expected = []
    for i in range(2):
        # payloads full of what look like markers, records of very different lengths
        payloads = []
        for _ in range(25 if block_bytes < 100 else 150):
            key = rng.choice([8, 12, 16, rng.randrange(1 << 31)])
            more = rng.choice([b"", struct.pack(order + "I", 8) * rng.randrange(9), rng.randbytes(rng.choice([3, 40, 700]))])
            payloads.append(struct.pack(order + "q", key) + more)
            expected.append((key,))
        (folder / f"{i}.bin").write_bytes(b"HEAD" + armoured(payloads, order))
    (folder / "2.bin").write_bytes(b"HEAD")
    found = binary.read_fortran_records(spark, str(folder), "v(q)", name, skip_bytes=4, block_bytes=block_bytes)
    assert [tuple(r) for r in rows_of(found)] == sorted(expected, key=str)


def test_jumps_lead_where_a_reader_gets_to():
    rng = np.random.default_rng(1)
    payloads = [rng.bytes(int(rng.integers(4, 60))) for _ in range(300)]
    data = armoured(payloads)
    starts = np.cumsum([0] + [len(p) + 8 for p in payloads])
    block = 4000
    place, to = binary.record_jumps(data[:block + 2000], 4, block, "little")
    jumps = dict(zip(place.tolist(), to.tolist()))
    behind = int(starts[starts >= block][0])
    for s in starts[starts < block].tolist():
        assert jumps[s] == behind


def test_broken_markers_name_their_place(spark, tmp_path):
    payloads = [struct.pack("<q", i) for i in range(1000)]
    data = bytearray(armoured(payloads))
    data[16 * 700 + 12] ^= 1
    (tmp_path / "b.bin").write_bytes(data)
    with pytest.raises(Exception, match=f"record at {16 * 700} has unequal length markers"):
        binary.read_fortran_records(spark, str(tmp_path / "b.bin"), "v(q)", block_bytes=1000).collect()
    (tmp_path / "c.bin").write_bytes(armoured(payloads)[:-5])
    with pytest.raises(Exception, match=f"record at {16 * 999} has unequal length markers"):
        binary.read_fortran_records(spark, str(tmp_path / "c.bin"), "v(q)", block_bytes=1000).collect()
    assert os.path.getsize(tmp_path / "c.bin") == 16 * 1000 - 5
