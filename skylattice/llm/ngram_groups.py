"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct shingles of five words as 64-bit hashes.  Equal sets form one class.  Classes that are
likely to be similar (size band and smallest shingle) are put into groups; the matrix tells for each token which groups
have it.  Tokens are ordered from rare to frequent, and two sets of similarity t share k of the first
n - ceil(t n) + k tokens of either: only such tokens are kept in the matrix.  A class asks for the groups that k of its own
first tokens occur in.  Groups found so are bounded by the overlap of the class with the union of the group's tokens and opened
only if that can reach t; in an opened group the exact sets are compared.

What counts is connectivity, so pairs that are connected already are not compared again: a large group of copies costs
one comparison a member.  Token order comes from counts over all documents: each task reports tokens it meets several
times, the sums are hashed into a table of fixed size, and any order, exact or not, gives the same links.

Defined results: null and empty texts have no shingle and link with nothing; rows without doc_id get n_shingles and no
component; repeated rows belong to one class; different texts of one doc_id are documents of their own; very long texts are
single sets; equal similarity to several groups connects all of them; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, row_key, settled
from .components import components

WORDS = 5
LIKE, OF = 75, 100  #: linked when OF * intersection >= LIKE * union
STEP = 32  #: a set of n tokens must share 1 + n // STEP early ones
CELL_BITS = 20  #: size of the table of token frequencies
WINDOW = 1 << 20  #: tokens a task looks at together when it reports frequent ones
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """word -> 64-bit hash, forgotten when it has grown large"""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None, known: _Words) -> np.ndarray:
    """The distinct shingles of a text, ascending; fewer words than five make one shingle, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(len(ids), WORDS)
    mixed = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ ids[k:len(ids) - n + 1 + k]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    known = _Words()
    for whole in batches:
        for at in range(0, whole.num_rows, 500):  # bounds what a task holds
            batch = whole.slice(at, 500)
            yield batch, [shingles(x.as_py(), known) for x in batch.column("text").cast(pa.binary())]


def _class_columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size, two digests and group of each set."""
    n = np.array([len(s) for s in sets], np.int64)
    d1 = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
    d2 = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
    least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(OF / LIKE)).astype(np.uint64)
    group = ((least ^ (band * _MIX)) * _MIX >> np.uint64(33)).astype(np.int64).astype(np.int32)
    return n, d1, d2, group


_SIGNED = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("g", pa.int32()),
                     ("token", pa.int64()), ("times", pa.int64())])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows (token, times) of the tokens that a task meets in several sets of a window."""
    window: dict[int, np.ndarray] = {}
    held = 0

    def frequent() -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(list(window.values()) or [np.empty(0, np.uint64)]), return_counts=True)
        tokens, times = tokens[times > 2], times[times > 2]
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, none, none, pa.nulls(len(tokens), pa.int32()),
                                           pa.array(tokens.view(np.int64)), pa.array(times)], schema=_SIGNED)

    for batch, sets in _texts(batches):
        n, d1, d2, group = _class_columns(sets)
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), *map(pa.array, (n, d1, d2, group)), none, none],
                                         schema=_SIGNED)
        for key, s in zip(d1.tolist(), sets):
            if key not in window and len(s):
                window[key] = s
                held += len(s)
        if held > WINDOW:
            yield frequent()
            window, held = {}, 0
    yield frequent()


def _first_tokens(tokens: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest tokens of a set, and how many of them are enough for larger sets.

    Of two sets with c common tokens, the first k common ones are among the first n - c + k of either.  A set shares at
    least t n with any similar one, and a smaller set 2 t / (1 + t) n with a larger; k is 1 + n // STEP of the larger.
    """
    n = len(tokens)
    order = np.argsort(cells[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
    probe = n - -(-LIKE * n // OF) + 1 + n // STEP
    index = n - -(-2 * LIKE * n // (LIKE + OF)) + 1 + OF * n // (LIKE * STEP)
    return tokens[order[:max(probe, index)]], index


#: n is negative for the tokens that are enough for larger sets
_POSTED = pa.schema([("token", pa.int64()), ("cid", pa.int64()), ("g", pa.int32()), ("n", pa.int32())])


def _postings(cells) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _texts(batches):
            sets = [s for s in sets if len(s)]
            n, d1, _, group = _class_columns(sets)
            firsts = [_first_tokens(s, cells.value) for s in sets]
            sizes = np.array([len(f) for f, _ in firsts], np.int64)
            if not len(sizes):
                continue
            early = np.concatenate([np.arange(len(f)) < k for f, k in firsts])
            tokens = np.concatenate([f for f, _ in firsts]).view(np.int64)
            size = np.repeat(n, sizes).astype(np.int32)
            columns = [tokens, np.repeat(d1, sizes), np.repeat(group, sizes), np.where(early, -size, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_POSTED)
    return run


_SETS = pa.schema([("cid", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the rows whose text has the class that the row names (a repeated doc_id may have several)."""
    for batch, sets in _texts(batches):
        _, d1, _, _ = _class_columns(sets)
        same = d1 == batch.column("cid").to_numpy(zero_copy_only=False)
        kept = [s.view(np.int64) for s, k in zip(sets, same) if k]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
        values = np.concatenate(kept) if kept else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(d1[same]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                                         schema=_SETS)


def _cells(counts: DataFrame):
    """The table of frequencies: for each cell of the token space the magnitude of its most frequent reported token."""
    table = np.zeros(1 << CELL_BITS, np.uint8)
    found = counts.groupBy("token").agg(F.sum("times").alias("times")).groupBy(
        F.shiftrightunsigned("token", 64 - CELL_BITS).alias("cell")).agg(F.max(F.floor(F.log2("times"))).alias("size"))
    found = found.toPandas()  # at most one row a cell
    table[found["cell"].to_numpy(np.int64)] = found["size"].to_numpy(np.uint8)
    return counts.sparkSession.sparkContext.broadcast(table)


def candidates(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Distinct (q, gq, g): the set q may have a similar one in the group g."""
    cells = _cells(signed.filter("token IS NOT NULL").select("token", "times"))
    # both sides of the join read all columns of one exchange, so that Spark runs it once
    posted = docs.select("text").mapInArrow(_postings(cells), "token long, cid long, g int, n int").repartition("token")
    early = F.col("n") < 0
    matrix = posted.groupBy("token", "g").agg(
        F.min(F.when(early, -F.col("n"))).alias("n_low"), F.max(F.when(early, -F.col("n"))).alias("n_high"),
        F.min(F.when(early, F.col("cid"))).alias("low"), F.max(F.when(early, F.col("cid"))).alias("high"))
    q = posted.select("token", F.col("cid").alias("q"), F.col("g").alias("gq"), F.coalesce(F.abs("n"), F.lit(0)).alias("n"))
    met = q.join(matrix, "token").filter(
        (F.col("n_low") <= F.col("n")) & (OF * F.col("n_high").cast("long") >= LIKE * F.col("n"))
        & ~((F.col("g") == F.col("gq")) & (F.col("low") == F.col("high")) & (F.col("low") == F.col("q"))))
    shared = met.groupBy("q", "gq", "g", "n").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(F.col("shared") > F.floor(F.col("n") / STEP)).select("q", "gq", "g")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar."""
    # sides that grow with the input are merged at every size, so that small and large inputs have one plan
    both = pairs.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")).hint("merge"), "b").join(
        sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")).hint("merge"), "a")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.filter(OF * common >= LIKE * (F.size("ta") + F.size("tb") - common)).select("a", "b")


CHUNK = 512  #: members, and queries, of a group that one task compares at a time


def _open(key: tuple, asked: pa.Table, members: pa.Table) -> pa.Table:
    """Links between queries (cid, comp, tokens) and a chunk of a group's members, one at least for each two components
    that have one."""
    def unpacked(t: pa.Table) -> tuple[list[int], list[int], list[np.ndarray]]:
        rows = {c: (k, v) for c, k, v in zip(t["cid"].to_pylist(), t["comp"].to_pylist(), t["tokens"])}
        return (list(rows), [k for k, _ in rows.values()],
                [np.sort(v.values.to_numpy().view(np.uint64)) for _, v in rows.values()])

    cids, comps, sets = unpacked(members)
    found: list[tuple[int, int]] = []
    if cids and asked.num_rows:
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        owner = owner[order]
        union, start = np.unique(tokens[order], return_index=True)
        ends = np.append(start[1:], len(tokens))
        sizes = np.array([len(s) for s in sets])
        comps = np.array(comps)
        joined: set[tuple[int, int]] = set()
        for cid, comp, s in zip(*unpacked(asked)):
            at = np.searchsorted(union, s)
            at[at == len(union)] = 0
            at = at[union[at] == s]
            if OF * len(at) < LIKE * len(s):  # the union of the group's tokens cannot give enough
                continue
            common = np.bincount(np.concatenate([owner[a:b] for a, b in zip(start[at], ends[at])]), minlength=len(sets))
            like = (OF * common >= LIKE * (len(s) + sizes - common)) & (comps != comp)
            for k in np.flatnonzero(like):
                if (comp, comps[k]) not in joined:
                    joined.add((comp, comps[k]))
                    found.append((cid, cids[k]))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _opened(asks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links found by opening groups: asks (q, comp, g) against members (g, cid, comp), each dealt out in chunks."""
    def chunks(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy("g").agg((F.ceil(F.count(F.lit(1)) / CHUNK)).cast("int").alias(key))

    counts = chunks(asks, "nq").join(chunks(members, "nm"), "g")
    spread = {"mine": F.pmod(F.xxhash64("cid"), "n_own").cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("n_other") - 1))}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(counts, "g").withColumns({"n_own": F.col(own), "n_other": F.col(other)})
        df = df.withColumn("mine", spread["mine"]).withColumn("other", spread["other"])
        kq, km = ("mine", "other") if own == "nq" else ("other", "mine")
        df = df.select("g", F.col(kq).alias("kq"), F.col(km).alias("km"), "cid", "comp").join(sets.hint("merge"), "cid")
        return df.select(*(F.col(c).alias(c) for c in df.columns))  # columns of its own on either side

    left = dealt(asks.withColumnRenamed("q", "cid"), "nq", "nm")
    right = dealt(members, "nm", "nq")
    return left.groupBy("g", "kq", "km").cogroup(right.groupBy("g", "kq", "km")).applyInArrow(_open, "a long, b long")


def class_links(docs: DataFrame, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that connect whatever similarity connects."""
    asked = settled(candidates(docs, signed), "candidates")
    release(docs.sparkSession)
    groups = asked.select("g").distinct()
    involved = classes.join(groups, "g", "left_semi").select("cid", "g", "doc_id").union(
        classes.join(asked.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi").select("cid", "g", "doc_id")).distinct()
    involved = settled(involved, "involved")
    sets = settled(docs.select("doc_id", "text").join(
        involved.select("doc_id", "cid").hint("merge"), "doc_id").select("cid", "text").mapInArrow(
        _sets, "cid long, tokens array<long>"), "sets")
    release(docs.sparkSession)
    leaders = involved.groupBy("g").agg(F.min("cid").alias("leader"))
    members = involved.join(leaders, "g")
    stars = members.filter("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b"))
    # any number of near copies asks one group from one other: the two leaders are a pair once
    across = asked.filter("g <> gq").select("g", "gq").distinct().join(leaders.withColumnRenamed("leader", "b"), "g").join(
        leaders.select(F.col("g").alias("gq"), F.col("leader").alias("a")), "gq").select(F.least("a", "b"), F.greatest("a", "b"))
    near = settled(_linked(stars.union(across).distinct(), sets), "near")
    known = components(near)

    def with_component(df: DataFrame, cid: str) -> DataFrame:
        return df.join(known.withColumnRenamed("node", cid), cid, "left").withColumn("comp", F.coalesce("component", cid)).drop("component")

    members = settled(with_component(involved.select("cid", "g"), "cid"), "members")
    parts = members.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_for = with_component(asked.select("q", "g"), "q").join(parts, "g").filter("low <> comp OR high <> comp")
    rest = settled(_opened(settled(open_for.select("q", "comp", "g"), "asks"), members, sets), "opened")
    return near.union(rest)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the row's key), n and component_id of every row."""
    k1, k2 = row_key("doc_id", "text")
    signed = settled(docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2")).mapInArrow(
        _signatures, "doc_id long, k1 long, k2 long, n long, d1 long, d2 long, g int, token long, times long"), "signatures")
    rows = signed.filter("n IS NOT NULL")
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy(F.col("d1").alias("cid")).agg(
        F.min("doc_id").alias("doc_id"), F.min("g").alias("g"),
        F.assert_true(F.min("d2") == F.max("d2"), "two sets share a digest").alias("ok"))
    classes = settled(classes.filter("ok IS NULL").select("cid", "doc_id", "g"), "classes")
    links = class_links(docs.filter("doc_id IS NOT NULL"), signed, classes)
    found = classes.join(components(links).withColumnRenamed("node", "cid"), "cid", "left").select(
        "cid", "doc_id", F.coalesce("component", "cid").alias("comp"))
    smallest = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_class = settled(found.join(smallest, "comp").select("cid", "component_id"), "components")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    return rows.join(of_class, rows["d1"] == of_class["cid"], "left").select(
        "doc_id", "k1", "k2", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "component_id")).alias("component_id"))


def near_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    return _rows(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near documents: of the smallest doc_id; repeated rows (doc_id and text) count once.

    Rows without doc_id and rows without words stay.
    """
    names = _free_names(docs, 2)
    words = settled(_rows(docs).filter("n > 0 AND doc_id IS NOT NULL").select("k1", "k2", "doc_id", "component_id"), "rows")
    # two texts of the smallest doc_id: the one with the smaller key stays
    first = words.groupBy("component_id").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("first")).select("first.k1", "first.k2")
    gone = words.select("k1", "k2").distinct().join(first, ["k1", "k2"], "left_anti").toDF(*names)
    keyed = docs.withColumns(dict(zip(names, row_key("doc_id", "text"))))
    rest = keyed.join(gone, names, "left_anti")
    again = settled(words.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2").toDF(*names), "repeated")
    once = rest.join(again, names, "left_semi").dropDuplicates(names)
    return rest.join(again, names, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def _free_names(df: DataFrame, n: int) -> list[str]:
    """Column names that the table does not have."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"row_key_{k}" for k in range(n + len(taken))) if c not in taken][:n]
