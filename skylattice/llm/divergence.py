"""Source divergence audit by quadtrees over the matrix of groups and terms.

A group is a source of a language; the matrix of a language has its groups as rows, its kept terms (those in enough of its
documents) as columns, and counts as cells.  Tasks count terms text by text and report sums per group.  The matrix is cut
into tiles of bounded size; a tile is held as a quadtree whose bit of a quadrant tells whether any count in it is above
zero.  Two groups are compared by going down both rows' quadrants together: where both are all zero every column has
the same price, so they are priced by one product outside the tree; where either holds a count the walk goes on,
for all pairs of groups of a tile at once, to the cells.  The language's own counts stand as one more row of each tile.

All arithmetic is exact in 64-bit integers: probabilities are parts of 10^9, and an overflow of a sum is an error.

Defined results: null text, lang and source are ''; rows are documents, so repeated rows count each; a group without terms
and a language without kept terms give pairs (of value 0 where no term is kept) and no terms; empty tables give no row;
very long texts are counted in pieces cut between words; equal values rank by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
COLUMNS, ROWS = 1024, 64  #: about so many terms and groups a tile
PIECE = 4 << 20  #: bytes of a text that are split at a time
HELD = 400_000  #: terms a task holds before it reports them

#: A-Z become a-z, letters and bytes of other characters stay, the rest separates
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("times", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, times, docs) of what a task has met; a row without term for each group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def report() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms = [None, *times]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *times.values()], pa.int64()),
                pa.array([0, *map(docs.__getitem__, times)], pa.int64())], schema=_COUNTED)
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for words in _pieces(text.as_py()):
                times.update(words)
                own.update(words)
            docs.update(own)
        if sum(len(times) for times, _ in held.values()) > HELD:
            yield from report()
    yield from report()


def shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / size), by division in two steps that stay within 64 bits."""
    first = 32_000 * (counts + 1)
    whole, rest = first // sizes, first % sizes
    return 1 + whole * 31_250 + rest * 31_250 // sizes  # 32,000 * 31,250 = SCALE


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class QuadTree:
    """A matrix of counts as a tree of quadrants: four bits a node, set where a quadrant holds a count."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.depth = max(1, int(max(shape) - 1).bit_length())
        codes = np.zeros(len(rows), np.int64)  # interleaved bits: the row's above the column's
        for bit in range(self.depth):
            codes |= ((rows >> bit & 1) << (2 * bit + 1)) | ((columns >> bit & 1) << (2 * bit))
        order = np.argsort(codes)
        codes, self.counts = codes[order], np.append(counts[order], 0)  # the last stands for an empty leaf
        self.bits: list[np.ndarray] = []  # from the root down
        self.ranks: list[np.ndarray] = []
        for level in range(self.depth - 1, -1, -1):
            nodes = np.unique(codes >> 2 * level)
            parents = np.unique(nodes >> 2)
            bits = np.zeros(4 * len(parents), bool)
            bits[4 * np.searchsorted(parents, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            self.ranks.append(np.cumsum(bits) - 1)

    def child(self, level: int, node: np.ndarray, half_row, half_column) -> np.ndarray:
        """The nodes' children in a quadrant, -1 where all of it is zero."""
        at = np.maximum(4 * node + 2 * half_row + half_column, 0)
        return np.where((node >= 0) & self.bits[level][at], self.ranks[level][at], -1)

    def walk(self) -> tuple[np.ndarray, ...]:
        """(row a, row b, column, leaf of a, leaf of b) for rows a < b and all columns where either has a count."""
        if not len(self.counts) - 1:
            return tuple(np.empty(0, np.int64) for _ in range(5))
        a = b = column = np.zeros(1, np.int64)
        left = right = np.zeros(1, np.int64)
        for level in range(self.depth):
            below = self.depth - 1 - level
            found = []
            for half_a in (0, 1):
                for half_b in (0, 1):
                    for half in (0, 1):
                        x, y = 2 * a + half_a, 2 * b + half_b
                        down, up = self.child(level, left, half_a, half), self.child(level, right, half_b, half)
                        on = ((down >= 0) | (up >= 0)) & (x <= y) & ((y << below) < self.shape[0])
                        found.append([z[on] for z in (x, y, 2 * column + half, down, up)])
            a, b, column, left, right = (np.concatenate(z) for z in zip(*found))
        apart = a < b
        return a[apart], b[apart], column[apart], left[apart], right[apart]


_PRICED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()),
                     ("value", pa.int64()), ("columns", pa.int64())])


def _tile(key: tuple, cells: pa.Table) -> pa.Table:
    """Prices of one tile: sums and numbers of walked columns of ordered pairs of groups, and each group's best terms."""
    lang, _, block_a, block_b = (k.as_py() for k in key)
    whole = block_a == block_b  # a tile of two blocks of groups gives the pairs across only
    names, rows = np.unique(np.array(cells["source"].to_pylist(), object), return_inverse=True)  # those without a count here too
    field = {k: cells[k].to_numpy() for k in ("times", "total", "n", "v", "n_lang", "block")}
    sizes, blocks = np.zeros(len(names) + 1, np.int64), np.zeros(len(names) + 1, np.int64)
    sizes[rows + 1], blocks[rows + 1] = field["n"] + field["v"], field["block"]
    sizes[0], blocks[0] = field["n_lang"][0] + field["v"][0], -1  # row 0 is the language
    counted = cells["term"].is_valid().to_numpy()
    rows, field = rows[counted], {k: x[counted] for k, x in field.items()}
    terms, columns = np.unique(np.array(cells["term"].drop_null().to_pylist(), object), return_inverse=True)
    of_column = np.zeros(len(terms), np.int64)
    of_column[columns] = field["total"]
    frequent = np.lexsort((np.arange(len(terms)), -of_column))  # full columns side by side, so that quadrants are full or empty
    place = np.empty_like(frequent)
    place[frequent] = np.arange(len(terms))
    terms, of_column, columns = terms[frequent], of_column[frequent], place[columns]
    every = np.arange(len(terms))
    tree = QuadTree(np.concatenate([np.zeros(len(terms), np.int64), rows + 1]), np.concatenate([every, columns]),
                    np.concatenate([of_column, field["times"]]), (len(names) + 1, len(terms)))
    a, b, column, left, right = tree.walk()
    p, q = shares(tree.counts[left], sizes[a]), shares(tree.counts[right], sizes[b])
    out = []

    def add(part: str, source: np.ndarray, item: np.ndarray, value: np.ndarray, walked: np.ndarray) -> None:
        out.append(pa.table([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()),
                             pa.array([part] * len(source), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64()),
                             pa.array(walked, pa.int64())], schema=_PRICED))

    pair = (a > 0) & ((blocks[a] != blocks[b]) | whole)
    pairs, at, walked = np.unique(a[pair] * len(sizes) + b[pair], return_inverse=True, return_counts=True)
    for x, y, price in ((pairs // len(sizes), pairs % len(sizes), prices(p[pair], q[pair])),
                        (pairs % len(sizes), pairs // len(sizes), prices(q[pair], p[pair]))):
        value = np.zeros(len(pairs), np.int64)
        np.add.at(value, at, price)
        add("pair", names[x - 1], names[y - 1], value, walked)
    if whole:
        own = (a == 0) & (right >= 0) & (q > p)  # here p is the language's share and q the group's
        group, term, value = b[own], column[own], prices(q[own], p[own])
        by_name = np.argsort(np.argsort(terms, kind="stable"), kind="stable")
        order = np.lexsort((by_name[term], -value, group))
        group, term, value = group[order], term[order], value[order]
        first = np.searchsorted(group, group)  # where the group's rows begin
        best = np.arange(len(group)) - first < TOP_TERMS
        add("term", names[group[best] - 1], terms[term[best]], value[best], np.ones(int(best.sum()), np.int64))
    return pa.concat_tables(out)


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` tells how far the group's shares of terms are from those of
    each other source of its language, part ``term`` which terms stand out against the language.

    Tiles have about ``columns`` terms and ``rows`` groups a side.
    """
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*text).mapInArrow(_counted, "lang string, source string, term string, times long, docs long")
    cells = settled(counted.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")), "cells")
    groups = cells.filter("term IS NULL").select("lang", "source")
    cells = cells.filter("term IS NOT NULL")
    kept = cells.groupBy("lang", "term").agg(F.sum("times").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    cells = settled(cells.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "kept")
    languages = cells.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    sizes = groups.join(cells.groupBy("lang", "source").agg(F.sum("times").alias("n")), ["lang", "source"], "left").join(
        languages, "lang", "left").join(groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / rows).alias("blocks")), "lang")
    sizes = settled(sizes.fillna(0, ["n", "v", "n_lang"]), "groups")
    strips = F.ceil(F.col("v") / columns)
    # a group stands in every strip, as its zeros have another price where another group's counts are
    groups_of = sizes.filter("v > 0").withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), strips - 1))).selectExpr(
        "*", "CAST(NULL AS STRING) AS term", "0L AS times", "0L AS total")
    counts = cells.join(sizes, ["lang", "source"]).withColumn("strip", F.pmod(F.xxhash64("term"), strips))
    dealt = counts.unionByName(groups_of).withColumns({
        "block": F.pmod(F.xxhash64("source"), "blocks"), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    tiles = dealt.groupBy("lang", "strip", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    priced = settled(tiles.applyInArrow(_tile, "lang string, source string, part string, item string, value long, columns long"), "priced")
    walked = priced.filter("part = 'pair'").groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"), F.sum("columns").alias("columns"))
    empty = F.expr(f"if(n + v = 0, 1, 1 + {SCALE} div (n + v))")  # the share of a term that the group has not
    one = sizes.select("lang", "source", "v", empty.alias("p"))
    other = sizes.select("lang", F.col("source").alias("item"), empty.alias("q"))
    pairs = one.join(other, "lang").filter("source <> item").join(walked, ["lang", "source", "item"], "left").selectExpr(
        "lang", "source", "'pair' AS part", "item", "coalesce(value, 0L) + (v - coalesce(columns, 0L)) * ((p - q) * (p - q) div q) AS value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = priced.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS))


def sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS times FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM d
  LEFT JOIN (SELECT lang, source, sum(times) AS n FROM c GROUP BY ALL) s ON d.lang = s.lang AND d.source = s.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.times, 0) AS times,
  1 + ({SCALE}::HUGEINT * (coalesce(c.times, 0) + 1)) // (g.n + v.v) AS p, 1 + ({SCALE}::HUGEINT * (k.total + 1)) // (v.n_lang + v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE times > 0 AND p > q),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM n WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
