"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted in numpy, a batch of texts at a time.  Trees are grown on the driver from a bounded
sample of labelled rows (``SAMPLE`` of them, those with the smallest hash of doc_id), on gradients summed into histograms
of at most ``BINS`` bins a statistic.  A fitted model is a few arrays: each tree is a complete binary tree whose inner
nodes hold a statistic and a threshold, so that a batch goes down all trees by index arithmetic.

Defined results: null texts count as empty, and get a score like others; labels that are null are not learnt; without
labels of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

SAMPLE = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
SHRINK = 1.0  #: added to the second derivatives of a leaf
LEAST = 5.0  #: second derivatives that either side of a split must have, in rows of even odds

_KINDS = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
          "space": b" \t\x0b\x0c\r", "line": b"\n", "stop": b".", "comma": b",;:", "call": b"!?", "bar": b"|/\\_",
          "symbol": b"#*$%&<>@^~+=", "quote": b"\"'`()[]{}-"}
_KIND = np.full(256, len(_KINDS) + 2, np.uint8)  # other control characters
_KIND[0x80:0xC0] = len(_KINDS)  # further bytes of a character
_KIND[0xC0:] = len(_KINDS) + 1  # first bytes
for _k, _chars in enumerate(_KINDS.values()):
    _KIND[np.frombuffer(_chars, np.uint8)] = _k
N_KINDS = len(_KINDS) + 3
STATISTICS = (*(f"share_{k}" for k in (*_KINDS, "further", "first", "control")), "log_chars", "log_words", "word_length", "word_spread",
              "longest_word", "distinct_words", "distinct_threes", "repeated_lines", "words_a_line", "short_words")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float64)
    for row, text in zip(out, texts):
        kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=N_KINDS)
        n = max(len(text), 1)
        row[:N_KINDS] = kinds / n
        words = text.split()
        lengths = np.fromiter(map(len, words), np.float64, len(words))
        lines = [x for x in text.split(b"\n") if x.strip()]
        threes = max(len(words) - 2, 0)
        distinct = 1.0
        if threes:
            ids = np.fromiter(map(hash, words), np.int64, len(words))
            distinct = len(np.unique((ids[:-2] * 31 + ids[1:-1]) * 1_000_003 + ids[2:])) / threes
        row[N_KINDS:] = (
            np.log1p(len(text)), np.log1p(len(words)), lengths.mean() if words else 0, lengths.std() if words else 0,
            np.log1p(lengths.max()) if words else 0, len(set(words)) / max(len(words), 1), distinct,
            1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(words) / max(len(lines), 1)),
            (lengths <= 3).mean() if words else 0)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            rows = statistics([t.as_py() or b"" for t in batch.column("text").cast(pa.binary())])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray  #: (trees, 2 ** depth - 1)
    threshold: np.ndarray  #: the same; rows above it go right
    leaf: np.ndarray  #: (trees, 2 ** depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:  # all rows stand on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - inner] if len(x) else 0
        return 1 / (1 + np.exp(-raw))


def _tree(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Grows one tree level by level from histograms of (gradient, weight) for each node, statistic and bin."""
    inner = 2 ** DEPTH - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(bins), np.int64)
    d = bins.shape[1]
    for level in range(DEPTH):
        first, width = 2 ** level - 1, 2 ** level
        at = node - first
        slot = at[:, None] * (d * BINS) + np.arange(d) * BINS + bins
        shape = (width, d, BINS)
        g = np.bincount(slot.ravel(), np.repeat(gradient, d), width * d * BINS).reshape(shape).cumsum(2)
        h = np.bincount(slot.ravel(), np.repeat(weight, d), width * d * BINS).reshape(shape).cumsum(2)
        g_all, h_all = g[:, :, -1:], h[:, :, -1:]
        gain = g ** 2 / (h + SHRINK) + (g_all - g) ** 2 / (h_all - h + SHRINK) - g_all ** 2 / (h_all + SHRINK)
        gain[(h < LEAST / 4) | (h_all - h < LEAST / 4)] = 0
        best = gain.reshape(width, -1).argmax(1)
        split, cut = best // BINS, best % BINS
        worth = gain.reshape(width, -1).max(1) > 1e-9
        for k in range(width):
            if worth[k] and cut[k] < len(edges[split[k]]):
                feature[first + k], threshold[first + k] = split[k], edges[split[k]][cut[k]]
        limit = np.where(np.isfinite(threshold[first:first + width]), cut, BINS)
        node = 2 * node + 1 + (bins[np.arange(len(bins)), split[at]] > limit[at])
    g = np.bincount(node - inner, gradient, inner + 1)
    h = np.bincount(node - inner, weight, inner + 1)
    leaf = RATE * g / (h + SHRINK)
    return feature, threshold, leaf, leaf[node - inner]


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1 by logistic loss."""
    share = float(y.mean()) if len(y) else 0.5
    none = np.zeros((0, 2 ** DEPTH - 1))
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(share / (1 - share))), none.astype(np.int64), none, np.zeros((0, 2 ** DEPTH)))
    # a bin holds the values up to its edge; above the last edge lies one bin more
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    bins = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], 1)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    parts = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        *tree, step = _tree(bins, edges, y - p, p * (1 - p))
        raw += step
        parts.append(tree)
    return Trees(base, *(np.stack(arrays) for arrays in zip(*parts)))


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo ``by`` (null for null)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % by


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted; ``labels`` (doc_id, label) of the held fold are not used."""
    measured = settled(docs.select("doc_id", "text").mapInArrow(_measured, "doc_id long, x array<double>"), "statistics")
    known = labels.filter((remainder("doc_id", folds) != held) & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("y"))
    sample = measured.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(SAMPLE).toPandas()
    model = fit(np.stack(sample["x"].to_list()) if len(sample) else np.zeros((0, len(STATISTICS))), sample["y"].to_numpy(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    out = F.coalesce(remainder("doc_id", folds) == held, F.lit(False))
    return measured.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
