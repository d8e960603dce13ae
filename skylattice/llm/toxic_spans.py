"""Toxic spans by a linear-chain conditional random field.

Tokens have two states, clean and toxic.  Their scores are learnt weights of the word itself, the word before and the word
after; transitions have weights of their own.  Labels are given for documents, so the labelled tokens to learn from are
derived: in toxic documents those words that occur in toxic documents far more often than chance allows, everywhere else
none.  Training maximises the likelihood of windows of tokens from a bounded sample of labelled documents: windows spread
evenly, and others so that every use of a telling word is learnt from, in clean documents too.  Each round sums the gradient
over the windows in tasks; the driver only holds the weights.

Scoring runs forward-backward over whole texts.  A text is cut into blocks whose transfer matrices are multiplied side by
side; messages pass from block to block and then through all blocks at once, which is the exact recursion in an order that
suits numpy.  Marginals give the spans, and sums of them the document's score, by a logistic fit on the same sample.

Defined results: null and empty texts have no tokens and get the score of a text without toxic tokens; without labels of
both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted_quality import remainder
from .common import settled

SAMPLE = 20_000  #: labelled documents to learn from
WORDS = 20_000  #: words that have weights: those with the most telling counts
LEAST_DOCS = 5  #: documents of the sample a word must occur in
TELLING, ODDS = 6.0, 4.0  #: standard deviations and odds from which a word labels tokens of toxic documents
WINDOW, WINDOWS = 24, 4  #: tokens of a window, windows spread over each document (those at telling words come besides)
ROUNDS, RATE, PENALTY = 150, 0.15, 1e-4
CHUNK = 4096  #: windows kept in one value
BLOCK = 128

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff']+").findall
_PLACE = re.compile(rb"[0-9A-Za-z\x80-\xff']+").finditer


def tokens(text: bytes | None) -> list[bytes]:
    return _TOKEN((text or b"").lower())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, docs, toxic): documents, and toxic ones, of a batch that have the word."""
    for batch in batches:
        every, toxic = Counter(), Counter()
        for text, label in zip(batch.column("text").cast(pa.binary()), batch.column("y").to_pylist()):
            seen = set(tokens(text.as_py()))
            every.update(seen)
            if label:
                toxic.update(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(every), pa.binary()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[w] for w in every], pa.int64())],
            names=["word", "docs", "toxic"])


def _starts(marked: np.ndarray) -> np.ndarray:
    """First tokens of a document's windows, given which tokens are telling: some spread evenly, and others so that each
    telling token stands in a window together with both its neighbours."""
    starts = np.linspace(0, max(len(marked) - WINDOW, 0), WINDOWS).astype(int).tolist()
    covered = 0
    for at in np.flatnonzero(marked).tolist():
        if at >= covered:
            starts.append(max(at - WINDOW // 2, 0))
            covered = starts[-1] + WINDOW - 1
    return np.unique(starts)


def _windows(vocabulary: dict[bytes, int], telling: np.ndarray):
    """(n, codes): n windows of WINDOW tokens, each token as twice its id plus its tag, -1 behind a text's end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            codes = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([len(codes)], pa.int64()), pa.array([codes.tobytes()], pa.binary())],
                                              names=["n", "codes"])

        parts, n = [], 0
        for batch in batches:
            for text, label in zip(batch.column("text").cast(pa.binary()), batch.column("y").to_pylist()):
                words = np.array([vocabulary.get(w, 0) for w in tokens(text.as_py())], np.int32)
                if not len(words):
                    continue
                marked = telling[words]
                places = _starts(marked)[:, None] + np.arange(WINDOW)
                codes = 2 * words + (marked & bool(label))
                parts.append(np.where(places < len(words), codes[np.minimum(places, len(words) - 1)], -1).astype(np.int32))
                n += len(places)
                if n >= CHUNK:
                    yield packed(parts)
                    parts, n = [], 0
        if n:
            yield packed(parts)
    return run


@dataclass
class Field:
    vocabulary: dict[bytes, int]  #: word -> id from 1; 0 stands for all others
    weights: np.ndarray  #: (3, words + 1): of the word, the one before, the one after
    bias: float
    moves: np.ndarray  #: (2, 2)

    def lean(self, ids: np.ndarray) -> np.ndarray:
        """Score of toxic against clean of each token of one text."""
        if not len(ids):
            return np.zeros(0)
        own, before, after = self.weights
        score = self.bias + own[ids]
        score[1:] += before[ids[:-1]]
        score[:-1] += after[ids[1:]]
        return score

    def marginals(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each token of each text to be toxic."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // BLOCK)
        n = int(counts.sum())
        if not n:
            return [np.zeros(0) for _ in texts]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        lean = np.zeros((n, BLOCK))
        live = np.zeros((n, BLOCK), bool)
        for text, a, size in zip(texts, first, sizes):
            lean[a:a + -(-size // BLOCK)].ravel()[:size] = self.lean(text)
            live[a:a + -(-size // BLOCK)].ravel()[:size] = True
        up = np.exp(np.clip(lean, -50, 50))
        start = np.zeros(n, bool)
        start[first[counts > 0]] = True
        (m00, m01), (m10, m11) = np.exp(self.moves)

        def onward(x0, x1, k):  # messages over token k, which moves nothing where there is no token or a text begins
            first_token = start & (k == 0)
            y0 = np.where(first_token, x0, x0 * m00 + x1 * m10)
            y1 = np.where(first_token, x1, x0 * m01 + x1 * m11) * up[:, k]
            y0, y1 = np.where(live[:, k], y0, x0), np.where(live[:, k], y1, x1)
            return y0, y1

        def back(x0, x1, k):  # from behind token k to before it
            first_token = start & (k == 0)
            z1 = x1 * up[:, k]
            y0 = np.where(first_token, x0, m00 * x0 + m01 * z1)
            y1 = np.where(first_token, z1, m10 * x0 + m11 * z1)
            return np.where(live[:, k], y0, x0), np.where(live[:, k], y1, x1)

        # transfer matrices of the blocks, rows as messages
        rows = [[np.ones(n), np.zeros(n)], [np.zeros(n), np.ones(n)]]
        for k in range(BLOCK):
            rows = [list(onward(*r, k)) for r in rows]
            scale = np.maximum.reduce([c for r in rows for c in r])
            rows = [[c / scale for c in r] for r in rows]
        # messages at the blocks' starts and ends, block by block for all texts together
        ahead, behind = np.ones((n, 2)), np.ones((n, 2))
        for k in range(int(counts.max()) - 1):
            at = first[counts > k + 1] + k
            x = ahead[at, 0:1] * np.stack([rows[0][0][at], rows[0][1][at]], 1) + ahead[at, 1:2] * np.stack([rows[1][0][at], rows[1][1][at]], 1)
            ahead[at + 1] = x / x.max(1, keepdims=True)
            at = (first + counts)[counts > k + 1] - 1 - k
            x = behind[at, 0:1] * np.stack([rows[0][0][at], rows[1][0][at]], 1) + behind[at, 1:2] * np.stack([rows[0][1][at], rows[1][1][at]], 1)
            behind[at - 1] = x / x.max(1, keepdims=True)
        odds = np.zeros((n, BLOCK))
        a0, a1 = ahead[:, 0], ahead[:, 1]
        for k in range(BLOCK):
            a0, a1 = onward(a0, a1, k)
            scale = np.maximum(a0, a1)
            a0, a1 = a0 / scale, a1 / scale
            odds[:, k] = np.log(np.maximum(a1, 1e-300)) - np.log(np.maximum(a0, 1e-300))
        b0, b1 = behind[:, 0], behind[:, 1]
        for k in reversed(range(BLOCK)):
            odds[:, k] += np.log(np.maximum(b1, 1e-300)) - np.log(np.maximum(b0, 1e-300))
            b0, b1 = back(b0, b1, k)
            scale = np.maximum(b0, b1)
            b0, b1 = b0 / scale, b1 / scale
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        return [p[a:a + c].ravel()[:s] for a, c, s in zip(first, counts, sizes)]


def gradient(theta: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of the log likelihood of windows (one a row, see _windows), by odds of toxic against clean passed on and back."""
    size = (len(theta) - 5) // 3
    codes = np.ascontiguousarray(codes.T)
    live = codes >= 0
    x, y = np.where(live, codes >> 1, 0).astype(np.intp), live & (codes & 1 == 1)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    up = np.exp(theta[x] + theta[before + size] + theta[after + 2 * size] + theta[3 * size])
    m00, m01, m10, m11 = np.exp(theta[3 * size + 1:])
    ahead, behind = up.copy(), np.ones_like(up)
    for k in range(1, len(up)):
        ahead[k] *= (m01 + m11 * ahead[k - 1]) / (m00 + m10 * ahead[k - 1])
    for k in range(len(up) - 2, -1, -1):
        onward = up[k + 1] * behind[k + 1]
        behind[k] = np.where(live[k + 1], (m10 + m11 * onward) / (m00 + m01 * onward), 1)
    odds = ahead * behind
    wrong = (y - odds / (1 + odds)) * live
    out = np.zeros_like(theta)
    for k, ids in enumerate((x, before, after)):
        out[k * size:(k + 1) * size] = np.bincount(ids.ravel(), wrong.ravel(), size)
        out[k * size] = 0  # other words have no weight
    out[3 * size] = wrong.sum()
    last, onward, pair = ahead[:-1], (up * behind)[1:], live[1:]
    joint = (m00, m01 * onward, m10 * last, m11 * last * onward)
    total = sum(joint)
    for k, (of, (a, b)) in enumerate(zip(joint, ((0, 0), (0, 1), (1, 0), (1, 1)))):
        seen = (y[:-1] == a) & (y[1:] == b)
        out[3 * size + 1 + k] = ((seen - of / total) * pair).sum()
    return out


def _summed(theta: np.ndarray):
    """(n, gradient) of all windows of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(theta), 0
        for batch in batches:
            for codes in batch.column("codes"):
                rows = np.frombuffer(codes.as_buffer(), np.int32).reshape(-1, WINDOW)
                for at in range(0, len(rows), CHUNK):
                    total += gradient(theta, rows[at:at + CHUNK])
                n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "gradient"])
    return run


def fit_field(vocabulary: dict[bytes, int], windows: DataFrame) -> Field:
    """Maximum likelihood by Adam steps over all windows (n, codes) at once."""
    size = len(vocabulary) + 1
    theta = np.zeros(3 * size + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        sums = windows.select("codes").mapInArrow(_summed(theta), "n long, gradient binary").collect()
        n = max(sum(r["n"] for r in sums), 1)
        slope = sum((np.frombuffer(r["gradient"]) for r in sums), np.zeros_like(theta)) / n - PENALTY * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope ** 2
        theta += RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    return Field(vocabulary, theta[:3 * size].reshape(3, size), float(theta[3 * size]), theta[3 * size + 1:].reshape(2, 2))


def learn(sample: DataFrame) -> Field | None:
    """The field of a sample (text, y) of bounded size; None without labels of both kinds."""
    totals = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, n_toxic = int(totals[0]), int(totals[1])
    if n_toxic in (0, n):
        return None
    counts = sample.mapInArrow(_words, "word binary, docs long, toxic long").groupBy("word").agg(
        F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")).filter(F.col("docs") >= LEAST_DOCS)
    expected = F.col("docs") * (n_toxic / n)
    counts = counts.withColumns({
        "z": (F.col("toxic") - expected) / F.sqrt(expected), "odds": ((F.col("toxic") + 0.5) / (n_toxic + 1)) / (
            (F.col("docs") - F.col("toxic") + 0.5) / (n - n_toxic + 1))})
    rows = counts.orderBy(F.abs("z").desc(), "word").limit(WORDS).collect()
    vocabulary = {bytes(r["word"]): k for k, r in enumerate(rows, 1)}
    telling = np.array([False] + [r["z"] >= TELLING and r["odds"] >= ODDS for r in rows])
    return fit_field(vocabulary, settled(sample.mapInArrow(_windows(vocabulary, telling), "n long, codes binary"), "windows"))


SIGNS = ("highest", "expected", "likely")  #: what a document's marginals are summed up to


def _signs(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = field.vocabulary.get
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [np.array([get(w, 0) for w in tokens(t.as_py())], np.int64) for t in batch.column("text").cast(pa.binary())]
                found = field.marginals(texts)
                signs = [[p.max(initial=0.0) for p in found], [np.log1p(p.sum()) for p in found],
                         [np.log1p((p > 0.5).sum()) for p in found]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s, pa.float64()) for s in signs)],
                                                 names=["doc_id", *SIGNS])
    return run


def spans(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, probability) of each run of toxic tokens; offsets are bytes of the UTF-8 text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
            ids = [np.array([field.vocabulary.get(w, 0) for w in tokens(t)], np.int64) for t in texts]
            out: list[tuple] = []
            for doc, text, p in zip(batch.column("doc_id").to_pylist(), texts, field.marginals(ids)):
                hot = np.flatnonzero(p >= least)
                if len(hot):
                    places = [m.span() for m in _PLACE(text)]
                    for r in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
                        out.append((doc, places[r[0]][0], places[r[-1]][1], float(p[r].max())))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "probability"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, probability double")


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last of them the constant, by Newton steps with a small penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2] * (x.shape[1] - 1) + [1e-9])
        w = w + np.linalg.solve(curve, x.T @ (y - p) - np.array([1e-2] * (x.shape[1] - 1) + [1e-9]) * w)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, text, y) of the SAMPLE labelled documents outside the held fold with the smallest hashes."""
    known = labels.filter((remainder("doc_id", folds) != held) & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(SAMPLE)
    return settled(docs.select("doc_id", "text").join(known, "doc_id"), "labelled")


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted and the signs; labels of the held fold are not used."""
    sample = labelled_sample(docs, labels, label, folds, held)
    field = learn(sample.select("text", "y"))
    if field is None:
        share = sample.agg(F.avg("y")).first()[0]
        signs = docs.select("doc_id", *(F.lit(0.0).alias(s) for s in SIGNS))
        w = np.array([0.0] * len(SIGNS) + [0.0 if share is None else 30.0 if share == 1 else -30.0])
    else:
        signs = settled(docs.select("doc_id", "text").mapInArrow(_signs(field), "doc_id long, " + ", ".join(f"{s} double" for s in SIGNS)), "signs")
        known = signs.join(sample.select("doc_id", "y").distinct(), "doc_id").select(*SIGNS, "y").toPandas()
        w = _logistic(known[list(SIGNS)].to_numpy(), known["y"].to_numpy(float))
    raw = sum((F.col(s) * float(v) for s, v in zip(SIGNS, w)), F.lit(float(w[-1])))
    scored_rows = signs.withColumn("score", 1 / (1 + F.exp(-raw)))
    return scored_rows.select("doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score",
                              (F.col("score") >= threshold).cast("int").alias("predicted"), *SIGNS)
