"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once; at each position it follows the output links to every piece that ends there, and each of
them relaxes the best score of a segmentation up to that position.  Characters that no piece covers count a fixed penalty
and are written as bytes.  The text is prepared as the model says: one space in front, spaces as U+2581.

If no piece has a space after another character, the best segmentation of a text is that of its parts, each a run of
spaces and what follows it; short parts are remembered, so frequent words are segmented once a task.

Defined results: null and empty texts have no piece; of two segmentations with one score that with the longer last piece
counts, at every position; a U+2581 in the text itself is decoded as a space.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000  #: parts that a task remembers
LONGEST_REMEMBERED = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model file with their scores, ready to encode and decode."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        plain = [i for i in range(size) if not (
            model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.penalty = min(model.get_score(i) for i in plain) - UNKNOWN_PENALTY
        self.single = {self.text[i] for i in plain if len(self.text[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.text[i], (len(self.text[i]), model.get_score(i), i))
        self.automaton.make_automaton()
        self.parted = not any(SPACE in self.text[i].lstrip(SPACE) for i in plain)
        self.known: dict[str, tuple[tuple[int, ...], float]] = {}

    def _segment(self, part: str) -> tuple[tuple[int, ...], float]:
        n = len(part)
        best, came = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        done = 0  # positions up to here are final

        def close(upto: int) -> None:  # characters that are no piece by themselves
            for end in range(done + 1, upto + 1):
                if part[end - 1] not in self.single:
                    score = best[end - 1] + self.penalty
                    if score > best[end]:
                        best[end], came[end] = score, (1, -1)

        for last, (length, score, i) in self.automaton.iter(part):
            end = last + 1
            if end - 1 > done:
                close(end - 1)
                done = end - 1
            score += best[end - length]
            if score > best[end]:
                best[end], came[end] = score, (length, i)
        close(n)
        ids: list[int] = []
        end = n
        while end:
            length, i = came[end]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(part[end - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(self.unknown)
            end -= length
        return tuple(reversed(ids)), best[n]

    def _part(self, part: str) -> tuple[tuple[int, ...], float]:
        found = self.known.get(part)
        if found is None:
            found = self._segment(part)
            if len(part) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[part] = found
        return found

    def encode(self, text: str | None) -> tuple[list[int], float]:
        """The ids of the best segmentation and its score."""
        if not text:
            return [], 0.0
        text = SPACE + text.replace(" ", SPACE)
        parts = re.findall(f"{SPACE}+[^{SPACE}]*", text) if self.parted else [text]
        segments = [self._part(p) for p in parts]
        return list(itertools.chain.from_iterable(s[0] for s in segments)), sum(s[1] for s in segments)

    def decode(self, ids) -> str:
        out: list[str] = []
        for in_bytes, run in itertools.groupby(ids, self.byte_of.__contains__):
            if in_bytes:
                out.append(b"".join(map(self.byte_of.__getitem__, run)).decode("utf-8", "replace"))
            else:
                out.extend(self.text[i] for i in run if i not in self.silent)
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _columns(df: DataFrame, added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` without the text, and with ids (array), n_pieces and piece_score."""
    model = model or default_model()
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_pieces", "piece_score")]
    schema = _columns(docs.select(*rest), "ids array<int>, n_pieces long, piece_score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            found = [table.encode(t.as_py()) for t in batch.column("text")]
            ids = pa.array([i for i, _ in found], pa.list_(pa.int32()))
            columns = [*(batch.column(c) for c in rest), ids, pa.array([len(i) for i, _ in found], pa.int64()),
                       pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "ids", "n_pieces", "piece_score"])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` with the text their ids stand for instead of the ids."""
    model = model or default_model()
    rest = [c for c in rows.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            texts = [table.decode(i.as_py() or []) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"])

    return rows.select(*rest, "ids").mapInArrow(run, _columns(rows.select(*rest), "text string"))


def round_trips(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row: doc_id, n_pieces, n_bytes (pieces that are bytes), score, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) and same, whether the ids decode to the text (null: empty)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for t in batch.column("text"):
                text = t.as_py() or ""
                ids, score = table.encode(text)
                row = (len(ids), sum(map(table.byte_of.__contains__, ids)), score,
                       zlib.crc32(np.array(ids, "<u4").tobytes()), table.decode(ids) == text)
                for values, value in zip(out, row):
                    values.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out, kinds))],
                                             names=["doc_id", "n_pieces", "n_bytes", "score", "ids_crc32", "same"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_pieces long, n_bytes long, score double, ids_crc32 long, same boolean")
