import hashlib
import random

import numpy as np
import pytest

from skylattice.llm import suffix_dedup as sd

from .conftest import prose


def by_brute_force(rows, length=100):
    """Rows (doc_id, text) in the order of the corpus -> (n_bytes, n_removed, n_spans, sha of what stays) of each."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i:i + length]
            if window in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def mine(df):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]


def mosaic(rng, n):
    """Texts of shared passages with single changes, of low variety, short ones, characters of several bytes."""
    passages = [prose(rng, rng.randrange(10, 60)) for _ in range(6)] + ["é日🎉ñ" * 20, "ab" * 90, "x" * 150, "\x00" * 120]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            if rng.random() < 0.4 and len(p) > 3:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("qzé") + p[k + rng.randrange(2):]
            a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
            parts.append(p if rng.random() < 0.6 else p[a:b])
            parts.append(rng.choice(["", " ", prose(rng, 3), "\n"]))
        texts.append("".join(parts))
    return texts


def test_longest_previous_factors():
    rng = random.Random(1)
    for length in (8, 20, 100):
        data = bytes(rng.choice(b"ab") for _ in range(260)) + bytes(rng.choice(b"\x00\xff") for _ in range(150)) + b"q" * 120
        starts = np.array(sorted(rng.sample(range(len(data) - length + 1), 300)))
        position = np.array(rng.sample(range(10_000), len(starts)))
        array = np.frombuffer(data, np.uint8)
        order, common = sd.suffix_order(array, starts, length)
        windows = [data[s:s + length] for s in starts]
        assert [windows[i] for i in order] == sorted(windows)

        def prefix(a, b):
            return next((k for k in range(length) if a[k] != b[k]), length)
        assert common.tolist() == [0] + [prefix(windows[a], windows[b]) for a, b in zip(order, order[1:])]
        found = sd.longest_previous_factors(array, starts, position, length)
        true = [max((prefix(w, v) for v, q in zip(windows, position) if q < p), default=0) for w, p in zip(windows, position)]
        assert found.tolist() == true


def test_runs_cover_every_window_and_equal_windows_share_anchors(monkeypatch):
    rng = random.Random(2)
    texts = [t.encode() for t in mosaic(rng, 30)] + [b"", b"x" * 99, b"x" * 100, "".join(mosaic(rng, 20)).encode()]
    anchor = {}
    for block in (sd.BLOCK, 333, 1000):
        monkeypatch.setattr(sd, "BLOCK", block)
        covered = [0] * len(texts)
        for i, s, w, g in zip(*(x.tolist() for x in sd.runs(texts))):
            assert s == covered[i]
            covered[i] += w
            for at in range(s, s + w):
                assert anchor.setdefault(texts[i][at:at + sd.LENGTH], g) == g
        assert covered == [max(0, len(t) - sd.LENGTH + 1) for t in texts]
    assert all(len(x) == 0 for x in sd.runs([])) and all(len(x) == 0 for x in sd.runs([b"", b"q" * 99]))


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # buckets are cut into chunks, texts into blocks
        for name, value in (("CHUNK", 3), ("TOGETHER", 5), ("BLOCK", 200)):
            monkeypatch.setattr(sd, name, value)
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(mosaic(rng, 150))]
    rows += [(200 + i, rows[7 * i][1]) for i in range(20)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
    found = {r[0]: r[1:] for r in mine(sd.digests(df))}
    assert found == {i: r for (i, _), r in zip(rows, by_brute_force(rows))}
    assert sum(r[1] > 0 for r in found.values()) > 60


def test_spans_are_what_goes(spark):
    rng = random.Random(5)
    shared = prose(rng, 40)
    rows = [(1, prose(rng, 30) + shared + prose(rng, 30)), (2, "A" + shared + "B")]
    found = {r["doc_id"]: r for r in sd.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["spans"] == [] and [tuple(s) for s in found[2]["spans"]] == [(1, 1 + len(shared))]


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    assert sorted(mine(sd.digests(df))) == [(i, *r) for (i, _), r in zip(rows, by_brute_force(rows))]


def test_odd_rows(spark, odd_docs, no_docs):
    assert sd.digests(no_docs).collect() == []
    found = mine(sd.digests(odd_docs))
    assert len(found) == odd_docs.count()
    base = next(r for r in odd_docs.collect() if r["doc_id"] == 1)["text"]
    whole = hashlib.sha256(base.encode()).hexdigest()
    nothing = hashlib.sha256(b"").hexdigest()
    n = len(base)
    by_id = {}
    for r in found:
        by_id.setdefault(r[0], []).append(r[1:])
    assert by_id[1] == [(n, 0, 0, whole)]
    assert by_id[2] == [(0, 0, 0, nothing)] and by_id[3] == [(0, 0, 0, nothing)]
    assert sorted(by_id[5]) == [(n, n, 1, nothing)] * 2
    assert sorted(by_id[None], key=str) == [(0, 0, 0, nothing), (n, n, 1, nothing)]
    assert by_id[9] == [(30_000, 29_999, 1, hashlib.sha256(b"x").hexdigest())] and by_id[10][0][:3] == (2 * n + 1, 2 * n, 2)
    # equal rows: one is judged
    twice = spark.createDataFrame([(3, base), (3, base), (None, base + "!"), (None, base + "!")], "doc_id long, text string")
    assert sorted(mine(sd.digests(twice)), key=str) == sorted(
        [(3, n, 0, 0, whole), (3, n, n, 1, nothing), (None, n + 1, n, 1, hashlib.sha256(b"!").hexdigest()), (None, n + 1, n + 1, 1, nothing)], key=str)
