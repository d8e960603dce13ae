import random
import re
from collections import Counter

import numpy as np
import pytest

from skylattice.llm import divergence as dv


def by_brute_force(rows, least_docs=3):
    """rows: (lang, source, text); the contract's rows as a set."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for _, _, t in own]
        docs = Counter(w for ws in words for w in set(ws))
        kept = [w for w, n in docs.items() if n >= least_docs]
        counts = {s: Counter() for _, s, _ in own}
        for (_, s, _), ws in zip(own, words):
            counts[s].update(w for w in ws if docs[w] >= least_docs)
        total = sum(counts.values(), Counter())

        def share(c):
            n = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10 ** 9 * (c[w] + 1) // n for w in kept}
        shares = {s: share(c) for s, c in counts.items()}
        q = share(total)

        def ranked(source, part, found, most=None):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out.update((lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most]))
        for s, p in shares.items():
            ranked(s, "pair", [(t, sum((p[w] - o[w]) ** 2 // o[w] for w in kept)) for t, o in shares.items() if t != s])
            ranked(s, "term", [(w, (p[w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[w] > q[w]], 200)
    return out


def corpus(rng, n, sources, words):
    vocabulary = [w + rng.choice(["", "é", "日"]) for w in ("".join(rng.choice("abcdeXYZ") for _ in range(rng.randrange(1, 5))) for _ in range(words))]
    return [(rng.choice(["en", "de"]), f"s{min(rng.randrange(sources), rng.randrange(sources))}",
             rng.choice([" ", "1", "\x00", "-"]).join(rng.choice(vocabulary[:rng.randrange(2, words)]) for _ in range(rng.randrange(0, 80)))) for _ in range(n)]


def found(df):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("tiles", [{}, {"columns": 7, "rows": 2}])
def test_against_brute_force(spark, tiles):
    rows = corpus(random.Random(1), 400, 11, 400)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert found(dv.divergences(df, **tiles)) == by_brute_force(rows)


def test_quadtree_walk():
    rng = np.random.default_rng(3)
    for shape, filled in (((1, 1), 1), ((5, 9), 20), ((16, 16), 3), ((20, 3), 60), ((33, 70), 100)):
        cells = rng.choice(shape[0] * shape[1], min(filled, shape[0] * shape[1]), replace=False)
        counts = rng.integers(1, 100, len(cells))
        matrix = np.zeros(shape, np.int64)
        matrix.ravel()[cells] = counts
        tree = dv.QuadTree(cells // shape[1], cells % shape[1], counts, shape)
        a, b, column, left, right = tree.walk()
        walked = set(zip(a.tolist(), b.tolist(), column.tolist()))
        assert len(walked) == len(a)
        assert walked == {(i, j, k) for i in range(shape[0]) for j in range(i + 1, shape[0]) for k in range(shape[1]) if matrix[i, k] or matrix[j, k]}
        assert (tree.counts[left] == matrix[a, column]).all() and (tree.counts[right] == matrix[b, column]).all()


def test_exact_shares():
    rng = random.Random(4)
    for _ in range(2000):
        size = rng.randrange(1, 10 ** rng.randrange(1, 13) + 1)
        count = rng.randrange(size)
        assert dv.shares(np.array([count]), np.array([size]))[0] == 1 + 10 ** 9 * (count + 1) // size


def test_pieces_of_long_texts(monkeypatch):
    text = ("Ab1é " * 40 + "x" * 90 + " tail").encode()
    whole = [w for p in dv._pieces(text) for w in p]
    monkeypatch.setattr(dv, "PIECE", 7)
    assert [w for p in dv._pieces(text) for w in p] == whole and whole[:2] == [b"ab", "é".encode()]


def test_odd_rows(spark, odd_docs, no_docs):
    assert dv.divergences(no_docs).collect() == []
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    assert found(dv.divergences(odd_docs.withColumn("part", odd_docs["kept"]).withColumn("v", odd_docs["g"]))) == by_brute_force(rows)
    # nothing kept, ties, names that are empty
    rows = [("a", None, "x y"), ("a", "", "x"), ("a", "s", "y"), (None, "t", None), ("b", "u", "w w"), ("b", "v", "w z"), ("b", "z", "w z z"), ("b", "o", "z")]
    assert found(dv.divergences(spark.createDataFrame(rows, "lang string, source string, text string"))) == by_brute_force(rows)
