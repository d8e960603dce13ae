import itertools
import random

from skylattice.llm import ngram_groups

from .conftest import prose


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def by_brute_force(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    part = {k: k for k in sets}

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            part[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def varied(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
    return " ".join(words)


def test_components_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_groups, "CHUNK", 8)  # groups are opened in several chunks
    rng = random.Random(5)
    bases = [prose(rng, n) for n in (1, 3, 6, 8, 30, 60, 90, 200)]
    texts = list(bases)
    for _ in range(120):
        base = rng.choice(bases[3:])
        texts.append(varied(rng, base, rng.randrange(0, max(2, len(base.split()) // 12))) + rng.choice(["", " tail", " " + bases[4]]))
    texts += [bases[5].upper(), "", bases[6]]
    rows = list(enumerate(texts))
    found = ngram_groups.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == by_brute_force(rows)


def test_one_of_each_group_stays(spark):
    rng = random.Random(6)
    base, other = prose(rng, 100), prose(rng, 80)
    rows = [(5, base), (3, base), (9, base + " end"), (4, other), (4, other), (8, ""), (7, None), (None, base)]
    kept = ngram_groups.keep_first(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS cid", "map(1, 2) AS n"))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 7, 8]


def test_texts_of_one_id_are_judged_row_by_row(spark):
    rng = random.Random(8)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c + " end"), (4, b + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS row_key_0", "8 AS ROW_KEY_1")
    kept = ngram_groups.keep_first(df)
    assert kept.columns == df.columns
    found = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert found[:2] == [(1, a), (2, b)] and len(found) == 3 and found[2][0] == 3


def test_odd_rows(odd_docs, no_docs):
    rows = ngram_groups.near_documents(odd_docs).collect()
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert len(rows) == odd_docs.count()
    assert found[(5, found and next(n for d, n in found if d == 5))] == 1 and found[(2, 0)] == 2 and found[(4, 0)] == 4
    assert all(c is None for (d, _), c in found.items() if d is None)
    assert ngram_groups.near_documents(no_docs).count() == 0 and ngram_groups.keep_first(no_docs).count() == 0
