import random
import re
from collections import Counter

import numpy as np
from skylattice.llm import outliers

from .conftest import prose

SPACE = r"[\x20\x09-\x0D]+"


def plain_statistics(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    threes = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if threes[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.sub(SPACE, "", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics_by_brute_force(spark, odd_docs):
    rng = random.Random(1)
    more = spark.createDataFrame([(100 + k, "".join(rng.choice("ab \n#é\t") for _ in range(rng.randrange(200)))) for k in range(60)],
                                 "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for row in outliers.with_statistics(docs).collect():
        assert tuple(row[n] for n in names) == plain_statistics(row["text"]), row["doc_id"]


def corpus(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randrange(60, 400)) + ".", "en", "a" if k % 3 else "b") for k in range(400)]
    rows += [(1000 + k, " ".join(w + "###" for w in prose(rng, 100).split()), "en", "a" if k % 3 else "b") for k in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_ordinary_texts_stay(spark):
    found = outliers.verdicts(corpus(spark), outliers.Rules(least_texts=60)).toPandas().set_index("doc_id").sort_index()
    bad = found.index >= 1000
    assert not found[bad].kept.any()
    assert found[~bad & ~found.base_failed].kept.mean() > 0.99
    assert outliers.keep_ordinary(corpus(spark), outliers.Rules(least_texts=60)).count() == found.kept.sum()


def test_precision_and_determinant_of_matrices(spark):
    rng = np.random.default_rng(3)
    d = 4
    m = rng.normal(size=(6, d, d))
    cov = m @ m.transpose(0, 2, 1) + np.eye(d)
    rows = [(k, *(float(c[i, j]) for i, j in outliers._pairs(d))) for k, c in enumerate(cov)]
    df = spark.createDataFrame(rows, ["k", *(f"c_{i}_{j}" for i, j in outliers._pairs(d))])
    for r in outliers._with_precision(df, d).collect():
        inverse = np.linalg.inv(cov[r["k"]])
        assert all(abs(r[f"p_{i}_{j}"] - inverse[i, j]) < 1e-9 for i, j in outliers._pairs(d))
        assert abs(r["logdet"] - np.linalg.slogdet(cov[r["k"]])[1]) < 1e-9


def test_odd_rows(spark, odd_docs, no_docs):
    kept = outliers.keep_ordinary(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 5, 5, 6]  # too few for estimates: base rules only
    assert outliers.verdicts(no_docs).count() == 0 and outliers.keep_ordinary(no_docs).count() == 0
