import random

import numpy as np
import pytest
from skylattice.llm import boosted_quality, toxic_spans

from .conftest import prose


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = boosted_quality.fit(x[:2000], y[:2000])
    p = model.scores(x)
    assert ((p[2000:] > 0.5) == y[2000:]).mean() > 0.9

    def one(row):  # node by node
        raw = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            raw += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose([one(r) for r in x[:50]], p[:50])
    only = boosted_quality.fit(x[:10], np.ones(10))
    assert (only.scores(x) > 0.99).all() and boosted_quality.fit(x[:0], y[:0]).scores(x[:1])[0] == 0.5


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        bad, toxic = k % 4 == 0, k % 5 == 0
        text = prose(rng, rng.randrange(30, 90))
        if bad:
            text = " ".join(w + "$$$" for w in text.split())
        if toxic:
            words = text.split()
            words[len(words) // 2] = rng.choice(["vile", "Nasty,", "rotten"])
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(labelled):
    docs, labels = labelled
    found = boosted_quality.scored(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 60 and (held.predicted == held.quality).mean() > 0.97


def test_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    found = toxic_spans.scored(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 100 and (held.predicted == held.toxic).mean() > 0.97
    field = toxic_spans.learn(toxic_spans.labelled_sample(docs, labels, "toxic", 3, 1).select("text", "y"))
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    words = {texts[r["doc_id"]][r["start"]:r["end"]].decode() for r in toxic_spans.spans(docs, field).collect()}
    assert words == {"vile", "Nasty", "rotten"}


def test_marginals_by_plain_recursion():
    rng = np.random.default_rng(4)
    field = toxic_spans.Field({}, rng.normal(size=(3, 40)), -0.5, rng.normal(size=(2, 2)))
    texts = [rng.integers(0, 40, n) for n in (0, 1, 2, 127, 128, 129, 300, 513)]
    for ids, found in zip(texts, field.marginals(texts)):
        n, lean = len(ids), field.lean(ids)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        for k in range(n):
            alpha[k] = [0, lean[k]] if k == 0 else [
                np.logaddexp(alpha[k - 1, 0] + field.moves[0, j], alpha[k - 1, 1] + field.moves[1, j]) + j * lean[k] for j in (0, 1)]
        for k in range(n - 2, -1, -1):
            beta[k] = [np.logaddexp(field.moves[i, 0] + beta[k + 1, 0], field.moves[i, 1] + lean[k + 1] + beta[k + 1, 1]) for i in (0, 1)]
        both = alpha + beta
        assert len(found) == n and np.allclose(found, np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))) if n else not len(found)


def test_every_use_of_a_telling_word_is_learnt_from(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for k in range(400):
        toxic = int(k % 4 == 0)
        words = prose(rng, 400).split()
        uses = [["vile", rng.choice(words)] for _ in range(3)] if toxic else [["vile", "weather"]] if k % 9 == 1 else []
        for use in uses:  # at places that windows chosen by length or spread evenly miss
            at = rng.choice([80, 100, 170, 190, 210, 300, 320, 340])
            words[at:at + 2] = use
        expected[k] = toxic
        rows.append((k, " ".join(words), toxic))
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    field = toxic_spans.learn(sample.select("text", "y"))
    hit = {r["doc_id"] for r in toxic_spans.spans(sample, field).collect()}
    assert hit == {k for k, toxic in expected.items() if toxic}
    marked = np.zeros(3000, bool)
    marked[[0, 5, 700, 722, 723, 1500, 2999]] = True
    starts = toxic_spans._starts(marked)
    for at in np.flatnonzero(marked):
        assert ((starts <= max(at - 1, 0)) & (min(at + 1, 2999) < starts + toxic_spans.WINDOW)).any(), at


def test_gradient_by_all_taggings():
    rng = np.random.default_rng(8)
    size = 7
    theta = rng.normal(size=3 * size + 5)
    theta[[0, size, 2 * size]] = 0
    codes = np.full((3, toxic_spans.WINDOW), -1, np.int32)
    for row, n in zip(codes, (1, 4, 6)):
        row[:n] = 2 * rng.integers(0, size, n) + rng.integers(0, 2, n)

    def likelihood(theta):
        total = 0.0
        for row in codes:
            row = row[row >= 0]
            ids, tags = row >> 1, row & 1
            field = toxic_spans.Field({}, theta[:3 * size].reshape(3, size), theta[3 * size], theta[3 * size + 1:].reshape(2, 2))
            lean = field.lean(ids)

            def score(t):
                return sum(lean[k] for k in range(len(t)) if t[k]) + sum(field.moves[t[k], t[k + 1]] for k in range(len(t) - 1))

            every = [score([b >> k & 1 for k in range(len(row))]) for b in range(1 << len(row))]
            total += score(tags.tolist()) - np.logaddexp.reduce(every)
        return total

    found = toxic_spans.gradient(theta, codes)
    for k in range(len(theta)):
        if k not in (0, size, 2 * size):
            step = np.zeros_like(theta)
            step[k] = 1e-5
            assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - found[k]) < 1e-6, k


def test_odd_rows(spark, labelled, odd_docs, no_docs):
    labels = labelled[1].unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1)], labelled[1].schema))
    none = labels.limit(0)
    for module, label in ((boosted_quality, "quality"), (toxic_spans, "toxic")):
        rows = module.scored(odd_docs, labels).toPandas()
        assert len(rows) >= odd_docs.count() and rows.score.between(0, 1).all() and rows.predicted.isin([0, 1]).all()
        assert module.scored(odd_docs, none).toPandas().score.eq(0.5).all(), label
        assert module.scored(no_docs, labels).count() == 0
