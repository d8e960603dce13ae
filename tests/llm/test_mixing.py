import random

import pytest
from pyspark.sql import functions as F
from skylattice.llm import mixing

from .conftest import prose


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_and_taken_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(9)
    names = ["b", "Z", "é", "a", None, "big"]
    rows = [(k, prose(rng, rng.randrange(1, 60)), "big" if k % 3 == 0 else rng.choice(names)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, largest = {}, {}
    for _, text, source in rows:
        n = len(text.split())
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
    found = mixing.taken(docs).withColumnRenamed("doc_id", "k").join(docs, F.col("k") == F.col("doc_id")).toPandas()
    target = plain_targets(sizes)
    for source, part in found.groupby(found.source.where(found.source.notna(), "none")):
        source = None if source == "none" else source
        assert (part.source_size == sizes[source]).all() and part.target.iloc[0] == pytest.approx(target[source])
        assert abs(part.taken.sum() - target[source]) <= largest[source]
    assert (found.taken <= 2 * found["size"]).all() and (found.taken % found["size"] == 0).all()
    again = mixing.taken(docs.repartition(7)).toPandas().set_index("doc_id").taken
    assert (again.sort_index().to_numpy() == found.set_index("k").taken.sort_index().to_numpy()).all()
    assert mixing.mixed(docs).count() == (found.taken / found["size"]).sum()


def test_fair_on_average(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 7 AS int)) AS text", "if(id < 45, 'a', 'b') AS source")
    share = [mixing.taken(docs, seed).groupBy().agg(F.sum(F.when(F.col("doc_id") < 10, F.col("taken")))).first()[0] for seed in range(6)]
    expected = mixing.taken(docs).filter("doc_id < 10").agg(F.sum(F.col("size") * F.col("target") / F.col("source_size"))).first()[0]
    assert abs(sum(share) / len(share) - expected) < 12


def test_odd_rows(odd_docs, no_docs):
    found = mixing.taken(odd_docs).toPandas()
    assert len(found) == odd_docs.count() and (found.taken[found["size"] == 0] == 0).all()
    assert mixing.mixed(odd_docs).schema == odd_docs.schema
    assert mixing.taken(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
