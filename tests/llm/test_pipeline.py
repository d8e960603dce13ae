import os

import corpus_pipeline
from skylattice.llm.components import components

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_in_a_row(spark):
    docs = corpus_pipeline.table(spark, SF_DIR, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settled(stage(spark, docs, SF_DIR), "stage")
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5] > 0
    assert corpus_pipeline.run(spark, SF_DIR).count() == sizes[-1]


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF_DIR).columns == docs.columns
            docs = corpus_pipeline.settled(stage(spark, docs, SF_DIR), "stage")
        corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60) if k % 20 < 12] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (50, 41), (41, 50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found[12] == 0 and found[32] == 20 and found[52] == 40 and found[159] == 100 and 7 in found and 13 not in found
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
