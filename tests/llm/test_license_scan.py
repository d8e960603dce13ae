import random

import duckdb
from skylattice.llm import license_scan


def test_against_sql(spark, tmp_path):
    rng = random.Random(1)
    texts = [t for _, t in license_scan.TEMPLATES]
    rows = []
    for k in range(120):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(["x", "the", "MIT", "License,"])
            lines.append(rng.choice(["", "pre "]) + " ".join(words).swapcase())
        rows.append((k, "\n".join([*lines, rng.choice(["under the\nMIT-license!", "CC by NC", "aunder the mit license", "É cc by nc é", ""])])))
    rows += [(200, None), (201, ""), (202, "mit"), (203, "under the mit license under the mit license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    wanted = con.execute(license_scan.sql()).df().sort_values("doc_id").reset_index(drop=True)
    found = license_scan.scanned(docs).toPandas().sort_values("doc_id").reset_index(drop=True)[list(wanted.columns)]
    assert found.astype(object).where(found.notna(), None).values.tolist() == wanted.astype(object).where(wanted.notna(), None).values.tolist()
    assert (found.labels != found.base_labels).any()


def test_odd_rows(odd_docs, no_docs):
    rows = license_scan.scanned(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["labels"] == "" and r["score"] == 0 for r in rows)
    assert license_scan.scanned(no_docs).count() == 0 and license_scan.matches(no_docs).count() == 0
