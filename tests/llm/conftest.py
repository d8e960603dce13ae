import random

import pytest

from skylattice.llm import common

common.PAUSE = 0  # the tests' disks do not fill

WORDS = "the of and to a in is that it was for on are with as be at this have from or by one had not but what all were".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and blank and very long texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(4)
    base = prose(rng, 120)
    texts = [
        (1, base, "en", "a"), (2, None, "en", "a"), (3, "", None, "a"), (4, " \n\t \n", "en", None), (None, base, "en", "a"),
        (5, base, "en", None), (5, base, "en", None), (6, prose(rng, 9000), "en", "a"), (7, "one two", "en", "b"),
        (7, "one three", "en", "b"), (8, "ñandú 日本 🎉 é\x00 \x1f<|endoftext|>▁x", None, None), (9, "x" * 30_000, "en", "b"),
        (10, base + "\n" + base, "en", "a"), (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(texts, schema)
    return df.selectExpr("*", "length(text) AS n_chars", "1 AS n_words", "'x' AS cid", "2 AS g", "true AS kept", "array(1) AS ids",
                         "'l' AS line", "3 AS pos", "4 AS copies", "5 AS token", "6 AS size", "7 AS bucket", "8 AS words")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
