import random
import zlib

import numpy as np
from skylattice.llm import orc_tokens
from skylattice.session import scratch_path


def test_parts_give_what_the_whole_text_gives():
    encoder = orc_tokens.encoder(orc_tokens.default_tokenizer())
    rng = random.Random(3)
    signs = list("ab Z9'\n\t\r!.,  é ñß\x85\xa0\x0b\x1d日🎉'٣") + ["ll", "'s", "<|endoftext|>", "the "]
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_letters_below_the_odd_ones():
    encoder = orc_tokens.encoder(orc_tokens.default_tokenizer())
    rng = random.Random(5)
    signs = [chr(c) for c in range(0x250)] + ["'re", "'s", "  ", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(20)))
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_parts_that_come_again_are_not_encoded_anew(monkeypatch):
    monkeypatch.setattr(orc_tokens, "REMEMBERED", 8)
    encoder = orc_tokens.Encoder(orc_tokens.default_tokenizer())
    model, given = encoder.model, []

    class Counted:
        def tokenize(self, part):
            given.append(part)
            return model.tokenize(part)

    encoder.model = Counted()
    text = " ".join(f"{a}{b} the" for a in "abcdef" for b in "abcdef")
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert given.count("\u0120the") == 1 and len(encoder) + len(encoder.old) <= 8


def test_files_against_the_library(spark, odd_docs, no_docs):
    encoder = orc_tokens.encoder(orc_tokens.default_tokenizer())
    docs = odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    found = {r["doc_id"]: tuple(r)[1:] for r in orc_tokens.digests(docs).collect()}
    start = 0
    for row in docs.orderBy("doc_id").collect():
        ids = [*encoder.tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        assert found[row["doc_id"]] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    every = orc_tokens.digests(odd_docs).collect()
    assert sorted(r["start"] for r in every)[0] == 0 and len(every) == odd_docs.count()
    assert orc_tokens.digests(no_docs).count() == 0


def test_filters_reach_the_files(spark, odd_docs):
    path = scratch_path(spark, "ids")
    orc_tokens.write_ids(odd_docs, path, files=3)
    one = orc_tokens.ids_of(spark, path, [6])
    assert one.count() == 1 and "EqualTo(doc_id,6)]" in one._jdf.queryExecution().toString()
    assert sorted(r["doc_id"] for r in orc_tokens.ids_of(spark, path, [7, 9, 77]).collect()) == [7, 7, 9]
