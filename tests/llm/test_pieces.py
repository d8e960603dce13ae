import random

from skylattice.llm import pieces


def by_brute_force(table, text):
    """Best score of any segmentation, by the plain recursion."""
    text = pieces.SPACE + text.replace(" ", pieces.SPACE)
    score = {p: s for p, (_, s, _) in table.automaton.items()}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            part = text[start:end]
            s = score.get(part, table.penalty if end - start == 1 else float("-inf"))
            best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_best_segmentations():
    table = pieces.pieces(pieces.default_model())
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["the", "ing ", " of", "ñ", "日本", "🎉", "\n", "x1", "  ", "Q", "\x00"]) for _ in range(rng.randrange(1, 9)))
        ids, score = table.encode(text)
        assert score == by_brute_force(table, text)
        assert table.decode(ids) == text


def test_forgetting_changes_nothing(monkeypatch):
    table = pieces.Pieces(pieces.default_model())
    texts = ["the cat sat", "on the mat the", "cat"]
    before = [table.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 1)
    assert [table.encode(t) for t in texts] == before


def test_odd_rows(odd_docs, no_docs):
    rows = pieces.round_trips(odd_docs).collect()
    assert all(r["same"] for r in rows if r["doc_id"] != 8) and len(rows) == odd_docs.count()
    encoded = pieces.encoded(odd_docs)
    assert "text" not in encoded.columns and encoded.columns.count("ids") == 1
    back = pieces.decoded(encoded)
    key = lambda df: sorted((r["doc_id"] or 0, (r["text"] or "").replace(pieces.SPACE, " ")) for r in df.collect())
    assert key(back) == key(odd_docs)
    assert pieces.round_trips(no_docs).count() == 0 and pieces.encoded(no_docs).count() == 0
