import random

from pyspark.sql import functions as F
from skylattice.llm import near_lines

BLANK = " \t\n\x0b\x0c\r"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, line, edits):
    chars = list(line)
    for _ in range(edits):
        k, how = rng.randrange(len(chars)), rng.randrange(3)
        if how == 0:
            chars[k] = rng.choice("abé ")
        elif how == 1:
            del chars[k]
        else:
            chars.insert(k, rng.choice("abé "))
    return "".join(chars)


def documents(rng):
    lines = ["".join(rng.choice("abcé ") for _ in range(rng.choice((10, 24, 25, 40, 60)))) for _ in range(25)]
    lines += [changed(rng, rng.choice(lines[:25]), rng.randrange(1, 4)) for _ in range(60)]
    return [(k, "\n".join(rng.choice([*lines, "", "  "]) for _ in range(rng.randrange(1, 9)))) for k in range(40)]


def by_brute_force(rows):
    first = {}
    for doc, text in sorted(rows):
        for pos, line in enumerate(text.split("\n")):
            if line.strip(BLANK):
                first.setdefault(line, (doc, pos))
    order = sorted(first, key=first.get)
    near = {b for k, b in enumerate(order) for a in order[:k] if min(len(a), len(b)) >= near_lines.LEAST_CHARS and distance(a, b) <= 2}
    return {doc: "\n".join(x for pos, x in enumerate(text.split("\n")) if not x.strip(BLANK) or (first[x] == (doc, pos) and x not in near))
            for doc, text in rows}


def test_lines_by_brute_force(spark):
    rows = documents(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    wanted = {k: t for k, t in by_brute_force(rows).items() if t.strip(BLANK) or t == dict(rows)[k]}
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in near_lines.without_repeated_lines(docs).collect()}
    assert found == {k: (t, len(t)) for k, t in wanted.items()}
    counts = {r["doc_id"]: r for r in near_lines.line_counts(docs).collect()}
    assert sum(r["n_near"] for r in counts.values()) > 5
    assert {k: r["kept_chars"] for k, r in counts.items()} == {k: len(t) for k, t in by_brute_force(rows).items()}


def test_banded_distance(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(14, 70)))
        pairs.append((a, changed(rng, a, rng.randrange(0, 5))))
    df = spark.createDataFrame([p for p in pairs if abs(len(p[0]) - len(p[1])) <= 2], "a string, b string")
    for threshold in (1, 2, 3):
        close = df.filter(F.abs(F.length("a") - F.length("b")) <= threshold)
        wrong = close.filter(near_lines.within_edits(F.col("a"), F.col("b"), threshold) != (F.levenshtein("a", "b") <= threshold))
        assert wrong.count() == 0


def test_crowds_by_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcé ") for _ in range(60))
    lines = [changed(rng, base, rng.randrange(0, 4)) for _ in range(70)] + [base[:30] + "".join(rng.choice("abé") for _ in range(30)) for _ in range(20)]
    lines += [changed(rng, rng.choice(lines), 2) for _ in range(26)]
    lines += [base[:25] + x for x in ("", "a", "bé", "cab")]
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[4 * k:4 * k + 4])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = {k: len(t) for k, t in by_brute_force(rows).items()}
    for crowd in (16, 0):
        monkeypatch.setattr(near_lines, "CROWD", crowd)
        assert {r["doc_id"]: r["kept_chars"] for r in near_lines.line_counts(docs).collect()} == wanted


def test_crowds_do_not_all_meet(spark, monkeypatch):
    """Variants of one line with words of their own, more than the threshold apart, are not compared in pairs."""
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    lines = []
    for _ in range(150):
        own = list(words)
        for k in rng.sample(range(40), 8):
            own[k] = "".join(rng.sample(own[k], 6))  # counts of characters stay
        lines.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").cache()
    compared, verified = [], near_lines._verified
    monkeypatch.setattr(near_lines, "_verified", lambda met, *rest: compared.append(met.distinct().count()) or verified(met, *rest))
    found = {r["doc_id"] for r in near_lines.line_counts(docs).collect() if r["n_near"]}
    pairs = docs.alias("a").join(docs.alias("b"), F.expr("a.doc_id < b.doc_id AND levenshtein(a.text, b.text) <= 2"))
    assert sum(compared) < 150 and found == {r[0] for r in pairs.select("b.doc_id").collect()}


def test_some_rows_are_found_before_others_move(spark, monkeypatch):
    """Of all texts only those with a bit in the map reach the exact join, whatever a join may broadcast by itself."""
    monkeypatch.setattr(near_lines, "MARK_BITS", 17)
    rows = spark.range(0, 20000).selectExpr("id * 7 - 5000 AS lid", "concat('line ', id) AS line").union(
        spark.createDataFrame([(None, "no lid"), (1 << 62, "large")], "lid long, line string"))
    lids = spark.createDataFrame([(k * 7 - 5000,) for k in range(0, 20000, 50)] + [(3,), (None,), (1 << 62,)], "lid long")
    wanted = rows.join(F.broadcast(lids), "lid", "left_semi").collect()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_lines._some(rows, lids)
        assert found.columns == rows.columns and sorted(found.collect()) == sorted(wanted) and len(wanted) == 401
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.index("SortMergeJoin [lid") < plan.index("BroadcastHashJoin [__bucket")  # the exact join comes last
        assert near_lines._some(rows, lids.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_odd_rows(odd_docs, no_docs):
    found = near_lines.without_repeated_lines(odd_docs)
    assert found.schema == odd_docs.schema
    # equal texts in later documents go, repeated rows alike; nulls and blank texts stay
    assert sorted(r["doc_id"] or 0 for r in found.collect()) == [0, 1, 2, 3, 4, 6, 7, 7, 8, 9]
    assert near_lines.line_counts(odd_docs).count() == odd_docs.count()
    assert near_lines.line_counts(no_docs).count() == 0 and near_lines.without_repeated_lines(no_docs).count() == 0


def test_no_side_of_a_join_goes_to_the_driver(spark, monkeypatch):
    """A file of lines in a crowd is small, their keys are not: only maps of the lines asked for, of fixed size, are broadcast."""
    rng = random.Random(9)
    lines = ["one beginning that all of the lines share " + "".join(rng.choices("abcdefgh", k=20)) for _ in range(120)]
    lines += [changed(rng, x, 1) for x in lines[:20]]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    joins, write = [], near_lines.settled

    def planned(df):
        return [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x]

    def noted(df, name):
        joins.extend(planned(df))
        return write(df, name)

    monkeypatch.setattr(near_lines, "settled", noted)
    counts = near_lines.line_counts(docs)
    joins.extend(planned(counts))
    assert sum(r["n_near"] for r in counts.collect()) == 20
    broadcast = [x for x in joins if "Broadcast" in x]
    assert broadcast and len(joins) > 10 and all("__bucket" in x for x in broadcast)
