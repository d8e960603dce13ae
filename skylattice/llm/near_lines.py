"""Line dedup: an edit join on segments.

Lines within ``threshold`` edits of each other, cut into threshold + 1 segments, have one segment in common at nearly the
same place.  Each distinct line therefore posts its segments under its length, and probes the index for its own length and
the lengths up to ``threshold`` below with the substrings at which a common segment can lie (the windows in which the edits
left and right of the segment still add up to the threshold).  Pairs that meet and whose counts of some characters differ by
no more than the edits allow (many variants of one line meet, few of them are that alike) are verified by a banded bit-parallel edit
distance: the 2 threshold + 1 diagonals around the main one are bits of one number, and each character of a line moves
all of them on by a few operations on it.

Lines of which many have a segment in common (variants of one line, lines with one beginning) do not all meet: they are cut
into eight segments, and meet if they agree outside two of them, which two edits cannot avoid.  There each is compared with
the earliest first, and two lines no more if the later one is settled by that.

A line goes if an equal one stands before it, or one within the threshold; before means smaller (doc_id, line number), rows
without doc_id last.  Blank lines (no word) stay, and lines shorter than ``least_chars`` count as near to equal ones only.
Rows of one doc_id count as one document, repeated rows lose the same lines.  Null and empty texts stay as they are.

Everything is DataFrame operations on whole lines; distinct lines are found with counts combined on the map side, so a
line that stands everywhere takes part in the join once.  Sides of joins are sorted, never sent to the driver to be broadcast: how
much a line's keys or texts take says nothing of the size of the file Spark would judge them by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bound, release, row_key, settled

THRESHOLD = 2
LEAST_CHARS = 24
#: characters whose counts are compared before two lines are; any choice gives the same result
COUNTED = "ethnaso"
CROWD = 64  #: more lines than these under one key meet by finer keys
FINE = 8  #: segments of the finer keys
MARK_BITS = 24  #: size of the map of the lines asked for


def _place(doc_id: str, pos: str) -> Column:
    """One number that orders lines by document and place; rows without doc_id come last."""
    doc = F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)"))
    return (doc * F.lit("2147483648").cast("decimal(10,0)") + F.col(pos)).cast("decimal(38,0)")


def lines(docs: DataFrame) -> DataFrame:
    """(__k1, __k2, pos, line, place) of every line that has a word; the first two stand for its row's doc_id and text."""
    k1, k2 = row_key("doc_id", "text")
    each = docs.select("doc_id", k1.alias("__k1"), k2.alias("__k2"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return each.filter(F.length(F.btrim("line", F.lit(SPACE_CHARS))) > 0).withColumn(
        "place", _place("doc_id", "pos")).drop("doc_id")


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of a line: all about equal, the later ones the longer."""
    short = F.floor(length / parts).cast("int")
    longer = F.pmod(length, F.lit(parts))  # so many last segments have one character more
    before = F.greatest(F.lit(0), i - (parts - longer))
    return (short * i + before + 1).cast("int"), (short + F.when(i >= parts - longer, 1).otherwise(0)).cast("int")


def _posted(line: str, length: str, threshold: int) -> Column:
    n = F.col(length)
    keys = []
    for i in range(threshold + 1):
        start, size = _segment(n, i, threshold + 1)
        keys.append(F.xxhash64(n, F.lit(i), F.substring(line, start, size)))
    return F.array(*keys)


def _probes(line: str, length: str, threshold: int) -> Column:
    keys = []
    for less in range(threshold + 1):
        n = F.col(length) - less
        for i in range(threshold + 1):
            start, size = _segment(n, i, threshold + 1)
            rest = threshold - i
            for shift in range(max(-i, less - rest), min(i, less + rest) + 1):
                keys.append(F.xxhash64(n, F.lit(i), F.substring(line, start + shift, size)))
    return F.array(*keys)


def _keys(of, threshold: int) -> Column:
    """Keys of a line (columns line, bytes, n_chars): where each character is one byte, cut from the bytes, which is faster."""
    return F.when(F.length("bytes") == F.col("n_chars"), of("bytes", "n_chars", threshold)).otherwise(of("line", "n_chars", threshold))


KEPT = 8  #: equal characters left on either side of the part that differs


def _cores(a: Column, b: Column) -> Column:
    """Both strings (a, b) without most of what they have in common at either end, which changes no distance."""
    steps = F.array(*(F.lit(1 << k) for k in range(12, -1, -1)))

    def common(x: Column, y: Column, back: bool) -> Column:
        def step(n: Column, by: Column) -> Column:
            def piece(s: Column) -> Column:
                return F.substring(s, -(n + by), by) if back else F.substring(s, n + 1, by)

            return F.when((n + by <= F.least(F.length(x), F.length(y))) & (piece(x) == piece(y)), n + by).otherwise(n)

        return F.aggregate(steps, F.lit(0), step)

    def tails(p: Column) -> Column:
        cut = F.greatest(p - KEPT, F.lit(0))
        rest = F.struct(F.substring(a, p + 1, F.length(a)).alias("x"), F.substring(b, p + 1, F.length(b)).alias("y"))
        return bound(bound(rest, lambda r: F.greatest(common(r["x"], r["y"], True) - KEPT, F.lit(0))), lambda q: F.struct(
            F.substring(a, cut + 1, F.length(a) - cut - q).alias("a"), F.substring(b, cut + 1, F.length(b) - cut - q).alias("b")))

    return bound(common(a, b, False), tails)


def within_edits(a: Column, b: Column, threshold: int) -> Column:
    """Whether two strings of some length (more than twice the threshold and KEPT) are at most so many edits apart.

    Bit k of the band in column j (a character of b) stands for row j - threshold + k (of a).  The distance is followed
    down the lowest diagonal until it meets the last row, and then along that row.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    top = 1 << (width - 1)

    def both(x: Column, y: Column) -> Column:
        return x.bitwiseAND(y)

    def run(pair: Column) -> Column:
        ca, cb = pair["a"], pair["b"]
        m = F.size(ca)

        def step(state: Column, at: Column) -> Column:
            c, j = at["c"], at["j"]  # j counts from 1
            match = sum(((F.when(F.get(ca, j - 1 - threshold + k) == c, 1 << k).otherwise(0)) for k in range(width)), F.lit(0))

            def columns(x: Column) -> Column:
                p, vp, vn = x["m"], x["p"], x["n"]
                d0 = both((both(p, vp) + vp).bitwiseXOR(vp).bitwiseOR(p).bitwiseOR(vn), F.lit(mask))
                return F.struct(d0.alias("d"), vp.alias("p"), vn.alias("n"))

            def rows(x: Column) -> Column:
                hp = x["n"].bitwiseOR(F.lit(mask).bitwiseXOR(x["d"].bitwiseOR(x["p"])))
                return F.struct(x["d"].alias("d"), hp.alias("hp"), both(x["d"], x["p"]).alias("hn"))

            def moved(x: Column) -> Column:
                down = F.shiftright(x["d"], 1)
                bit = F.pow(F.lit(2.0), m - j + threshold).cast("int")
                last = F.when(both(x["hp"], bit) > 0, 1).when(both(x["hn"], bit) > 0, -1).otherwise(0)
                grown = F.when(j <= m - threshold, F.when(both(x["d"], F.lit(top)) > 0, 0).otherwise(1)).otherwise(last)
                return F.struct(
                    x["hn"].bitwiseOR(F.lit(mask).bitwiseXOR(both(down.bitwiseOR(x["hp"]), F.lit(mask)))).alias("p"),
                    both(down, x["hp"]).alias("n"), (state["e"] + grown).cast("int").alias("e"))

            first = F.struct(match.cast("int").alias("m"), state["p"].alias("p"), state["n"].alias("n"))
            # the diagonal only grows, and the last row can take no more than its length off it
            return F.when(state["e"] > 3 * threshold, state).otherwise(bound(bound(bound(first, columns), rows), moved))

        start = F.struct(F.lit(mask ^ ((1 << threshold) - 1)).alias("p"), F.lit(0).alias("n"), F.lit(threshold).alias("e"))
        return F.aggregate(F.transform(cb, lambda c, j: F.struct(c.alias("c"), (j + 1).alias("j"))), start, step)["e"] <= threshold

    return bound(_cores(a, b), lambda c: bound(F.struct(F.split(c["a"], "").alias("a"), F.split(c["b"], "").alias("b")), run))


def _counts(line: str, length: str) -> Column:
    """The length and the counts of some characters, each modulo 16, in one number."""
    parts = [F.col(length), *(F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(c), F.lit(""))) for c in COUNTED)]
    return sum((F.shiftleft(F.pmod(p, F.lit(16)).cast("long"), 4 * k) for k, p in enumerate(parts)), F.lit(0).cast("long"))


def _may_be_near(a: Column, b: Column, threshold: int) -> tuple[Column, Column]:
    """By how much a line is longer, and whether the counts differ by no more than the edits can change them: a
    replacement changes two counts by one, an insertion one."""
    def part(x: Column, k: int) -> Column:
        return F.shiftright(x, 4 * k).bitwiseAND(F.lit(15))

    longer = F.pmod(part(a, 0) - part(b, 0), F.lit(16))
    apart = F.lit(0)
    for k in range(1, len(COUNTED) + 1):
        d = F.abs(part(a, k) - part(b, k))
        apart = apart + F.least(d, 16 - d)
    return longer, apart + longer <= 2 * threshold


def _fine_keys(probing: bool) -> Column:
    """(key) for every two of FINE segments: what is left of the line without them, under its length and their numbers.

    A probing line may be longer by up to two; the edits can lie in the two segments left out in no other way than
    ``moves`` lists (by how much each of them is longer)."""
    n = F.col("n_chars")
    moves = [(x, y) for x in range(-1, 3) for y in range(-1, 3) if 0 <= x + y and abs(x) + abs(y) <= 2] if probing else [(0, 0)]
    ways = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip("ijxy", (i, j, x, y))))
                     for i in range(FINE) for j in range(i + 1, FINE) for x, y in moves))

    def key(w: Column) -> Column:
        def ends(k: Column, length: Column) -> tuple[Column, Column]:
            """How many characters stand before segment k, and up to its end."""
            short, longer = F.floor(length / FINE).cast("int"), F.pmod(length, F.lit(FINE))
            before = short * k + F.greatest(F.lit(0), k - (FINE - longer))
            return before, before + short + F.when(k >= FINE - longer, 1).otherwise(0)

        length = n - w["x"] - w["y"]  # of the posted line
        (a, b), (c, d) = ends(w["i"], length), ends(w["j"], length)
        b, c, d = b + w["x"], c + w["x"], d + w["x"] + w["y"]
        rest = [F.substring("line", F.lit(1), a), F.substring("line", b + 1, c - b), F.substring("line", d + 1, n - d)]
        return F.xxhash64(length, w["i"], w["j"], *rest)

    return F.explode(F.transform(ways, key)).alias("key")


def _some(rows: DataFrame, lids: DataFrame) -> DataFrame:
    """The rows (with lid) whose lid is among ``lids``.

    Lids are hashed to the bits of a map of fixed size that every task gets, so that of all rows only those with a bit,
    few where few are asked for, move to the exact join.  That is no semi join, which Spark would make before the other.
    """
    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("__h", F.pmod(F.xxhash64("lid"), F.lit(1 << MARK_BITS)))

    bucket, bit = F.shiftright("__h", 15), F.col("__h").bitwiseAND(F.lit(32767))  # as many bits as Spark's bitmaps have
    marks = hashed(lids.select("lid")).groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(bit).alias("__marks"))
    byte = F.conv(F.hex(F.substring("__marks", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = hashed(rows).withColumn("__bucket", bucket).join(F.broadcast(marks), "__bucket").filter(
        F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return marked.join(lids.select("lid").distinct().hint("merge"), "lid").select(*rows.columns)


def _verified(met: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of lid in ``met`` that are within the threshold, with their places (fa, fb); ``texts`` has lid, line
    and first."""
    met = settled(met.select("a", "b").distinct(), "met")
    release(met.sparkSession)
    # the few lines that met, so that other texts do not move
    some = met.select(F.col("a").alias("lid")).union(met.select("b")).distinct()
    texts = settled(_some(texts.select("lid", "line", "first"), some), "texts")
    release(met.sparkSession)
    both = met.join(texts.toDF("a", "la", "fa").hint("merge"), "a").join(texts.toDF("b", "lb", "fb").hint("merge"), "b")
    return both.filter(within_edits(F.col("la"), F.col("lb"), threshold)).select("a", "b", "fa", "fb")


def _later(pairs: DataFrame) -> DataFrame:
    """lid of the line of each pair that has the larger place."""
    return pairs.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("lid")).distinct()


def _near_in_crowds(crowd: DataFrame, threshold: int) -> DataFrame:
    """lid of the lines (lid, first, line, n_chars, counts) that are near to an earlier one of them.

    First each line is compared with the earliest line under each of its keys; the later of two near lines is settled,
    and only pairs that would settle another line are compared after that.
    """
    def keyed(df: DataFrame, probing: bool, more: tuple[str, ...]) -> DataFrame:
        at = "a" if probing else "b"
        columns = [F.col(c).alias(c[0] + at) for c in ("counts", *more)]
        return df.select(_fine_keys(probing), F.col("lid").alias(at), *columns)

    longer, alike = _may_be_near(F.col("ca"), F.col("cb"), threshold)
    earliest = keyed(crowd, False, ("first",)).groupBy("key").agg(F.min(F.struct("fb", "b", "cb")).alias("e")).select("key", "e.b", "e.cb")
    first = keyed(crowd, True, ()).join(earliest.hint("merge"), "key").filter((F.col("a") != F.col("b")) & alike)
    swap = (longer == 0) & (F.col("a") < F.col("b"))  # of two lines of one length the one with the larger lid is a
    first = first.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    marked = settled(_later(_verified(first, crowd, threshold)), "marked")
    release(crowd.sparkSession)
    flagged = settled(crowd.join(marked.withColumn("marked", F.lit(True)).hint("merge"), "lid", "left").withColumn(
        "marked", F.coalesce("marked", F.lit(False))), "flagged")
    probe, index = (keyed(flagged, p, ("first", "marked")) for p in (True, False))
    settles = ~F.when(F.col("fa") > F.col("fb"), F.col("ma")).otherwise(F.col("mb"))
    rest = probe.join(index.hint("merge"), (probe["key"] == index["key"]) & ((longer > 0) | (F.col("a") > F.col("b"))) & alike & settles)
    return marked.union(_later(_verified(rest, crowd, threshold))).distinct()


def near_lines(distinct: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """lid of the lines within the threshold of an earlier one; ``distinct`` has lid, first, line, n_chars and counts.

    Under a key with more than CROWD posted lines, lines meet one of them only, which tells that they are in a crowd;
    crowds meet by finer keys.
    """
    long = distinct.filter(F.col("n_chars") >= max(least_chars, 2 * threshold + 1)).withColumn("bytes", F.col("line").cast("binary"))
    index = long.select(F.explode(_keys(_posted, threshold)).alias("key"), F.col("lid").alias("b"), F.col("counts").alias("cb"))
    probe = long.select(F.explode(_keys(_probes, threshold)).alias("key"), F.col("lid").alias("a"), F.col("counts").alias("ca"))
    if threshold <= 2 <= FINE <= least_chars:  # what the finer keys are made for
        same = Window.partitionBy("key")
        index = index.withColumns({"crowded": F.count(F.lit(1)).over(same) > CROWD, "least": F.min("b").over(same)}).filter(
            ~F.col("crowded") | (F.col("b") == F.col("least"))).drop("least")
    else:
        index = index.withColumn("crowded", F.lit(False))
    longer, alike = _may_be_near(F.col("ca"), F.col("cb"), threshold)
    met = probe.join(index.hint("shuffle_hash"), (probe["key"] == index["key"]) & (
        F.col("crowded") | (((longer > 0) | (F.col("a") > F.col("b"))) & alike)))
    met = settled(met.select("a", F.when(~F.col("crowded"), F.col("b")).alias("b")).distinct(), "meeting")
    release(distinct.sparkSession)
    near = settled(_later(_verified(met.filter("b IS NOT NULL"), distinct, threshold)), "near")
    release(distinct.sparkSession)
    crowd = settled(_some(distinct, met.filter("b IS NULL").select(F.col("a").alias("lid"))), "crowd")
    release(distinct.sparkSession)
    near = settled(near.union(_near_in_crowds(crowd, threshold)).distinct(), "near")
    release(distinct.sparkSession)
    return near


def dropped_lines(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(__k1, __k2, pos, equal) of each line that goes: equal tells an equal earlier line from a near one."""
    every = lines(docs.select("doc_id", "text"))
    distinct = settled(every.groupBy("line").agg(F.min("place").alias("first")).withColumns({
        "lid": F.monotonically_increasing_id(), "n_chars": F.length("line")}).withColumn("counts", _counts("line", "n_chars")), "lines")
    release(docs.sparkSession)
    near = near_lines(distinct, threshold, least_chars)
    h1, h2 = row_key("line")
    judged = distinct.join(near.withColumn("near", F.lit(True)).hint("merge"), "lid", "left").select(
        h1.alias("h1"), h2.alias("h2"), "first", F.coalesce("near", F.lit(False)).alias("near"))
    at = every.select("__k1", "__k2", "pos", "place", h1.alias("h1"), h2.alias("h2")).join(
        settled(judged, "judged").hint("merge"), ["h1", "h2"])
    equal = F.col("place") > F.col("first")
    return at.filter(equal | F.col("near")).select("__k1", "__k2", "pos", equal.alias("equal"))


def _marked(docs: DataFrame, threshold: int, least_chars: int) -> DataFrame:
    """``docs`` with __gone (numbers of the lines that go, null: none), __n_equal and __n_near."""
    gone = dropped_lines(docs, threshold, least_chars).dropDuplicates(["__k1", "__k2", "pos"]).groupBy("__k1", "__k2").agg(
        F.collect_list("pos").alias("__gone"), F.sum(F.col("equal").cast("long")).alias("__n_equal"),
        F.sum((~F.col("equal")).cast("long")).alias("__n_near"))
    k1, k2 = row_key("doc_id", "text")
    return docs.withColumns({"__k1": k1, "__k2": k2}).join(gone.hint("merge"), ["__k1", "__k2"], "left").drop("__k1", "__k2")


def _rest(text: str, gone: str) -> Column:
    """The text without the lines of these numbers."""
    def left(t: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(t) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda i: F.get(t, i)), "\n")

    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(bound(F.split(text, "\n", -1), left))


def line_counts(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (with a word), n_equal and n_near (that go), kept_chars (of what stays)."""
    has_word = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    return _marked(docs.select("doc_id", "text"), threshold, least_chars).select(
        "doc_id", F.size(has_word).cast("long").alias("n_lines"), F.coalesce("__n_equal", F.lit(0)).alias("n_equal"),
        F.coalesce("__n_near", F.lit(0)).alias("n_near"),
        F.coalesce(F.length(_rest("text", "__gone")), F.lit(0)).cast("long").alias("kept_chars"))


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the lines gone and n_chars (if there is one) counted anew; documents left without a word go with them."""
    marked = _marked(docs, threshold, least_chars).withColumn("__rest", _rest("text", "__gone"))
    marked = marked.filter(F.col("__gone").isNull() | (F.length(F.btrim("__rest", F.lit(SPACE_CHARS))) > 0))
    new = {"text": F.col("__rest")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__rest").cast(kind))
    return marked.withColumns(new).select(*docs.columns)
