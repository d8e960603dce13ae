"""Suffix-array dedup by longest previous factors.

Every position of a text at which LENGTH bytes begin is a window.  A window goes if the same bytes begin earlier (a smaller
doc_id, or the same document further left); what goes from a text is the union of its windows that go.

The suffixes of all texts are dealt out so that equal windows meet: a window belongs to its anchor, the gram of GRAM bytes
inside it with the smallest hash (the leftmost of equals).  Neighbouring windows share anchors, so a run of windows moves as one
string.  Only anchors that occur again anywhere can have equal windows; counts of grams come first, and only runs of
shared anchors are cut from the texts.  The runs of an anchor form a bucket.  In a bucket, equal runs are dealt with at
once; the windows of the others are put into suffix order with the lengths of common prefixes of neighbours.  Going
from each window to the next one up and down the suffix order that begins earlier in the corpus gives the
longest previous factor, and a window goes if that covers it.  A bucket larger than CHUNK runs is cut into chunks; the windows
that stand in their chunks are then compared across chunks by 128-bit digests, combined before they are shuffled.

Defined results: null texts are empty; empty tables give no row; texts below LENGTH bytes stay; of equal rows (doc_id and
text) one is judged and the others go whole if they have LENGTH bytes; different texts of one doc_id come in the order of
their hashes; rows without doc_id come after all others in that order; very long texts are cut into runs some
megabytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, settled, text_or_empty

LENGTH = 100
GRAM = 40  #: a multiple of 8
CHUNK = 1 << 16  #: runs of a bucket that one task judges together
TOGETHER = 20_000  #: runs of small buckets that are judged at a time
BLOCK = 1 << 17  #: bytes whose grams are hashed at a time
ROWS = 500  #: texts held at a time
LAST = (1 << 63) - 1  #: stands for a missing doc_id

_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# -- anchors ------------------------------------------------------------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as an integer, big end first."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    n = max(0, len(data) - GRAM + 1)
    words = _words(data).astype(np.uint64)
    h = words[:n].copy()
    for at in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h *= _ODD1
        h += words[at:at + n]
    h ^= h >> np.uint64(32)
    h *= _ODD2
    return h ^ (h >> np.uint64(31))


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, first byte, bytes) of texts, long ones in pieces that overlap by a window, some BLOCK bytes together."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for base in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            held.append((row, base, text[base:base + BLOCK + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows and anchor of the runs of windows with one anchor, text by text."""
    span = LENGTH - GRAM + 1
    found = []
    for held in _segments(texts):
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        if len(data) < LENGTH:
            continue
        h = gram_hashes(data)
        least = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[:width - span], least[span - width:])
        anchor = (least & _LOW).astype(np.int64)
        sizes = np.array([len(x) for _, _, x in held])
        ends = np.cumsum(sizes)
        change = np.zeros(len(anchor) + 1, np.int32)  # +1 where a segment's last windows begin to reach beyond it, -1 at its end
        np.add.at(change, np.maximum(ends - LENGTH + 1, ends - sizes).clip(0, len(anchor)), 1)
        np.add.at(change, ends.clip(0, len(anchor)), -1)
        inside = np.cumsum(change[:-1]) == 0
        edge = np.ones(len(anchor), bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(edge)
        windows = np.diff(np.append(first, len(anchor)))
        on = inside[first]
        first, windows = first[on], windows[on]
        segment = np.searchsorted(ends, first, side="right")
        rows, bases = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
        found.append((rows[segment], bases[segment] + first - (ends - sizes)[segment], windows, h[anchor[first]].view(np.int64)))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Some rows at a time, with their texts as bytes."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, times) of the anchors, summed over some texts."""
    for _, texts in _texts(batches):
        grams, times = np.unique(runs(texts)[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(times)], names=["gram", "times"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, id, tag) of each text's distinct anchors."""
    for batch, texts in _texts(batches):
        row, _, _, gram = runs(texts)
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        row, gram = row[new], gram[new]
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("id", "tag"))
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ids), pa.array(tags)], names=["gram", "id", "tag"])


_CUT = pa.schema([("gram", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("id", pa.int64()), ("tag", pa.int64()),
                  ("start", pa.int64()), ("windows", pa.int32()), ("run", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of the shared anchors; a run that equals an earlier one of its text has no bytes: it goes as it is."""
    for batch, texts in _texts(batches):
        row, start, windows, gram = runs(texts)
        limits = np.searchsorted(row, np.arange(len(texts) + 1))
        lists = batch.column("shared")
        chunks = np.zeros(len(row), np.int64)  # 0: not shared
        for i, (a, b) in enumerate(zip(limits[:-1], limits[1:])):
            grams, of_gram = (lists[i].values.field(k).to_numpy() for k in ("gram", "chunks"))
            order = np.argsort(grams)
            place = order[np.searchsorted(grams, gram[a:b], sorter=order).clip(max=len(order) - 1)]
            chunks[a:b] = np.where(grams[place] == gram[a:b], of_gram[place], 0)
        on = chunks > 0
        row, start, windows, gram, chunks = (x[on] for x in (row, start, windows, gram, chunks))
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("id", "tag"))
        spread = (start ^ ids ^ tags).view(np.uint64) * _ODD1 >> np.uint64(33)
        cut: list[bytes | None] = []
        own: set[bytes] = set()
        last = -1
        for i, s, w in zip(row.tolist(), start.tolist(), windows.tolist()):
            if i != last:
                own, last = set(), i
            run = texts[i][s:s + w + LENGTH - 1]
            cut.append(None if run in own else run)
            own.add(run)
        columns = [gram, spread.astype(np.int64) % chunks, chunks, ids, tags, start, windows]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _CUT)] + [pa.array(cut, pa.binary())], schema=_CUT)


# -- suffix order -------------------------------------------------------------------------------------------------

def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bytes two different words share."""
    x = a ^ b
    return sum((x < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at ``starts``, sorted by their first ``length`` bytes (8 at least), and the common prefix of
    each with the one before, up to that length.  Eight bytes a round; only suffixes that are still equal go on."""
    words = _words(data)
    offsets = [*range(0, length - 7, 8)]
    if offsets[-1] + 8 < length:
        offsets.append(length - 8)
    order = np.arange(len(starts))
    common = np.zeros(len(starts), np.int64)
    tied = np.ones(len(starts), bool)  # with the one before
    tied[:1] = False
    on = np.arange(len(starts))
    for offset in offsets:
        if not len(on):
            break
        word = words[starts[order[on]] + offset].astype(np.uint64)
        sorted_ = np.lexsort((word, np.cumsum(~tied[on])))
        order[on], word = order[on][sorted_], word[sorted_]
        before = np.concatenate([word[:1], word[:-1]])
        parted = tied[on] & (word != before)
        common[on[parted]] = offset + _equal_bytes(word[parted], before[parted])
        tied[on[parted]] = False
        still = tied[on] | np.append(tied[on][1:], False)
        on = on[still]
    common[tied] = length
    return order, common


def _earlier(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it in suffix order that begins earlier in the corpus."""
    n = len(position)
    position, least = np.append(position, -1), np.append(common, 0)  # the last one ends every search
    to = np.append(np.arange(-1, n - 1), n)
    to[:1] = n
    on = np.flatnonzero(position[to[:n]] > position[:n])
    while len(on):  # jumps double, as those jumped to have jumped as well
        over = to[on]
        least[on], to[on] = np.minimum(least[on], least[over]), to[over]
        on = on[position[to[on]] > position[on]]
    least[to == n] = 0
    return least[:n]


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, how many of its first ``length`` bytes begin earlier as well; ``position`` tells what is earlier."""
    order, common = suffix_order(data, starts, length)
    ranked = position[order]
    up = _earlier(ranked, common)
    down = _earlier(ranked[::-1], np.append(common[1:], 0)[::-1])[::-1]
    found = np.empty(len(starts), np.int64)
    found[order] = np.maximum(up, down)
    return found


# -- buckets ------------------------------------------------------------------------------------------------------

_JUDGED = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary())])


def _judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """What goes of the runs of whole buckets or chunks, and the windows that stand in a chunk, with their digests."""
    field = {k: rows[k].to_numpy() for k in ("gram", "chunks", "id", "tag", "start", "windows")}
    order = np.lexsort([field[k] for k in ("start", "tag", "id", "gram")])
    gram, chunks, ids, tags, start, windows = (x[order] for x in field.values())
    run = rows["run"].take(pa.array(order)).to_pylist()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row, first and last window
    again = np.zeros(len(run), bool)  # the row of a repeated input row
    again[1:] = (ids[1:] == ids[:-1]) & (tags[1:] == tags[:-1]) & (start[1:] == start[:-1])
    seen: set[bytes] = set()
    first = np.zeros(len(run), bool)
    for i, r in enumerate(run):
        if r is not None and not again[i] and r not in seen:
            seen.add(r)
            first[i] = True
    whole = np.flatnonzero(~first & ~again)
    out.append((whole, np.zeros(len(whole), np.int64), windows[whole].astype(np.int64) - 1))
    kept = np.flatnonzero(first)
    bucket = np.cumsum(np.concatenate([[False], gram[kept][1:] != gram[kept][:-1]])[:len(kept)])
    several = kept[np.bincount(bucket, minlength=1)[bucket] > 1] if len(kept) else kept
    alone = np.setdiff1d(kept[chunks[kept] > 1], several)
    stand = [(alone, np.zeros(len(alone), np.int64), windows[alone].astype(np.int64))]
    if len(several):
        data = np.frombuffer(b"".join(run[i] for i in several.tolist()), np.uint8)
        n = windows[several].astype(np.int64)
        base = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]])
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(len(several)), n)
        rank = np.empty(len(several), np.int64)  # runs in the order of the corpus, their windows in a row
        in_corpus = np.lexsort([start[several], tags[several], ids[several]])
        rank[in_corpus] = np.concatenate([[0], np.cumsum(n[in_corpus])[:-1]])
        goes = longest_previous_factors(data, base[of] + inside, rank[of] + inside, LENGTH) >= LENGTH
        edge = np.flatnonzero(np.concatenate([[True], (goes[1:] != goes[:-1]) | (of[1:] != of[:-1])]))
        last = np.append(edge[1:], len(goes)) - 1
        gone = goes[edge]
        out.append((several[of[edge[gone]]], inside[edge[gone]], inside[last[gone]]))
        left = ~gone & (chunks[several[of[edge]]] > 1)
        stand.append((several[of[edge[left]]], inside[edge[left]], inside[last[left]] + 1))
    row, low, high = (np.concatenate(x) for x in zip(*out))
    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(tags[row]), pa.array(start[row] + low),
                                      pa.array(start[row] + high + LENGTH), pa.nulls(len(row), pa.binary())], schema=_JUDGED)
    for row, low, high in zip(*(np.concatenate(x).tolist() for x in zip(*stand))):
        at = np.arange(low, high)
        digests = [xxhash.xxh3_128_digest(run[row][k:k + LENGTH]) for k in at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[row])), pa.array(np.full(len(at), tags[row])), pa.array(start[row] + at),
                                          pa.array(start[row] + at + LENGTH), pa.array(digests, pa.binary())], schema=_JUDGED)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges sorted rows bucket by bucket, small buckets together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            rows = pa.Table.from_batches(held)
            gram, chunk = rows["gram"].to_numpy(), rows["chunk"].to_numpy()
            same = (gram == gram[-1]) & (chunk == chunk[-1])  # the last bucket may go on
            ends = int(np.argmax(same))
            if ends:
                yield from _judge(rows.slice(0, ends))
            held = rows.slice(ends).combine_chunks().to_batches()
    if held:
        yield from _judge(pa.Table.from_batches(held))


# -- texts --------------------------------------------------------------------------------------------------------

def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals; touching ones are one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch, texts in _texts(batches):
        removed, spans, shas = [], [], []
        for text, intervals in zip(texts, batch.column("gone")):
            start, end = merged(*(intervals.values.field(k).to_numpy() for k in ("start", "end")))
            digest, at = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), end.tolist()):
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            removed.append(int((end - start).sum()))
            spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
            shas.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(removed, pa.int64()), pa.array(spans, pairs), pa.array(shas)],
                                         names=["id", "tag", "n_removed", "spans", "kept_sha256"])


def _identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("second"), text).alias("d2")]


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first byte, byte after the last) of each row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keys = settled(texts.select("doc_id", *_identity(F.col("text")), F.octet_length("text").cast("long").alias("n_bytes"),
                                F.sha2("text", 256).alias("sha")), "keys")
    rows = keys.groupBy("doc_id", "d1", "d2").agg(
        F.count(F.lit(1)).alias("rows"), F.first("n_bytes").alias("n_bytes"), F.first("sha").alias("sha"))
    most = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"), F.max("rows").alias("rows")).agg(F.max("texts"), F.max("rows")).first()
    # a text is named by its doc_id, and by its hash where doc_ids repeat
    named = [F.coalesce("doc_id", F.lit(LAST)).alias("id"), (F.lit(0).cast("long") if (most[0] or 0) <= 1 else F.xxhash64("text")).alias("tag")]
    long_ones = texts.filter(F.octet_length("text") >= LENGTH).select(*named, "text")
    if (most[1] or 0) > 1:
        long_ones = long_ones.dropDuplicates(["id", "tag"])
    counted = long_ones.select("text").mapInArrow(_grams, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    shared = settled(counted.filter("times > 1").select("gram", F.ceil(F.col("times") / CHUNK).cast("int").alias("chunks")), "shared")
    release(spark)
    posted = long_ones.mapInArrow(_posted, "gram long, id long, tag long").join(shared, "gram")
    found = settled(posted.groupBy("id", "tag").agg(F.collect_list(F.struct("gram", "chunks")).alias("shared")), "found")
    release(spark)
    cut = long_ones.join(found.hint("shuffle_hash"), ["id", "tag"]).mapInArrow(
        _cut, "gram long, chunk int, chunks int, id long, tag long, start long, windows int, run binary")
    judged = settled(cut.repartition(parts, "gram", "chunk").sortWithinPartitions("gram", "chunk").mapInArrow(
        _judged, "id long, tag long, start long, end long, digest binary"), "judged")
    release(spark)
    standing = judged.filter("digest IS NOT NULL")  # windows of chunked buckets
    place = F.struct("id", "tag", "start")
    earliest = standing.groupBy("digest").agg(F.min(place).alias("first"))
    across = standing.join(earliest, "digest").filter(place > F.col("first")).select("id", "tag", "start", "end")
    gone = judged.filter("digest IS NULL").select("id", "tag", "start", "end").unionByName(across).groupBy("id", "tag").agg(
        F.collect_list(F.struct("start", "end")).alias("gone"))
    gone = settled(gone, "gone")
    release(spark)
    judged_texts = long_ones.join(gone.hint("shuffle_hash"), ["id", "tag"]).mapInArrow(
        _spans, "id long, tag long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string")
    tag = F.lit(0).cast("long") if (most[0] or 0) <= 1 else F.col("d1")
    named_rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(LAST)), "tag": tag})
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start: long, end: long>>")
    copy = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    each = named_rows.join(judged_texts, ["id", "tag"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    return removals(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
