"""Embedding near-dedup by hierarchical navigable small-world graphs.

Equal vectors form one class.  Classes are dealt to shards by hash; each shard builds a layered graph of its own, inserting
points in batches whose beam searches run side by side in numpy.  Every class then asks every shard: a beam search that is
widened for those whose whole beam is near, and for all of a block until an audit passes: for some queries of the block
the links are computed exactly, and the mean share found, over queries that have links with others, must reach ``RECALL``.
The audit goes on until it holds ``ENOUGH`` such queries.  A block without so many, or whose audit fails up to beams that
cost more than that, is compared with the whole shard exactly.  What is found is verified in double precision.

Tasks return a count for each query and, of the links, only those that join parts not joined in that task before, so that
a large group of copies gives as many links as it has members.  Components come from these.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link; rows without vec_id count as vectors, and have no component of their own; equal rows link
like other equal vectors.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .components import components

COSINE = 0.9
SHARDS, SHARD_ROWS = 8, 25_000  #: least number of shards, most classes in one
BLOCK, MOST_ASKED = 16_384, 32_768  #: queries a task asks one shard, where there are few blocks and where there are more than FEW_BLOCKS
FEW_BLOCKS = 8
WIDE = 64  #: vectors with more components than these are fewer in a shard and in a block
AT_ONCE = 8_000_000  #: pairs of queries and points looked at at once
LINKS = 16  #: neighbours of a point in a layer; twice as many in the lowest
BUILD_BEAM, BEAM = 64, 48
SIDE_BY_SIDE = 512  #: points inserted, or queries asked, at once
AUDITED, RECALL = 256, 0.99
ENOUGH = 100  #: queries with links that an audit must hold
DEAR = 8  #: a beam of one in so many points of a shard costs more than all points in plain blocks
_SLACK = 1e-3  #: single precision is searched with so much lower a limit


def _rows_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _beam(vectors: np.ndarray, near: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest points each query finds in a layer: (ids, similarities), best first, padded with -1.

    ``near`` (points, links) has -1 where there is no neighbour; each query starts at its entry points.
    """
    b, n = len(queries), len(near)
    ids = np.full((b, width), -1, np.int64)
    sims = np.full((b, width), -np.inf, np.float32)
    open_ = np.zeros((b, width), bool)
    seen = np.zeros((b, n), bool)
    rows = np.arange(b)
    first = entry[:, :width]
    for k in range(first.shape[1]):
        fresh = (first[:, k] >= 0) & ~seen[rows, first[:, k]]
        at = rows[fresh]
        ids[at, k] = first[at, k]
        sims[at, k] = _rows_dot(queries[at], vectors[first[at, k]])
        open_[at, k] = True
        seen[at, first[at, k]] = True
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims, open_ = (np.take_along_axis(x, order, 1) for x in (ids, sims, open_))
    at_once = 4
    while True:
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            return ids, sims
        best = np.argsort(~open_[live], 1, kind="stable")[:, :at_once]
        chosen = np.take_along_axis(ids[live], best, 1)
        chosen[~np.take_along_axis(open_[live], best, 1)] = -1
        open_[live[:, None], best] = False
        found = np.where(chosen[:, :, None] >= 0, near[chosen], -1).reshape(len(live), -1)
        r, c = np.nonzero(found >= 0)
        keys = np.unique(live[r] * n + found[r, c])
        r, c = keys // n, keys % n
        fresh = ~seen[r, c]
        r, c = r[fresh], c[fresh]
        if not len(r):
            continue
        seen[r, c] = True
        s = _rows_dot(queries[r], vectors[c])
        better = s > sims[r, -1]
        r, c, s = r[better], c[better], s[better]
        if not len(r):
            continue
        touched, start, count = np.unique(r, return_index=True, return_counts=True)
        place = np.arange(len(r)) - np.repeat(start, count)
        line = np.repeat(np.arange(len(touched)), count)
        more_ids = np.full((len(touched), count.max()), -1, np.int64)
        more_sims = np.full(more_ids.shape, -np.inf, np.float32)
        more_ids[line, place], more_sims[line, place] = c, s
        all_ids = np.concatenate([ids[touched], more_ids], 1)
        all_sims = np.concatenate([sims[touched], more_sims], 1)
        all_open = np.concatenate([open_[touched], more_ids >= 0], 1)
        order = np.argsort(-all_sims, 1, kind="stable")[:, :width]
        ids[touched], sims[touched], open_[touched] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_open))


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) up to ``most``: those nearer to the point than to any chosen before,
    then the nearest of the rest."""
    points = vectors[np.maximum(ids, 0)]
    between = points @ points.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        clash = (chosen & (between[:, k] > sims[:, k, None])).any(1)
        chosen[:, k] = (ids[:, k] >= 0) & ~clash & (chosen.sum(1) < most)
    order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), 1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


@dataclass
class Graph:
    ids: np.ndarray  #: class ids, points of high layers first
    copies: np.ndarray
    exact: np.ndarray  #: unit vectors in double precision
    layers: list[np.ndarray]  #: neighbours, lowest layer first

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, copies=self.copies, exact=self.exact, **{f"layer{k}": x.astype(np.int32) for k, x in enumerate(self.layers)})
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as x:
            return Graph(x["ids"], x["copies"], x["exact"], [x[f"layer{k}"].astype(np.int64) for k in range(len(x.files) - 3)])

    def find(self, vectors: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), np.int64)
        for near in reversed(self.layers[1:]):
            entry, _ = _beam(vectors[:len(near)], near, queries, entry, 4)
        return _beam(vectors, self.layers[0], queries, entry, width)


def build(ids: np.ndarray, copies: np.ndarray, exact: np.ndarray) -> Graph:
    """The graph of unit vectors; levels and order follow from hashes of the class ids."""
    luck = np.array([xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True)) for i in ids], np.float64) / 2.0 ** 64
    level = np.minimum(np.floor(-np.log(np.maximum(luck, 1e-18)) / np.log(LINKS)), 12).astype(int)
    order = np.lexsort((luck, -level))
    ids, copies, exact, level = ids[order], copies[order], exact[order], level[order]
    vectors = exact.astype(np.float32)
    layers: list[np.ndarray] = []  # highest first while building
    for height in range(level[0], -1, -1):
        n, most = int((level >= height).sum()), LINKS * (1 if height else 2)
        near = np.full((n, most), -1, np.int64)
        done = 1
        while done < n:
            stop = min(n, done + min(done, SIDE_BY_SIDE))
            new = np.arange(done, stop)
            entry = np.zeros((len(new), 1), np.int64)
            for above in layers:
                entry, _ = _beam(vectors[:len(above)], above, vectors[new], entry, 4)
            entry = np.where(entry < done, entry, 0)
            found, sims = _beam(vectors[:done], near[:done], vectors[new], entry, BUILD_BEAM)
            own = vectors[new] @ vectors[new].T
            np.fill_diagonal(own, -np.inf)
            k = min(LINKS, len(new) - 1)
            peers = np.argsort(-own, 1, kind="stable")[:, :k]
            found = np.concatenate([found, new[peers] if k else np.empty((len(new), 0), np.int64)], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, peers, 1)], 1)
            best = np.argsort(-sims, 1, kind="stable")
            found, sims = np.take_along_axis(found, best, 1), np.take_along_axis(sims, best, 1)
            near[new, :LINKS] = links = _diverse(vectors, found, sims, LINKS)
            # back links: what a point has, and the best of what came, cut to what it may have
            r, c = np.nonzero(links >= 0)
            to, source = links[r, c], new[r]
            weight = _rows_dot(vectors[to], vectors[source])
            by = np.lexsort((-weight, to))
            to, source = to[by], source[by]
            point, start, count = np.unique(to, return_index=True, return_counts=True)
            place = np.arange(len(to)) - np.repeat(start, count)
            few = place < 2 * most
            line, place, source = np.repeat(np.arange(len(point)), count)[few], place[few], source[few]
            for low in range(0, len(point), SIDE_BY_SIDE):  # a batch can ask for links with many times as many points
                some = point[low:low + SIDE_BY_SIDE]
                own = slice(*np.searchsorted(line, (low, low + len(some))))
                came = np.full((len(some), place[own].max() + 1), -1, np.int64)
                came[line[own] - low, place[own]] = source[own]
                came[(came[:, :, None] == near[some][:, None, :]).any(2)] = -1
                pool = np.concatenate([near[some], came], 1)
                sims = np.where(pool >= 0, np.einsum("ikd,id->ik", vectors[np.maximum(pool, 0)], vectors[some]), -np.inf)
                best = np.argsort(-sims, 1, kind="stable")
                near[some] = _diverse(vectors, np.take_along_axis(pool, best, 1), np.take_along_axis(sims, best, 1), most)
            done = stop
        layers.append(near)
    return Graph(ids, copies, exact, layers[::-1])


def links_in(graph: Graph, queries: np.ndarray, limit: float = COSINE, audited: int = AUDITED,
             own: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the points with a cosine of at least ``limit``, as positions in the graph.

    ``own`` are the class ids of the queries: links with themselves prove nothing in the audit.
    """
    found = dict(each_links(graph, queries, limit, audited, own))
    return [found[k] for k in range(len(queries))]


def each_links(graph: Graph, queries: np.ndarray, limit: float = COSINE, audited: int = AUDITED,
               own: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Number and points (as in ``links_in``) of each query, in any order: of many near copies the links do not fit into memory."""
    vectors, q = graph.exact.astype(np.float32), queries.astype(np.float32)
    n = len(vectors)
    at_once = max(1, min(SIDE_BY_SIDE, AT_ONCE // n))

    def exactly(rows: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(rows), at_once):
            yield from map(np.flatnonzero, queries[rows[at:at + at_once]] @ graph.exact.T >= limit)

    def search(rows: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(rows), at_once):
            part = rows[at:at + at_once]
            ids, sims = graph.find(vectors, q[part], width)
            near = sims >= limit - _SLACK
            full = near.all(1)  # a beam that is near as a whole may have more behind it
            for r, i, k in zip(part[~full].tolist(), ids[~full], near[~full]):
                yield r, i[k]
            if 4 * width * DEAR < n:
                yield from search(part[full], 4 * width)
            else:
                yield from zip(part[full].tolist(), exactly(part[full]))

    def verified(rows: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        for r, ids in search(rows, width):
            yield r, ids[graph.exact[ids] @ queries[r] >= limit]

    order = np.random.default_rng(0).permutation(len(q))
    done, linked = 0, {}
    while done < len(q) and (done < audited or len(linked) < ENOUGH):
        part = order[done:done + audited]
        for k, ids in zip(part.tolist(), exactly(part)):
            others = ids if own is None else ids[graph.ids[ids] != own[k]]
            if len(others):
                linked[k] = others
            yield k, ids
        done += len(part)
    rest, width = order[done:], BEAM
    while len(rest) and width * DEAR < n:
        sample = np.fromiter(linked, np.int64)
        if np.mean([len(np.intersect1d(ids, linked[k])) / len(linked[k]) for k, ids in verified(sample, width)]) >= RECALL:
            yield from verified(rest, width)
            return
        width *= 2
    yield from zip(rest.tolist(), exactly(rest))


def _unit(batch_column: pa.Array) -> np.ndarray:
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(batch_column), -1)
    # scaled first, so that no square overflows or vanishes
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, d1, d2, dim, v): the digests of valid vectors, null for others."""
    for batch in batches:
        d1, d2, dim, values = [], [], [], []
        for x in batch.column("v"):
            v = None if not x.is_valid or not len(x) else np.array([np.nan if c is None else c for c in x.as_py()], np.float64)
            good = v is not None and np.isfinite(v).all() and (v != 0).any()
            v = v + 0.0 if good else None  # no negative zeros
            d1.append(np.uint64(xxhash.xxh3_64_intdigest(v.tobytes())).astype(np.int64) if good else None)
            d2.append(np.uint64(xxhash.xxh64_intdigest(v.tobytes(), 7)).astype(np.int64) if good else None)
            dim.append(len(v) if good else None)
            values.append(v)
        yield pa.RecordBatch.from_arrays([
            batch.column("vec_id"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(dim, pa.int32()),
            pa.array(values, pa.list_(pa.float64()))], names=["vec_id", "d1", "d2", "dim", "v"])


def _built(table: pa.Table) -> pa.Table:
    graph = build(table["cid"].to_numpy(), table["copies"].to_numpy(), _unit(table["v"].combine_chunks()))
    return pa.table({"shard": table["shard"][:1], "dim": table["dim"][:1], "graph": pa.array([graph.packed()], pa.binary())})


def _asked(limit: float):
    def run(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int | None]] = []
        if queries.num_rows and graphs.num_rows:
            graph = Graph.unpacked(graphs["graph"][0].as_py())
            cids = queries["cid"].to_numpy()
            asked = _unit(queries["v"].combine_chunks())
            part: dict[int, int] = {}

            def root(x: int) -> int:
                while part.setdefault(x, x) != x:
                    part[x] = x = part[part[x]]
                return x

            for k, at in each_links(graph, asked, limit, own=cids):
                cid = int(cids[k])
                others = at[graph.ids[at] != cid]
                out.append((cid, int(graph.copies[others].sum()), None))
                for other in graph.ids[others].tolist():
                    a, b = root(cid), root(other)
                    if a != b:
                        part[a] = b
                        out.append((cid, None, other))
        cid, links, other = zip(*out) if out else ((), (), ())
        return pa.table({"cid": pa.array(cid, pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.int64())})
    return run


def near_vectors(vectors: DataFrame, limit: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = settled(vectors.select("vec_id", F.col("embedding").alias("v")).mapInArrow(
        _prepared, "vec_id long, d1 long, d2 long, dim int, v array<double>"), "vectors")
    classes = rows.filter("dim IS NOT NULL").groupBy("d1", "d2", "dim").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = settled(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    wide = max(1.0, (dim or 0) / WIDE)
    shards, blocks = max(SHARDS, math.ceil(n * wide / SHARD_ROWS)), max(
        1, min(FEW_BLOCKS, -(-n // BLOCK)), math.ceil(n * wide / MOST_ASKED))
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int"))
    graphs = settled(placed.select("cid", "copies", "v", "dim", "shard").repartition(shards, "shard", "dim").groupBy("shard", "dim").applyInArrow(
        _built, "shard int, dim int, graph binary"), "graphs")

    def all_of(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asked = classes.select("cid", "v", "dim", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(blocks)).cast("int").alias("block")).withColumn(
        "shard", all_of(shards))
    held = graphs.withColumn("block", all_of(blocks))
    keys = ["shard", "dim", "block"]
    tasks = shards * blocks
    answers = settled(asked.repartition(tasks, *keys).groupBy(*keys).cogroup(held.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(
        _asked(limit), "cid long, links long, other long"), "answers")
    counts = answers.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(answers.filter("other IS NOT NULL").select("cid", "other")).withColumnRenamed("node", "cid")
    parts = classes.select("cid", "d1", "d2", "vec_id", "copies").join(joined, "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    smallest = parts.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    of_class = settled(parts.join(smallest, "part").join(counts, "cid", "left").select(
        F.col("d1").alias("e1"), F.col("d2").alias("e2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id"), "parts")
    found = rows.drop("v").join(of_class, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
