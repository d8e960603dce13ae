"""Embedding whitening by Jacobi-Davidson on distributed centred products.

Entries become integers; their sums and squared deviations are exact.  The leading eigenvectors of the covariance come from a
block Jacobi-Davidson iteration that never holds the covariance: the matrix is only multiplied, and each product is one pass
of Spark over the centred rows, (1/n) C^T (C u), summed in tasks, then over groups of tasks, then in the order of the groups.
Search directions come from correction equations, projected against what is locked and the current Ritz vectors and solved
by a few MINRES steps; all equations of a round share each step's pass.  Rayleigh-Ritz on the subspace gives the
next vectors; pairs whose residual has reached double precision are locked from the largest eigenvalue on, until all
wanted ones are.

Rows are packed once into blocks of integers in the shared folder; a pass reads those and returns a few vectors a task.

Defined results: rows whose vector is null, empty or holds null or non-finite entries have no result, nor have rows whose
vector is not as long as most (of equally frequent lengths the longest); entries beyond +-10^9 are taken as +-10^9;
repeated rows and rows without vec_id count each; components whose eigenvalue is zero to double precision are left out (whitening would
divide by zero), so a single row or equal rows give no row; equal eigenvalues give some basis of their space;
a deviation beyond 64 bits is null in ``whitened`` (``Whitening.rows`` has it as a decimal); empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 1e9  #: entries are held within this, so that sums of any number of rows that fits a long stay exact
ROWS_A_BLOCK = 2048
GUARD = 8  #: Ritz vectors beyond the wanted ones that corrections are projected against
INNER_STEPS = 2
SUBSPACE = 96
ROUNDS = 200
PARTS = 32  #: partial sums that reach the driver


# -- rows ---------------------------------------------------------------------------------------------------------

_BLOCK = pa.schema([("n", pa.int32()), ("d", pa.int32()), ("ids", pa.binary()), ("known", pa.binary()), ("x", pa.binary())])


def _packed(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BLOCK):
                batch = whole.slice(at, ROWS_A_BLOCK)
                c = batch.column("c").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(SCALE * np.clip(c, -LARGEST, LARGEST)).astype(np.int64) + SHIFT
                ids = batch.column("vec_id")
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.num_rows], pa.int32()), pa.array([d], pa.int32()),
                    pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                    pa.array([ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                    pa.array([x.astype("<i8").tobytes()], pa.binary())], schema=_BLOCK)
    return run


def packed(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows that count as blocks of integers, and their number of entries (0 if there is no row)."""
    c = F.col("embedding").cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).filter(
        F.col("c").isNotNull() & (F.size("c") > 0) & ~F.exists("c", odd))
    lengths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "n int, d int, ids binary, known binary, x binary"), 0
    d = lengths["d"]
    blocks = rows.filter(F.size("c") == d).mapInArrow(_packed(d), "n int, d int, ids binary, known binary, x binary")
    return settled(blocks, "blocks"), d


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for n, d, ids, known, x in zip(*(batch.column(c) for c in ("n", "d", "ids", "known", "x"))):
            yield (np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(known.as_py(), np.uint8).astype(bool),
                   np.frombuffer(x.as_py(), "<i8").reshape(n.as_py(), d.as_py()))


_SUMS = pa.schema([("part", pa.int32()), ("sums", pa.binary())])


def summed(blocks: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], shape: tuple, dtype=np.float64,
           many_tasks: bool = True) -> np.ndarray:
    """The sum of ``of_block(x)`` over all blocks: within tasks, then, if those are many, over PARTS groups of tasks, then
    here; the order of additions depends on the files only."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape, dtype)
        for _, _, x in _integers(batches):
            total += of_block(x)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_SUMS)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros(shape, dtype), None
        for batch in batches:
            for number, sums in zip(batch.column("part").to_pylist(), batch.column("sums")):
                total += np.frombuffer(sums.as_py(), dtype).reshape(shape)
                least = number if least is None else least
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_SUMS)

    found = blocks.mapInArrow(part, "part int, sums binary")
    if many_tasks:
        found = found.repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(merged, "part int, sums binary")
    total = np.zeros(shape, dtype)
    for _, sums in sorted((r["part"], bytes(r["sums"])) for r in found.collect()):
        total += np.frombuffer(sums, dtype).reshape(shape)
    return total


# -- eigenvectors -------------------------------------------------------------------------------------------------

def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The directions of ``new`` that the given orthonormal columns do not span, as orthonormal columns."""
    out = np.zeros((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):  # repeated until rounding leaves nothing
            for q in (*against, out):
                v = v - q @ (q.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-8:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def corrections(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - q q^T) (A - theta I) (I - q q^T) t = -residual by MINRES, one equation a column; the
    equations share each step's product."""
    def inside(v: np.ndarray) -> np.ndarray:
        return v - q @ (q.T @ v)

    safe = lambda v: np.where(v > 0, v, 1.0)
    b = inside(-residual)
    beta = np.linalg.norm(b, axis=0)
    v, v_old = b / safe(beta), np.zeros_like(b)
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, c, c_old, s, s_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    previous = np.zeros_like(beta)
    for _ in range(steps):
        a_v = inside(product(v) - v * theta)
        alpha = np.sum(v * a_v, axis=0)
        new = inside(a_v - v * alpha - v_old * previous)
        size = np.linalg.norm(new, axis=0)
        # the next column of the tridiagonal matrix through the last two rotations, and a new one
        rho3, rho2 = s_old * previous, c * c_old * previous + s * alpha
        mixed = c * alpha - s * c_old * previous
        rho1 = np.hypot(mixed, size)
        c_old, s_old = c, s
        c, s = mixed / safe(rho1), size / safe(rho1)
        w_old, w = w, (v - w_old * rho3 - w * rho2) / safe(rho1)
        on = rho1 > 1e-14 * np.abs(theta).max()
        x = x + np.where(on, c * eta, 0) * w
        eta = np.where(on, -s * eta, 0)
        v_old, v, previous = v, new / safe(size), size
    return inside(x)


def leading_eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, inner: int = INNER_STEPS,
                       most: int = SUBSPACE, seed: int = 1) -> tuple[np.ndarray, np.ndarray, dict]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix without negative ones, falling, with unit eigenvectors as
    columns, from products with blocks of vectors only; and how it went (products, rounds, relative residuals).

    A pair is locked once its residual is within a few units of rounding of the largest eigenvalue, or when the
    subspace is the whole space or its residual stands still at the products' own rounding.
    """
    wanted, told = min(wanted, d), {"products": 0, "rounds": 0, "residuals": []}

    def counted(v: np.ndarray) -> np.ndarray:
        told["products"] += 1
        return product(v)

    block = min(d, wanted + GUARD)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((d, block)))
    image = counted(basis)
    locked, locked_image, values = np.zeros((d, 0)), np.zeros((d, 0)), []
    best, still = np.inf, 0
    tolerance = 4 * np.finfo(np.float64).eps * max(8.0, np.sqrt(d))
    while len(values) < wanted:
        told["rounds"] += 1
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, ritz_image = basis @ s, image @ s
        scale = max([*values, theta[0], 0.0])
        m = min(block, len(theta))
        residual = ritz_image[:, :m] - ritz[:, :m] * theta[:m]
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        full = len(values) + len(theta) >= d
        still = still + 1 if sizes[0] > 0.5 * best else 0
        best = min(best, sizes[0])
        floor = still >= 4 and sizes[0] <= 1e-11 * scale
        if told["rounds"] >= ROUNDS and not full:
            raise RuntimeError(f"residual {sizes[0]:.3g} of {scale:.3g} after {ROUNDS} rounds")
        done = 0
        while done < m and len(values) + done < wanted and (full or floor and not done or sizes[done] <= tolerance * scale):
            done += 1
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            locked_image = np.column_stack([locked_image, ritz_image[:, :done]])
            values += theta[:done].tolist()
            told["residuals"] += (sizes[:done] / (scale or 1.0)).tolist()
            best, still = np.inf, 0
            ritz, ritz_image, residual, theta = ritz[:, done:], ritz_image[:, done:], residual[:, done:], theta[done:]
        if len(values) >= wanted:
            break
        m = min(block, ritz.shape[1])
        residual = ritz_image[:, :m] - ritz[:, :m] * theta[:m]
        if ritz.shape[1] + m > min(most, d):
            keep = max(2 * m, min(most, d) // 2)
            ritz, ritz_image = ritz[:, :keep], ritz_image[:, :keep]
        q = np.column_stack([locked, ritz[:, :m]])
        t = corrections(counted, q, theta[:m], residual, inner)
        new = _orthonormal(t, locked, ritz)
        if not new.shape[1]:  # nothing new in the corrections: any direction that is left
            new = _orthonormal(np.random.default_rng(seed + told["rounds"]).standard_normal((d, m)), locked, ritz)
        new = new[:, :d - len(values) - ritz.shape[1]]
        basis, image = np.column_stack([ritz, new]), np.column_stack([ritz_image, counted(new)])
    # one more Rayleigh-Ritz over the locked ones puts them in order
    small = locked.T @ locked_image
    theta, s = np.linalg.eigh((small + small.T) / 2)
    return theta[::-1], locked @ s[:, ::-1], told


# -- results ------------------------------------------------------------------------------------------------------

def _split_squares(deviation: np.ndarray) -> list[Decimal]:
    """Exact row sums of squares of integers below 2^62, by halves of 31 bits."""
    low, high = deviation & 0x7FFFFFFF, deviation >> 31
    parts = [np.sum(a.astype(object) * b.astype(object), axis=1) for a, b in ((high, high), (high, low), (low, low))]
    return [Decimal(int(h) * (1 << 62) + 2 * int(m) * (1 << 31) + int(k)) for h, m, k in zip(*parts)]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


class Whitening:
    """What the rows need: n, the sums, eigenvalues and vectors, the trace."""

    def __init__(self, blocks: DataFrame, d: int, components: int = COMPONENTS):
        many = blocks.rdd.getNumPartitions() > PARTS
        totals = summed(blocks, lambda x: np.append(x.sum(axis=0), len(x)), (d + 1,), np.int64, many)
        self.blocks, self.sums, self.n = blocks, totals[:-1], int(totals[-1])
        n, sums = self.n, self.sums

        def product(u: np.ndarray) -> np.ndarray:
            def of_block(x: np.ndarray) -> np.ndarray:
                c = _centred(x, n, sums)
                return c.T @ (c @ u)
            return summed(blocks, of_block, u.shape, many_tasks=many) / n

        self.trace = float(summed(blocks, lambda x: np.square(_centred(x, n, sums)).sum(), (), many_tasks=many) / n)
        self.told: dict = {}
        if self.trace > 0:
            e, u, self.told = leading_eigenpairs(product, d, components)
            real = e > 16 * d * np.finfo(np.float64).eps * e[0]
            self.values, self.vectors = e[real], u[:, real]
        else:
            self.values, self.vectors = np.zeros(0), np.zeros((d, 0))
        project = self.vectors / np.sqrt(self.values)
        k = len(self.values)

        def moments(x: np.ndarray) -> np.ndarray:
            w = _centred(x, n, sums) @ project
            return np.vstack([w.T @ w, w.sum(axis=0)])

        m = summed(blocks, moments, (k + 1, k), many_tasks=many) / n if k else np.zeros((1, 0))
        self.identity_error = float(np.abs(m[:-1] - np.outer(m[-1], m[-1]) - np.eye(k)).max(initial=0.0))
        self.project = project

    def rows(self) -> DataFrame:
        """vec_id, component, n, deviation (a decimal), whitened, explained, identity_error."""
        n, sums, project = self.n, self.sums, self.project
        explained, error = self.values / (self.trace or 1.0), self.identity_error
        k = len(explained)
        schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)),
                            ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, known, x in _integers(batches):
                deviation = n * x - sums
                if float(np.abs(deviation).max()) ** 2 * x.shape[1] < 2.0 ** 62:
                    square = pa.array(np.square(deviation).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    square = pa.array(_split_squares(deviation), pa.decimal128(38, 0))
                w = _centred(x, n, sums) @ project
                each = np.repeat(np.arange(len(ids)), k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[each], mask=~known[each]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                    pa.array(np.full(len(each), n)), square.take(pa.array(each)), pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(ids))), pa.array(np.full(len(each), error))], schema=schema)

        return self.blocks.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row that counts and each of the
    leading components."""
    blocks, d = packed(vectors)
    if not d:
        return blocks.selectExpr("0L AS vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    return Whitening(blocks, d, components).rows().withColumn("deviation", F.expr("try_cast(deviation AS long)"))
