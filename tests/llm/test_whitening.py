import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import whitening


@pytest.mark.parametrize("d, wanted", [(1, 8), (5, 8), (64, 8), (150, 5)])
def test_eigenpairs_from_products(d, wanted):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, 2 * d))
    a = a @ a.T
    e, u, told = whitening.leading_eigenpairs(lambda v: a @ v, d, wanted)
    true, vectors = np.linalg.eigh(a)
    k = min(d, wanted)
    assert np.allclose(e, true[::-1][:k], rtol=1e-13)
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < 2e-13 * e[0]
    assert np.allclose(np.abs(np.sum(u * vectors[:, ::-1][:, :k], axis=0)), 1, atol=1e-12)
    assert told["products"] < 80 and max(told["residuals"]) < 1e-13


def test_equal_and_zero_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((90, 90)))[0]
    for values in ([5.0] * 3 + [4.0] * 9 + [1.0] * 78, [3.0, 2.0] + [0.0] * 88, [1.0] * 90):
        a = (q * values) @ q.T
        e, u, _ = whitening.leading_eigenpairs(lambda v: a @ v, 90, 8)
        assert np.allclose(e, values[:8], atol=1e-13)
        assert np.allclose(u.T @ u, np.eye(8), atol=1e-12)
        assert np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-12


def test_minres_solves_the_projected_equations():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a @ a.T
    e, u = np.linalg.eigh(a)
    q = u[:, -3:]
    r = rng.standard_normal((30, 2))
    theta = e[-2:] + 0.1
    t = whitening.corrections(lambda v: a @ v, q, theta, r, 28)
    p = np.eye(30) - q @ q.T
    for k in range(2):
        assert np.allclose(p @ (a - theta[k] * np.eye(30)) @ p @ t[:, k], -p @ r[:, k], atol=1e-8)


def against_numpy(rows, vectors):
    """rows: vec_id -> {component: row}; vectors: vec_id -> entries."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors.values()], object)
    n, s = len(x), x.sum(axis=0)
    c = ((n * x - s) / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(8, int((e > 1e-12 * e[0]).sum()))
    assert set(rows) == set(vectors)
    for j in range(k):
        mine = np.array([rows[i][j + 1]["whitened"] for i in vectors])
        true = c @ u[:, j] / np.sqrt(e[j])
        assert min(np.abs(mine - true).max(), np.abs(mine + true).max()) < 1e-9
    for i, own in zip(vectors, x):
        assert set(rows[i]) == set(range(1, k + 1))
        for j, r in rows[i].items():
            deviation = sum((n * a - b) ** 2 for a, b in zip(own, s))
            assert r["n"] == n and r["deviation"] == (deviation if deviation < 1 << 63 else None)
            assert abs(r["explained"] / (e[j - 1] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9


def by_id(df):
    out = {}
    for r in df.collect():
        assert r["component"] not in out.setdefault(r["vec_id"], {})
        out[r["vec_id"]][r["component"]] = r
    return out


@pytest.mark.parametrize("parts", [32, 2])
def test_whole_table_against_numpy(spark, monkeypatch, parts):
    monkeypatch.setattr(whitening, "PARTS", parts)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(5, "vec_id")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    against_numpy(by_id(whitening.whitened(df)), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = {i: [float(x) for x in rng.standard_normal(4) * [3, 2, 1, 0.5]] for i in range(40)}
    good[40] = [-5e10, 1.0, 2.0, 3.0]
    rows = [(i, v, "x", 1, 2) for i, v in good.items()]
    rows += [(50, None, "x", 1, 2), (51, [], "x", 1, 2), (52, [1.0, None, 2.0, 3.0], "x", 1, 2), (53, [1.0, float("nan"), 2.0, 3.0], "x", 1, 2),
             (54, [1.0, float("inf"), 2.0, 3.0], "x", 1, 2), (55, [1.0, 2.0], "x", 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, c string, n int, part int")
    good[40][0] = -1e9
    against_numpy(by_id(whitening.whitened(df)), good)
    # rows without id and repeated rows count
    again = df.unionByName(df.filter("vec_id = 3")).withColumn("vec_id", F.when(F.col("vec_id") != 5, F.col("vec_id")))
    found = whitening.whitened(again).collect()
    assert {r["n"] for r in found} == {42}
    k = len({r["component"] for r in found})
    assert sum(r["vec_id"] is None for r in found) == k and sum(r["vec_id"] == 3 for r in found) == 2 * k


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []


def test_deviations_are_exact_beyond_64_bits(spark):
    a = np.array([[2 ** 61 + 3, -(2 ** 60) - 1]])
    assert int(whitening._split_squares(a)[0]) == (2 ** 61 + 3) ** 2 + (2 ** 60 + 1) ** 2
