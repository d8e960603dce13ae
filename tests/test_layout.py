import numpy as np
from pyspark.sql import functions as F

from skylattice.sinks import layout


def test_curve_visits_neighbours():
    for n, bits in ((2, 1), (2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        index = layout.hilbert_index(grid, bits)
        assert sorted(index.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_any_two_columns_prune_files(spark, tmp_path):
    df = spark.range(60_000).select("id", (F.rand(1) * 360).alias("ra"), (50_000 + F.pow(F.rand(2), 3) * 4000).alias("t"), F.exp(F.randn(3)).alias("wave"))
    odd = spark.createDataFrame([(70_000, None, 50_010.0, 1.0), (70_001, float("nan"), None, 0.5), (70_002, 10.0, 50_000.0, None)], "id long, ra double, t double, wave double")
    df = df.unionByName(odd)
    path = str(tmp_path / "t")
    layout.write_layout(df, path, ["ra", "t", "wave"], files=200)
    manifest = spark.read.parquet(path + "/manifest")
    assert manifest.count() > 150 and manifest.agg(F.sum("rows")).first()[0] == 60_003
    for limits in ({"ra": (100, 110), "t": (50_100, 50_140)}, {"ra": (355, None), "wave": (2.0, 2.2)}, {"t": (50_000, 50_002), "wave": (None, 0.3)}):
        found = layout.read_layout(spark, path, limits)
        exact = df
        for c, (low, high) in limits.items():
            exact = exact.filter((F.col(c) >= low if low is not None else F.lit(True)) & (F.col(c) <= high if high is not None else F.lit(True)))
        assert sorted(r[0] for r in found.select("id").collect()) == sorted(r[0] for r in exact.select("id").collect())
        assert len(found.inputFiles()) < 0.1 * manifest.count() + 1
    nothing = layout.read_layout(spark, path, {"ra": (400, 500)})
    assert nothing.count() == 0 and nothing.columns == [*df.columns, "curve_place"]
