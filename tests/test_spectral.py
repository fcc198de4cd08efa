"""Eigenvectors against a dense solver, streamed nets, refreshed neighbours and projections."""

import numpy as np
import pytest

from vicinal.operators import knn as K
from vicinal.operators import spectral as S
from vicinal.streaming.cells import CellNet, novelty_radius
from vicinal.streaming.ingest import refresh_dirty


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_eigenvectors_are_those_of_a_dense_solver(spark):
    rng = np.random.default_rng(0)
    n = 70
    w = np.triu((rng.random((n, n)) < 0.12) * rng.random((n, n)), 1)
    w[np.arange(n - 1), np.arange(1, n)] = 0.5
    edges = spark.createDataFrame([(3 * int(i), 3 * int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "src long, dst long, w double")
    w = w + w.T
    deg = w.sum(1)
    values, u = np.linalg.eigh(w / np.sqrt(np.outer(deg, deg)))
    got, rows, residual = S.eigenpairs(edges, 4, 1e-7)
    assert np.allclose(got, values[::-1][:4], atol=1e-8) and residual.max() <= 1e-7
    found = np.array([r.u for r in rows.orderBy("id").collect()])
    for k in range(4):
        assert abs(abs(found[:, k] @ u[:, -1 - k]) - 1) < 1e-7
    z = np.array([r.z for r in S.layout(edges, 2, 1e-7).orderBy("id").collect()])
    for k in range(2):
        want = u[:, -2 - k] / np.sqrt(deg)
        want *= np.sign(want[np.abs(want).argmax()])
        assert np.allclose(z[:, k], want, atol=1e-6)


def test_a_small_graph_is_exhausted(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5)], "src long, dst long, w double")
    values, _, _ = S.eigenpairs(edges, 3)
    assert np.allclose(values, [1, 0, -1], atol=1e-9)


def test_streamed_net_in_several_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(120, 3)), [[40.0, 0, 0]]]
    df = vectors(spark, x)
    src, marks = str(tmp_path / "in"), df.where("id < 5")
    net = CellNet(spark, str(tmp_path / "net"), marks, 0.8)
    schema = "id long, v array<double>"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for k in range(2):
        df.where(f"id % 4 = {k}").coalesce(1).write.mode("append").parquet(src)
    net.start(stream()).awaitTermination()
    first = net.members().count()
    for k in (2, 3):
        df.where(f"id % 4 = {k}").coalesce(1).write.mode("append").parquet(src)
    net.start(stream()).awaitTermination()  # a new query goes on
    rows = net.members().toPandas().sort_values("id")
    assert 0 < first < 121 and rows.id.tolist() == list(range(121)) and rows.batch.nunique() >= 4
    assert (np.sqrt(((x[rows.id] - x[rows.rep]) ** 2).sum(1)) <= 0.8).all()
    assert set(rows.id[rows.spawned]) == set(rows.rep)
    for _, cell in rows[rows.spawned].groupby("l"):
        at = x[cell.id]
        d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) + 9 * np.eye(len(at))
        assert d.min() > 0.8
    assert rows.novel.to_numpy()[120] and novelty_radius(x[:5], 0.8) >= 0.8
    report = {r.batch: r for r in net.report().collect()}
    assert sum(r.n for r in report.values()) == 121 and all(r.n == r.spawned + r.absorbed for r in report.values())


@pytest.mark.parametrize("moved", [[7], list(range(0, 60, 2))])
def test_refreshed_neighbours_are_all_found(spark, moved):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3))
    before = K.cut(K.knn(vectors(spark, x), 4))
    x[moved] = x[30] + rng.normal(size=(len(moved), 3)) * 0.01
    rows = vectors(spark, x)
    dirty = spark.createDataFrame([(i,) for i in moved], "id long")
    got = sorted((r.i, r.rk, r.j) for r in refresh_dirty(before, dirty, rows, 4).collect())
    assert got == sorted((r.i, r.rk, r.j) for r in K.knn(rows, 4).collect())


def test_projected_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 12)) + rng.integers(0, 3, (600, 1)) * 4
    df = vectors(spark, x)
    found, recall = K.knn_projected(df, 5, 0.9, dims=6, bucket_rows=200)
    true = {(r.i, r.j) for r in K.knn(df, 5).collect()}
    rows = found.collect()
    assert recall >= 0.9 and len(rows) == 3000
    assert len(true & {(r.i, r.j) for r in rows}) / 3000 > 0.8
    assert all(abs(r.d - np.sqrt(((x[r.i] - x[r.j]) ** 2).sum())) < 1e-9 for r in rows[:50])
