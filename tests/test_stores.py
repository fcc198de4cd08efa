"""Neighbour stores, graph states and pyramids."""

import numpy as np
import pytest

from vicinal.functions.curves import fit_curve, least_gap
from vicinal.operators import build as B
from vicinal.operators import knn as K
from vicinal.operators import sampling as S
from vicinal.sources.store import GraphStore, KnnStore, load_array, load_graph, save_graph


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_neighbour_store_is_read_only_when_complete(spark, tmp_path):
    e = vectors(spark, np.random.default_rng(0).normal(size=(40, 3)))
    store = KnnStore(spark, str(tmp_path / "knn"))
    assert not store.complete()
    with pytest.raises(ValueError):
        store.write(0, K.knn(e, 3))
    store.create(40, 3, 2)
    assert store.audit() == {"missing": 120, "twice": 0, "bad": 0}
    store.write(0, K.nearest(e.where("id % 2 = 0"), e, 3))
    with pytest.raises(ValueError, match="missing"):
        store.mark_complete()
    with pytest.raises(ValueError, match="not complete"):
        store.load()
    store.write(1, K.nearest(e, e, 3))  # more than its part
    assert store.audit()["twice"] == 60
    store.write(1, K.nearest(e.where("id % 2 = 1"), e, 3))
    store.mark_complete()
    assert store.complete() and sorted(map(tuple, store.load().collect())) == sorted(map(tuple, K.knn(e, 3).collect()))
    store.write(1, K.nearest(e.where("id % 2 = 1"), e, 3))
    assert not store.complete()


def test_graph_state_and_pyramid(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 2)) + np.repeat([[0, 0], [60, 0], [0, 90]], 50, 0)
    e = vectors(spark, x)
    marks = e.where("id % 15 = 0")
    g = B.graph(e, marks, 0.2, 4, 3, backbone=0.0)
    store = GraphStore(spark, str(tmp_path / "graph"))
    with pytest.raises(ValueError):
        load_graph(store)
    save_graph(store, g, {"config": {}})
    back = load_graph(store)
    for name in ("members", "reps", "knn", "edges"):
        assert sorted(map(tuple, getattr(back, name).collect())) == sorted(map(tuple, getattr(g, name).select(getattr(back, name).columns).collect()))
    levels = B.pyramid(e, marks, back, ratio=3.0, least=8)
    sizes = [level.reps.count() for level in levels]
    assert len(levels) >= 2 and all(b <= max(a / 3 * 1.01, 8) or b < a for a, b in zip(sizes, sizes[1:])) and sizes == sorted(sizes, reverse=True)
    assert all(sum(r.weight for r in level.reps.collect()) == 150 for level in levels)
    top = levels[-1]
    ids = {r.id for r in top.reps.collect()}
    pairs = top.edges.select(K.F.col("src").alias("i"), K.F.col("dst").alias("j"))
    assert {r.root for r in K.components(top.reps.select("id"), pairs).collect()} == {min(ids)}
    assert {r.src for r in top.edges.collect()} | {r.dst for r in top.edges.collect()} <= ids
    assert sum(r.w == 1.0 for r in top.edges.collect()) >= 2  # three parts, two bridges


def test_active_members_one_cell_after_another(spark):
    members = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30), (5, 30)], "id long, cell long")
    values, cells = S.active_members(members, spark.createDataFrame([(2,), (1,), (5,), (9,), (5,)], "id long"))
    assert [(r.cell, r.member) for r in values.orderBy("at").collect()] == [(10, 1), (10, 2), (20, -1), (30, 5)]
    assert sorted(map(tuple, cells.collect())) == [(10, 0, 2), (20, 2, 1), (30, 3, 1)]


@pytest.mark.parametrize("name", ["a.npy", "a.npz", "b.npz"])
def test_array_files_are_read_by_tasks(spark, tmp_path, name):
    x = np.random.default_rng(2).normal(size=(50, 2, 3)).astype(np.float32)
    path = str(tmp_path / name)
    np.save(path, x) if name.endswith("npy") else np.savez(path, **({"other": x[:1], "X": x} if name[0] == "a" else {"only": x}))
    rows = load_array(spark, path, 20)
    assert rows.rdd.getNumPartitions() == 3
    got = {r.id: r.v for r in rows.collect()}
    assert sorted(got) == list(range(50)) and all(got[i] == x[i].ravel().tolist() for i in range(50))
    with pytest.raises(ValueError):
        load_array(spark, str(tmp_path / "a.txt"))


def test_curve_is_the_best_fit():
    for spread, gap in ((1.0, 0.1), (1.0, 0.5), (2.0, 0.3)):
        a, b = fit_curve(spread, gap)
        x = np.linspace(0, 3 * spread, 300)[1:]
        y = np.where(x < gap, 1, np.exp(-(x - gap) / spread))
        loss = lambda a, b: ((1 / (1 + a * x ** (2 * b)) - y) ** 2).sum()
        assert all(loss(a, b) <= loss(a * f, b * g) for f in (0.99, 1, 1.01) for g in (0.99, 1, 1.01))
    a, b = fit_curve()
    assert abs(a - 1.577) < 2e-3 and abs(b - 0.8951) < 2e-3  # the values of the well-known defaults
    assert abs(fit_curve(1.0, least_gap(1.0))[1] - 1) < 1e-6 and 0.19 < least_gap(1.0) < 0.21
