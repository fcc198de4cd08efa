"""Properties of the operators on small seeded tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import metrics as V
from vicinal.operators import conformal as C
from vicinal.operators import graph as G
from vicinal.operators import knn as K
from vicinal.operators import net as N
from vicinal.operators import paths as P
from vicinal.operators.cover import epsilon_net
from vicinal.sources.store import GraphStore, fingerprint, needs_rebuild
from vicinal.streaming.ingest import NetStream


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(0).normal(size=(60, 5))


def test_knn_is_brute_force_across_blocks(spark, cloud, monkeypatch):
    monkeypatch.setattr(K, "blocks", lambda df, size=7, f=K.blocks: f(df, size))
    got = {(r.i, r.rk): (r.j, r.d) for r in K.knn(vectors(spark, cloud), 4).collect()}
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(60):
        for k, j in enumerate(np.lexsort((np.arange(60), d[i]))[:4]):
            assert got[i, k + 1][0] == j and abs(got[i, k + 1][1] - d[i, j]) < 1e-12


def test_knn_with_more_neighbours_than_rows(spark):
    assert K.knn(vectors(spark, [[0], [1], [3]]), 10).count() == 6


@pytest.mark.parametrize("name", sorted(V.METRICS))
def test_metrics_on_zero_and_equal_rows(spark, name):
    rows = vectors(spark, [[0, 0, 0], [1, 1, 1], [1, 2, 3]])
    d = {(r.i, r.j): r.d for r in K.pair_distances(rows, rows, name).collect()}
    # the square root of a rounding error of 1e-16 is 1e-8
    assert all(abs(d[i, i]) < 1e-7 for i in range(3))
    assert all(np.isfinite(x) and x >= 0 for x in d.values())
    assert all(abs(d[i, j] - d[j, i]) < 1e-12 for i, j in d)


def test_unknown_metric_and_bad_rows(spark):
    with pytest.raises(KeyError):
        V.get_metric("no such")
    bad = spark.createDataFrame([(0, [float("nan")])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="null or NaN"):
        K.checked(bad).collect()


def test_ragged_and_infinite_vectors_are_errors(spark):
    schema = "vec_id long, embedding array<float>"
    ragged = spark.createDataFrame([(0, [1.0] * 3), (1, [2.0] * 5), (2, [3.0] * 4), (3, [4.0] * 4)], schema)
    with pytest.raises(Exception, match="differ in length"):
        K.checked(ragged).collect()
    for value in (float("inf"), float("-inf")):
        with pytest.raises(Exception, match="infinite value"):
            K.checked(spark.createDataFrame([(0, [1.0]), (1, [value])], schema)).collect()
    assert K.checked(spark.createDataFrame([], schema)).collect() == []


def test_components_take_the_smallest_id(spark):
    nodes = spark.range(12)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(11, 7), (9, 7)], "i long, j long")
    got = {r.id: r.root for r in K.components(nodes, pairs).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 6: 6, 7: 7, 8: 8, 9: 7, 10: 10, 11: 7}


def test_net_covers_and_packs(spark, cloud):
    e = vectors(spark, np.repeat(cloud[:20], 3, 0))
    net = epsilon_net(e, e.where("id = 0"), 0.5).toPandas()
    x = np.repeat(cloud[:20], 3, 0)
    assert (np.sqrt(((x[net.id] - x[net.rep]) ** 2).sum(1)) <= 0.5 + 1e-9).all()
    reps = x[np.unique(net.rep)]
    d = np.sqrt(((reps[:, None] - reps[None]) ** 2).sum(2)) + np.eye(len(reps)) * 9
    assert (d > 0.5).all() and len(reps) <= 20


def test_smooth_solves_for_sigma(spark, cloud):
    near = K.knn(vectors(spark, cloud), 10)
    s = {r.i: r for r in G.smooth(near).collect()}
    for i, d in near.groupBy("i").agg(F.collect_list("d").alias("d")).collect():
        total = np.exp(-np.maximum(np.array(d) - s[i].rho, 0) / s[i].sigma).sum()
        assert abs(total - np.log2(10)) < 1e-3


def test_p_values_count_ties_as_at_least(spark):
    calib = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "s double")
    test = spark.createDataFrame([(0, 2.0), (1, 9.0), (2, 0.0)], "id long, s double")
    assert {r.id: r.p for r in C.p_values(test, calib).collect()} == {0: 0.8, 1: 0.2, 2: 1.0}


def test_threshold_beyond_the_sample_is_infinite(spark):
    calib = spark.createDataFrame([(float(x),) for x in range(9)], "s double")
    got = {r.alpha: r.threshold for r in C.thresholds(calib, [0.01, 0.5]).collect()}
    assert got == {0.01: float("inf"), 0.5: 4.0}


def test_ties_in_sequences(spark):
    rows = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 1, 3), (0, 3, 4), (0, 2, 5)], "grp long, t long, id long")
    assert {tuple(r)[1:] for r in P.triplets(rows, 3, "first").collect()} == {(1, 2, 4)}
    assert {tuple(r)[1:] for r in P.triplets(rows, 3, "last").collect()} == {(1, 3, 4)}
    assert P.triplets(rows, 3, "drop").count() == 0


def test_transport_of_a_shift_is_its_length():
    cost = N.grid_cost(4)
    a, b = np.zeros(16), np.zeros(16)
    a[[0, 1]], b[[2, 3]] = 0.5, 0.5
    assert abs(N.transport(a, b, cost) - 2) < 1e-9


def test_mds_keeps_flat_distances():
    x = np.random.default_rng(1).normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    z, negative = N.classical_mds(d)
    assert np.allclose(np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)), d) and negative < 1e-9


def test_store_reads_one_level_and_knows_when_to_rebuild(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    assert store.meta() is None
    edges = spark.createDataFrame([(0, 1, 2, 0.5), (1, 3, 4, 0.25)], "level int, src long, dst long, w double")
    rows = vectors(spark, [[1, 2], [3, 4]])
    store.save(edges, {"fingerprint": fingerprint(rows), "config": {"k": 5, "epsilon": 0.1}})
    assert [tuple(r) for r in store.edges(1).collect()] == [(3, 4, 0.25)]
    meta = store.meta()
    assert not needs_rebuild(meta, fingerprint(rows), {"k": 5, "epsilon": 0.1 + 1e-12, "metric": "l2"})
    assert needs_rebuild(meta, fingerprint(rows), {"k": 6})
    assert needs_rebuild(meta, fingerprint(rows.where("id = 0")), {"k": 5})


def test_stream_absorbs_duplicates_and_survives_a_rerun(spark, cloud, tmp_path):
    marks = vectors(spark, cloud[:4])
    s = NetStream(spark, str(tmp_path / "net"), marks, 1e-6)
    for batch in range(3):
        rows = vectors(spark, cloud).select((F.col("id") + 1000 * batch).alias("id"), "v")
        s.ingest(rows, batch)
    s.ingest(vectors(spark, cloud).select((F.col("id") + 2000).alias("id"), "v"), 2)
    assert s.table("members").count() == 180 and s.table("reps").count() == 60


def test_knn_ties_go_by_id_and_large_norms_lose_none(spark):
    copies = vectors(spark, [[5.0, 5.0]] * 200 + [[0.0, 0.0]])
    query = copies.where("id = 200")
    assert [r.j for r in K.nearest(query, copies, 3).orderBy("rk").collect()] == [0, 1, 2]
    far = 1e7 + np.random.default_rng(2).normal(size=(300, 3)) * 1e-3  # the product formula is off by more than the distances
    got = {(r.i, r.rk): r.j for r in K.knn(vectors(spark, far), 2).collect()}
    d = np.sqrt(((far[:, None] - far[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        assert [got[i, 1], got[i, 2]] == np.lexsort((np.arange(300), d[i]))[:2].tolist()


def test_net_of_large_buckets_covers_and_takes_the_nearest(spark):
    x = np.r_[np.arange(120) * 0.01, 50 + np.arange(9) * 0.01][:, None]  # two buckets, the first netted in parts
    e = vectors(spark, x)
    net = epsilon_net(e, e.where("id in (0, 120)"), 0.1).toPandas().sort_values("id")
    assert net.id.tolist() == list(range(129))
    d = np.abs(x[net.id] - x[net.rep])[:, 0]
    assert d.max() <= 0.1 + 1e-9
    reps = np.unique(net.rep)
    first = reps[reps < 120]
    assert np.diff(np.sort(x[first, 0])).min() > 0.1 - 1e-9
    assert np.allclose(d[:120], np.abs(x[:120] - x[first].T).min(1))


def test_emd_meets_all_rows(spark, tmp_path):
    from vicinal.plans.queries import QUERIES

    x = np.random.default_rng(3).normal(size=(110, 64))
    rows = spark.createDataFrame([(i, [float(y) for y in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.i, r.j): r.d for r in QUERIES["emd_pairs"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, j) for i in (0, 100) for j in range(110) if i != j}
    m = np.maximum(x, 0) / np.maximum(x, 0).sum(1, keepdims=True)
    assert abs(got[100, 7] - N.transport(m[100], m[7], N.grid_cost(8))) < 1e-6 and got[0, 100] == got[100, 0]


def test_large_tables_are_whole_in_landmarks_and_geodesics(spark, cloud):
    e = vectors(spark, np.r_[cloud, cloud[:5] + 100])  # two parts without a path between
    few = [r.id for r in N.fps(e, 20).orderBy("k").collect()]
    assert [r.id for r in N.fps(e, 20, rows=10).orderBy("k").collect()] == few
    marks = e.where("id in (3, 17, 40, 62)")
    got, want = ({(r.a, r.b): r.g for r in N.geodesics(e, marks, 3, rows).collect()} for rows in (10, 100))
    assert got == want and got[3, 62] == float("inf") and 0 < got[3, 17] < 100
