"""Nets by bunches, covers at many radii, packing, whole graphs and bridges."""

import hashlib
import heapq

import numpy as np
import pytest

from vicinal.operators import build as B
from vicinal.operators import cover as N
from vicinal.operators import knn as K


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, x)], "id long, v array<double>")


def islands(seed=0, n=150):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * 0.4 + rng.integers(0, 4, (n, 1)) * 3
    x[20:50] = x[3]  # a dense spot of equal rows
    return x


def order(ids, seed=0):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def greedy(x, radius, ids=None, seed=0):
    ids = list(range(len(x))) if ids is None else ids
    at = {i: k for k, i in enumerate(ids)}
    reps = []
    for i in order(ids, seed):
        if not any(np.sqrt(((x[at[i]] - x[at[r]]) ** 2).sum()) <= radius for r in reps):
            reps.append(i)
    return set(reps)


@pytest.mark.parametrize("bunches, batch", [(1, 1000), (8, 1000), (5, 7)])
def test_net_by_bunches_is_the_sequential_one(spark, monkeypatch, bunches, batch):
    monkeypatch.setattr(N, "BATCH", batch)
    x = islands()
    e = vectors(spark, x)
    net = N.owned_net(e, e.where("id % 13 = 0"), 0.5, bunches).toPandas().sort_values("id")
    want = greedy(x, 0.5)
    assert set(net.rep) == want and net.id.tolist() == list(range(len(x)))
    reps = np.array(sorted(want))
    d = np.sqrt(((x[:, None] - x[reps][None]) ** 2).sum(2))
    assert (net.rep.to_numpy() == reps[d.argmin(1)]).all() and (net.d <= 0.5).all()
    between = np.sqrt(((x[reps][:, None] - x[reps][None]) ** 2).sum(2)) + np.eye(len(reps)) * 9
    assert between.min() > 0.5  # across bunches too


def test_halo_rows_never_seed():
    import pandas as pd

    frame = pd.DataFrame({"id": [1, 2, 3, 4], "g": 0, "v": [[0.0], [0.4], [0.9], [5.0]], "h": ["a", "b", "c", "d"], "own": [False, True, True, True], "open": 1})
    # 2 waits for the halo row 1, and 3 for 2
    assert N.decide(frame, [0.5])["id"].tolist() == [4]


def test_covers_at_many_radii_in_one_pass(spark):
    x = islands(1)
    e = vectors(spark, x)
    radii = [0.1, 0.3, 0.7, 2.0, 50.0]
    got = {r.radius: r.n for r in N.cover_counts(e, e.where("id % 17 = 0"), radii, 4).collect()}
    assert got == {r: len(greedy(x, r)) for r in radii} and got[50.0] == 1


def test_choice_of_delta(spark):
    x = islands(2)
    e = vectors(spark, x)
    got = N.choose_delta(e, e.where("id % 17 = 0"), (20, 40), 0.0, 4, passes=2, grid=8)
    assert got["mode"] == "calibrated" and 20 <= len(greedy(x, got["delta"])) <= 40 and got["r_est"] == len(greedy(x, got["delta"]))
    assert N.choose_delta(e, e.where("id % 17 = 0"), (20, 40), 0.999, 4, passes=1, grid=8)["mode"] == "auto_fallback"
    assert N.choose_delta(e, e.where("id % 17 = 0"), (10**5, 10**6), 0.95, 4)["mode"] == "eps"


def test_packing_by_mass_has_stated_ties(spark):
    mass = {100: 5, 205: 9, 990: 5, 7: 5, 12: 1, 3: 9}
    got = {r.l: r.bunch for r in N.longest_first(spark.createDataFrame(list(mass.items()), "l long, n long"), 3).collect()}
    loads, want = [(0, b) for b in range(3)], {}
    for landmark in sorted(mass, key=lambda k: (-mass[k], k)):
        load, b = heapq.heappop(loads)
        want[landmark] = b
        heapq.heappush(loads, (load + mass[landmark], b))
    assert got == want == {3: 0, 205: 1, 7: 2, 100: 2, 990: 0, 12: 1}
    blocks = {r.l: r.bunch for r in N.contiguous(spark.createDataFrame([(i,) for i in (100, 205, 990, 7)], "id long"), 2).collect()}
    assert blocks == {7: 0, 100: 0, 205: 1, 990: 1}


def test_whole_graph_is_the_same_for_any_bunches(spark):
    x = islands(3)
    e = vectors(spark, x)
    marks = e.where("id % 13 = 0")
    one, many = (B.graph(e, marks, 0.5, 4, bunches) for bunches in (1, 8))
    assert sorted(map(tuple, one.edges.collect())) == sorted(map(tuple, many.edges.collect()))
    assert {r.id: r.weight for r in one.reps.collect()} == {r.id: r.weight for r in many.reps.collect()}
    assert sum(r.weight for r in one.reps.collect()) == len(x)
    edges = one.edges.toPandas()
    assert edges.w.max() == 1 and (edges.src < edges.dst).all() and not edges.duplicated(["src", "dst"]).any()


@pytest.mark.parametrize("few", [4096, 2])
def test_bridges_are_the_spanning_tree_of_components(spark, monkeypatch, few):
    monkeypatch.setattr(B, "FEW", few)
    x = islands(4, 60)
    ids = [7 * i + 3 for i in range(60)]
    e = vectors(spark, x, ids)
    near = K.one_nn(e).select("i", "j")
    got = sorted((r.src, r.dst) for r in B.bridges(e, near).collect())
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in near.collect():
        root[top(r.i)] = top(r.j)
    n, want = len({top(i) for i in ids}), []
    pairs = sorted((np.sqrt(((x[a] - x[b]) ** 2).sum()), ids[a], ids[b]) for a in range(60) for b in range(a + 1, 60))
    for _, a, b in pairs:
        if top(a) != top(b):
            root[top(a)] = top(b)
            want.append((a, b))
    assert len(want) == n - 1 > 3 and got == sorted(want)
    assert B.bridges(e, spark.createDataFrame([(ids[0], i) for i in ids], "i long, j long")).count() == 0


@pytest.mark.parametrize("cell", [8192, 9])
def test_buckets_of_any_size_meet_whole(spark, monkeypatch, cell):
    monkeypatch.setattr(K, "CELL", cell)
    x = islands(5, 90)
    e = vectors(spark, x).withColumn("g", K.F.col("id") % 3 * (K.F.col("id") % 2))
    got = {(r.i, r.rk): (r.j, r.d) for r in K.nearest(e, e, 3, by="g").collect()}
    g = np.arange(90) % 3 * (np.arange(90) % 2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(90):
        js = sorted((j for j in range(90) if j != i and g[j] == g[i]), key=lambda j: (d[i, j], j))[:3]
        assert [got[i, k][0] for k in (1, 2, 3)] == js
    pairs = {(r.i, r.j) for r in K.within(e, 0.6, "g").collect()}
    assert pairs == {(i, j) for i in range(90) for j in range(i + 1, 90) if g[i] == g[j] and d[i, j] <= 0.6}


@pytest.mark.parametrize("k", [1, 3, 59])
def test_bridges_by_lists_search_only_rows_whose_neighbours_are_all_inside(spark, monkeypatch, k):
    x = np.round(islands(5, 60), 1)  # with ties
    e = vectors(spark, x)
    searched, between = [], B.between

    def seen(query, corpus):
        searched.append(query.count())
        return between(query, corpus)

    monkeypatch.setattr(B, "between", seen)
    pairs = K.one_nn(e).select("i", "j")
    got = sorted((r.src, r.dst) for r in B.bridges(e, pairs, K.knn(e, k), k).collect())
    want = sorted((r.src, r.dst) for r in B.bridges(e, pairs).collect())
    root = {r.id: r.root for r in K.components(e, pairs).collect()}
    assert got == want and len(got) == len(set(root.values())) - 1
    assert sum(searched) < 60 if k > 1 else len(searched) > 0
