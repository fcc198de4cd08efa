"""Landmarks, discs and bounded searches along a graph against Dijkstra."""

import hashlib

import numpy as np
import pytest

from vicinal.operators import geodesic as A
from vicinal.operators.net import shortest_paths


@pytest.fixture(scope="module")
def ring(spark):
    rng = np.random.default_rng(0)
    t = np.sort(rng.random(40)) * 2 * np.pi
    x = np.r_[np.c_[np.cos(t), np.sin(t)], [[30, 0], [30, 0.1], [30, 0.3], [30, 0.35]]]  # two parts
    ids = [5 * i + 2 for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in zip(ids, x)], "id long, v array<double>").repartition(2)
    both = A.neighbour_graph(df, 2)
    at = {i: k for k, i in enumerate(ids)}
    e = [(at[r.s], at[r.t], r.d) for r in both.collect() if r.s < r.t]
    d = shortest_paths(len(ids), np.array([x[:2] for x in e]), np.array([x[2] for x in e]), np.arange(len(ids)))
    order = sorted(range(len(ids)), key=lambda k: (hashlib.md5(f"0:{ids[k]}".encode()).hexdigest(), ids[k]))
    return df, both, ids, d, order


def test_farthest_points_along_the_graph(spark, ring):
    df, _, ids, d, order = ring
    place = np.argsort(order)
    want, least = [order[0]], d[order[0]].copy()
    while len(want) < 6:
        top = max(least)
        want.append(min((k for k in range(len(ids)) if least[k] == top), key=lambda k: place[k]))
        least = np.minimum(least, d[want[-1]])
    assert [r.id for r in A.geodesic_fps(df, 2, 6).orderBy("k").collect()] == [ids[k] for k in want]


@pytest.mark.parametrize("darts", [32, 3])
def test_discs_are_the_sequential_ones(spark, ring, monkeypatch, darts):
    monkeypatch.setattr(A, "DARTS", darts)
    df, both, ids, d, order = ring
    want: list[int] = []
    for k in order:
        if all(d[k][j] >= 0.9 for j in want):
            want.append(k)
    assert A.discs(df, both, 0.9) == [ids[k] for k in want]
    assert A.discs(df, both, 0.9, 3) == [ids[k] for k in want[:3]]


@pytest.mark.parametrize("targets", [1, 7, 100, None])
def test_bounded_searches_are_dijkstra(spark, ring, targets):
    df, both, ids, d, _ = ring
    some = [ids[3], ids[20], ids[41]]
    got: dict = {}
    for r in A.paths(both, df.where(df["id"].isin(some)).select("id"), targets).collect():
        got.setdefault(r.src, {})[r.id] = r.g
    for s in some:
        row = d[ids.index(s)]
        near = sorted((g, i) for g, i in zip(row.tolist(), ids) if np.isfinite(g) and i != s)[:targets]
        assert set(got[s]) == {i for _, i in near}
        assert all(abs(got[s][i] - g) < 1e-12 for g, i in near)


def test_poisson_landmarks_keep_apart(spark, ring):
    df, _, ids, d, _ = ring
    got = [r.id for r in A.poisson_landmarks(df, 2, 5).collect()]
    apart = [d[ids.index(a)][ids.index(b)] for a in got for b in got if a < b]
    assert 1 < len(got) <= 5 and min(apart) > 0
