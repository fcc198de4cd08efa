"""Ranks, class sums and draws against brute force, across blocks and stretches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import conformal as C
from vicinal.operators import evaluate as Q
from vicinal.operators import knn as K
from vicinal.operators import order as R
from vicinal.operators import paths as P
from vicinal.operators import sampling as S


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def cloud():
    x = np.random.default_rng(3).normal(size=(50, 4))
    x[10:20] = x[9]  # ties
    return x


def all_ranks(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    n = len(x)
    return d, np.array([np.argsort(np.lexsort((np.arange(n), d[i]))) + 1 for i in range(n)])


def test_ranks_of_given_rows_are_brute_force(spark, cloud, monkeypatch):
    monkeypatch.setattr(K, "blocks", lambda df, size=7, by=None, f=K.blocks: f(df, size, by))
    monkeypatch.setattr(K, "BLOCK", 7)
    df = vectors(spark, cloud)
    rng = np.random.default_rng(1)
    asked = sorted({(int(i), int(j)) for i, j in rng.integers(0, 50, (120, 2)) if i != j})
    got = {(r.i, r.j): r.rk for r in K.ranks(spark.createDataFrame(asked, "i long, j long"), df).collect()}
    _, rk = all_ranks(cloud)
    assert got == {(i, j): rk[i, j] for i, j in asked}


def test_trust_and_continuity_are_brute_force(spark, cloud):
    flat, k, n = cloud[:, :2], 5, len(cloud)
    got = Q.trust_continuity(vectors(spark, cloud), vectors(spark, flat), k).first()
    (_, ro), (_, re) = all_ranks(cloud), all_ranks(flat)
    loss = lambda a, b: sum(b[i, j] - k for i in range(n) for j in range(n) if i != j and a[i, j] <= k < b[i, j])
    scale = 2 / (n * k * (2 * n - 3 * k - 1))
    assert got.trust == pytest.approx(1 - scale * loss(re, ro)) and got.continuity == pytest.approx(1 - scale * loss(ro, re))


def test_classes_by_kernel_are_brute_force(spark, cloud):
    label = np.arange(50) % 3
    label[7] = 9  # alone
    rows = [(i, [float(y) for y in v], None if i == 4 else int(label[i])) for i, v in enumerate(cloud)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label long")
    d, _ = all_ranks(cloud)
    own = lambda c, i: [j for j in range(50) if label[j] == c and j not in (4, i)]
    means = {(r.i, r.label): (r.mean, r.n) for r in K.class_means(df, df).collect()}
    assert (7, 9) not in means and len(means) == 50 * 4 - 1
    for (i, c), (m, n) in means.items():
        assert n == len(own(c, i)) and m == pytest.approx(np.mean([d[i, j] for j in own(c, i)]))
    near = {(r.i, r.label, r.rk): r.j for r in K.class_nearest(df, df, 3).collect()}
    for i in range(50):
        for c in (0, 1, 2):
            want = sorted(own(c, i), key=lambda j: (d[i, j], j))[:3]
            assert [near[i, c, k] for k in (1, 2, 3)] == want


def test_order_is_that_of_one_window(spark):
    rows = spark.createDataFrame([(None if k % 11 == 0 else f"k{k * 7919 % 300:04d}", k) for k in range(300)], "a string, b long")
    got = {(r.a, r.b): r.before for r in R.before(rows, ["a", "b"], F.col("b"), parts=5).collect()}
    total, want = 0, {}
    for a, b in sorted(got, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        want[a, b] = total
        total += b
    assert got == want and R.before(rows, ["a", "b"]).select("stretch").distinct().count() > 30
    assert R.before(rows.limit(0), ["a"]).count() == 0


def test_average_ranks_and_classes_with_ties(spark):
    rows = spark.createDataFrame([(float(x),) for x in [3, 1, 3, 2, 3]] + [(None,)], "x double")
    assert sorted((r.x, r.rk) for r in Q.ranked(rows, rk="x").collect()) == [(1, 1), (2, 2), (3, 4), (3, 4), (3, 4)]
    data = [(c, float(s)) for c, s in zip([0, 0, 1, 1, 2, 2, 2], [1, 2, 2, 3, 0, 2, 9], strict=True)] + [(None, 1.0), (1, None)]
    got = {(r.lo, r.hi): r.auc for r in Q.auc_pairs(spark.createDataFrame(data, "label long, s double")).collect()}
    for lo, hi in ((0, 1), (0, 2), (1, 2)):
        a, b = ([s for c, s in data if c == x and s is not None] for x in (lo, hi))
        assert got[lo, hi] == pytest.approx(np.mean([(y > x) + 0.5 * (y == x) for x in a for y in b]))


def test_mann_whitney_breaks_ties_by_id(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), int(rng.integers(0, 4)), bool(rng.integers(0, 2))) for i in rng.permutation(80)]
    got = C.mann_whitney_u(spark.createDataFrame(data, "id long, s long, x boolean"), F.col("x")).first().u
    ranked = sorted(data, key=lambda r: (r[1], r[0]))
    n = sum(r[2] for r in data)
    assert got == sum(k + 1 for k, r in enumerate(ranked) if r[2]) - n * (n + 1) / 2


def test_draws_are_independent_and_in_proportion(spark):
    data = [(k, 1e-3) for k in range(500)] + [(1000, 50.0), (1001, 0.0), (1002, 25.0), (1002, 25.0)]
    rows = spark.createDataFrame(data, "k long, w double")
    n = 4000
    got = {r.k: r.draws for r in S.draw(rows, n, 3).collect()}
    assert sum(got.values()) == n and 1001 not in got
    assert abs(got[1000] - n * 50 / 100.5) < 150 and abs(got[1002] - n * 50 / 100.5) < 150  # five deviations
    assert got == {r.k: r.draws for r in S.draw(rows.repartition(7), n, 3).collect()}
    assert got != {r.k: r.draws for r in S.draw(rows, n, 4).collect()}
    even = [r.draws for r in S.draw(spark.range(200).withColumn("w", F.lit(1.0)), 2000, 1).collect()]
    assert np.var([*even, *[0] * (200 - len(even))]) > 5  # of Poisson-like counts about 10, of even steps under 1
    assert S.draw(rows.limit(0), 10, 1).count() == 0


def test_split_and_renumbering(spark):
    ids = spark.range(100)
    held = S.split(ids, 0.2, 7)
    assert held.where("held_out").count() == 20 and held.count() == 100
    assert S.split(ids.limit(3), 0.1, 7).where("held_out").count() == 1
    found = spark.createDataFrame([(1, 5, 9), (1, 2, 3)], "a long, near long, mid long")
    assert [tuple(r) for r in P.remap(found, spark.createDataFrame([(9,), (1,), (5,)], "id long")).collect()] == [(0, 1, 2)]
    groups = spark.createDataFrame([(g, 2) for g in range(50)], "grp long, n long")
    assert sorted(r.grp for r in P.subset_by_group(groups, 5).collect()) == [0, 1, 2]
    assert P.subset_by_group(groups, 5, seed=1).count() == 3
