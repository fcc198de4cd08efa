"""Null models, exact quantiles and the agreement of maps against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import agreement as A
from vicinal.operators import nulls as N
from vicinal.operators.batch import keys, permuted
from vicinal.operators.sums import quantiles


def table(spark, v, first=0, parts=4):
    rows = [(first + i, None if a is None else [float(c) for c in a]) for i, a in enumerate(v)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(parts)


def matrix(df):
    rows = df.orderBy("id").collect()
    return [r.id for r in rows], np.array([r.v for r in rows])


def test_each_coordinate_is_permuted_on_its_own(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 5))
    want = np.zeros_like(v)
    for j, to in enumerate(permuted(np.arange(700), 700, keys(5, 9))):
        want[to, j] = v[:, j]
    assert not np.allclose(want, v) and np.allclose(np.sort(want, 0), np.sort(v, 0))
    for size in (1 << 22, 60):  # one block, and many of twelve rows
        monkeypatch.setattr(N, "VALUES", size)
        ids, got = matrix(N.shuffled(table(spark, [*v, None], 10, 7), 9))
        assert ids == list(range(10, 710)) and (got == want).all()
    assert abs(np.corrcoef(want[:, 0], want[:, 1])[0, 1]) < 0.15


def test_normal_rows_have_the_tables_moments(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 3)) @ [[2, 0, 0], [1, 0.5, 0], [3, 0.5, 0]] + [5, -1, 7]  # one coordinate is constant
    n, mean, cov = N.moments(table(spark, [*v, None]))
    assert n == 4000 and np.allclose(mean, v.mean(0)) and np.allclose(cov, np.cov(v, rowvar=False))
    _, x = matrix(N.gaussian(table(spark, v), 1))
    assert np.allclose(x.mean(0), mean, atol=0.2) and np.allclose(np.cov(x, rowvar=False), cov, rtol=0.1, atol=1e-6)
    _, again = matrix(N.gaussian(table(spark, v, parts=11), 1))
    assert np.allclose(again, x) and not np.allclose(matrix(N.gaussian(table(spark, v), 2))[1], x)


def test_nulls_of_no_row_and_of_one(spark):
    empty = table(spark, [[1.0, 2.0]]).limit(0)
    for null in (N.shuffled, N.gaussian):
        assert null(empty).columns == ["id", "v"] and null(empty).count() == 0
        assert matrix(null(table(spark, [[1.0, 2.0]])))[1].tolist() == [[1.0, 2.0]]


def test_quantiles_are_numpys(spark):
    x = np.round(np.random.default_rng(6).normal(size=501), 1)
    rows = spark.createDataFrame([(float(a),) for a in x] + [(None,)], "x double")
    at = [0.0, 0.25, 0.37, 0.5, 0.9, 1.0]
    assert quantiles(rows, "x", at) == pytest.approx(np.quantile(x, at))
    assert quantiles(rows, "x", at, between=False) == pytest.approx(np.quantile(x, at, method="lower"))
    assert quantiles(rows.limit(0), "x", [0.5]) == [None]


def test_turned_maps_agree_and_others_do_not(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(120, 2))
    turn = np.array([[np.cos(1.0), -np.sin(1.0)], [np.sin(1.0), np.cos(1.0)]])
    maps = {"a": table(spark, v), "b": table(spark, 3 * v @ turn + [4, 5]), "c": table(spark, v[::-1])}
    pairs, worst = A.persistence(maps, F.col("id") % 2 == 0, F.col("id") % 10 == 0, 5)
    got = {(r.a, r.b): r for r in pairs.collect()}
    same, other = got["a", "b"], got["a", "c"]
    assert same.median < 1e-9 and same.scale == pytest.approx(3) and same.spearman == pytest.approx(1) and same.jaccard == 1 and same.n_probe == 12
    assert other.median > 0.5 and other.jaccard < 0.3
    w = worst.first()
    assert (w.n_maps, w.n_pairs) == (3, 3) and w.coordinates_worst == max(r.median for r in got.values()) and w.jaccard_worst == min(r.jaccard for r in got.values())


def test_coordinates_left_are_those_of_brute_force(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(90, 3)), rng.normal(size=(90, 3))
    b += 2 * a
    got = A.disagreement(table(spark, a), table(spark, b), F.col("id") < 40)
    x, y = a[:40] - a[:40].mean(0), b[:40] - b[:40].mean(0)
    u, s, vt = np.linalg.svd(x.T @ y)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    r, scale = u @ flip @ vt, (s * np.diag(flip)).sum() / (x * x).sum()
    left = np.linalg.norm(scale * (a[40:] - a[:40].mean(0)) @ r + b[:40].mean(0) - b[40:], axis=1)
    spread = np.quantile(np.linalg.norm(b[40:] - b[40:].mean(0), axis=1), 0.5, method="lower")
    assert got["scale"] == pytest.approx(scale) and got["median"] == pytest.approx(np.quantile(left, 0.5, method="lower") / spread) and got["p90"] == pytest.approx(np.quantile(left, 0.9) / spread)
    assert set(A.disagreement(table(spark, a), table(spark, b), F.col("id") < 2).values()) == {None}
    with pytest.raises(ValueError, match="two maps"):
        A.persistence({"a": table(spark, a)}, F.lit(True), F.lit(True))
