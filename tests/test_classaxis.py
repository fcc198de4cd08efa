"""Orders of classes against plain numpy, and their edge cases."""

import itertools

import numpy as np
import pytest

from vicinal.operators import classaxis as X
from vicinal.operators import evaluate as Q


def table(spark, v, label, first=0):
    rows = [(first + i, None if a is None else [float(c) for c in a], None if b is None else int(b)) for i, (a, b) in enumerate(zip(v, label, strict=True))]
    return spark.createDataFrame(rows, "id long, v array<double>, label long")


def plain_auc(lo, hi):
    return np.mean([(h > low) + 0.5 * (h == low) for low in lo for h in hi])


def plain_direction(v, label, axis, pinned):
    known = np.isin(label, list(axis.rank))
    v, label = v[known], label[known]
    rank = np.array([axis.rank[c] for c in label])
    values = np.unique(rank)
    mean = [np.mean([v[label == c].mean(0) for c in np.unique(label[rank == r])], 0) for r in values]
    d = sum((r - values.mean()) * m for r, m in zip(values, mean, strict=True))
    use = [j for j in range(v.shape[1]) if not (axis.square and j in pinned)]
    u = np.zeros(v.shape[1])
    u[use] = d[use]
    if axis.whiten and len(use) > 1:
        s = np.cov(np.concatenate([v[rank == r] - v[rank == r].mean(0) for r in values])[:, use], rowvar=False)
        u[use] = np.linalg.solve(s + 1e-3 * np.trace(s) / len(s) * np.eye(len(s)), d[use])
    return u / np.linalg.norm(u)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    label = rng.choice([0, 1, 2, 3, 7], 260, p=[0.5, 0.2, 0.15, 0.1, 0.05])
    v = rng.normal(size=(260, 4)) * [3.0, 1.0, 0.5, 1.0] + np.outer(label, [0.8, 0.0, 0.3, 0.0]) + np.outer(label % 2, [0.5, 1.0, 0.0, 0.2])
    return np.round(v, 1), label  # rounded, so that values tie


def test_pairs_of_classes_are_those_of_brute_force(spark, data, monkeypatch):
    v, label = data
    rows = table(spark, v, label).selectExpr("label", "v[0] AS s")
    want = {(a, b): plain_auc(v[label == a, 0], v[label == b, 0]) for a, b in itertools.combinations([0, 1, 2, 3, 7], 2)}
    for size in (1 << 20, 5, 17):  # slices of one value, and of a few
        monkeypatch.setattr(Q, "SLICE", size)
        got = {(r.lo, r.hi): r.auc for r in Q.auc_pairs(rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    one = Q.auc_pairs(spark.createDataFrame([(1, 2.0), (2, 2.0), (2, None), (None, 1.0)], "label long, s double"))
    assert [tuple(r) for r in one.collect()] == [(1, 2, 0.5)]
    assert Q.auc_pairs(rows.limit(0)).count() == 0 and Q.auc_pairs(rows.where("label = 0")).count() == 0


def test_pairs_of_string_classes_over_many_stretches(spark):
    rng = np.random.default_rng(8)
    s, label = np.round(rng.normal(size=6000), 3), rng.integers(0, 3, 6000)
    rows = spark.createDataFrame([("xyz"[b], float(a)) for a, b in zip(s, label, strict=True)], "label string, s double")
    for r in Q.auc_pairs(rows).collect():
        lo, hi = s[label == "xyz".index(r.lo)], np.sort(s[label == "xyz".index(r.hi)])
        above = len(hi) - (np.searchsorted(hi, lo, "left") + np.searchsorted(hi, lo, "right")) / 2
        assert abs(r.auc - above.sum() / len(lo) / len(hi)) < 1e-12


def test_medians_are_numpys(spark, data):
    v, label = data
    got = {r.label: r.position for r in Q.class_positions(table(spark, v, label).selectExpr("label", "v[1] AS s")).collect()}
    assert got == pytest.approx({c: np.median(v[label == c, 1]) for c in (0, 1, 2, 3, 7)})


def test_directions_are_those_of_brute_force(spark, data):
    v, label = data
    axes = [X.grouped([[0, 2], [1, 3, 7]]), X.grouped([[0, 2], [1, 3, 7]], square=True), X.ordinal([0, 1, 2, 3, 7]), X.ordinal([7, 2, 0]), X.grouped([[3, 1], [0]], whiten=False)]
    rows = table(spark, [*v, None, v[0]], [*label, 0, None])  # a row without a vector and one without a class
    for axis in axes:
        u = X.direction(rows, axis, [0])
        assert u == pytest.approx(plain_direction(v, label, axis, [0]), abs=1e-9)
        assert not axis.square or (u[0] == 0 and X.tilt(u, [0]) == 0)


def test_report_is_that_of_brute_force(spark, data):
    v, label = data
    axes = [X.grouped([[0], [1, 2], [5], [3, 7]], 0, name="pinned"), X.grouped([[0, 2], [1, 3, 7]], name="free")]
    got = {r.name: r for r in X.report(table(spark, v, label), axes).collect()}
    for axis in axes:
        u = np.eye(4)[0] if axis.coordinate == 0 else plain_direction(v, label, axis, [0])
        ranks = sorted({axis.rank[c] for c in np.unique(label)})
        auc = {(a, b): plain_auc(v[label == a] @ u, v[label == b] @ u) for a in np.unique(label) for b in np.unique(label) if axis.rank[a] < axis.rank[b]}
        near = [x for (a, b), x in auc.items() if ranks.index(axis.rank[b]) - ranks.index(axis.rank[a]) == 1]
        r = got[axis.name]
        assert r.order_auc == pytest.approx(np.mean(list(auc.values())), abs=1e-6) and r.adjacent == pytest.approx(np.mean(near), abs=1e-6)
        assert r.tilt == pytest.approx(0 if axis.coordinate == 0 else np.degrees(np.arcsin(abs(u[0]))), abs=1e-6)


def test_without_a_direction_or_rows(spark):
    same = table(spark, [[1, 2, 3]] * 4, [0, 0, 1, 1])
    assert X.direction(same, X.ordinal([0, 1]), [0]).tolist() == [0, 1, 0]
    assert X.direction(same, X.ordinal([1, 5]), []).tolist() == [1, 0, 0]  # one rank has rows
    r = X.report(same, [X.ordinal([1, 5], name="alone")]).first()
    assert (r.order_auc, r.adjacent) == (None, None)
    with pytest.raises(ValueError, match="no rows"):
        X.direction(same.limit(0), X.ordinal([0, 1]))


def test_reading_interpolates_between_medians(spark):
    train = table(spark, [[0, 9], [0, 9], [10, 9], [10, 9], [10, 9], [30, 9]], [0, 0, 1, 2, 2, 3])
    readout = X.Readout.fit(train, X.ordinal(range(4), 0))
    asked = [-5, 0, 5, 10, 20, 30, 99]
    got = readout.position(table(spark, [*([a, 0] for a in asked), None], [0] * 8)).orderBy("id").collect()
    assert [r.position for r in got] == [*np.interp(asked, [0, 10, 10, 30], [0, 1, 2, 3]), None]
    score = {(r.id, r.label): r.score for r in readout.region(table(spark, [[10, 9]], [0], 100), 2).collect()}
    assert score == {(100, 0): 10.0, (100, 1): 0.0, (100, 2): 0.0, (100, 3): 20.0}  # smaller classes: their farthest row


def test_axes_that_cannot_hold_are_errors():
    ok = X.ordinal([0, 1, 2], 0)
    assert X.check([ok, X.grouped([[0], [1, 2]])], 2, range(3)) == 0 and X.check([], 2, range(3)) == 2
    bad = [[ok, X.ordinal([2, 1, 0], 1)], [ok, X.ordinal([2, 1, 0], 0)], [X.ordinal([0, 1], 0)], [X.ordinal([0, 1, 2], 5)], [X.ordinal([0, 1, 2], weight=0.0)], [X.Axis({0: 1.0, 1: 1.0, 2: 1.0})], [X.Axis({0: 1.0, 1: float("nan"), 2: 1.0})], [ok, X.ordinal([0, 1, 2]), X.ordinal([0, 2, 1])]]
    for axes in bad:
        with pytest.raises(ValueError):
            X.check(axes, 2, range(3))
    for groups in ([[0, 1], [1]], [[0, 1]], [[0], []]):
        with pytest.raises(ValueError):
            X.grouped(groups)
