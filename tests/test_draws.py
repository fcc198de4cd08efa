"""Alias tables, permutation tests, alignment, class order and path losses."""

import hashlib

import numpy as np
import pytest

from vicinal.operators import alias as A
from vicinal.operators import batch as T
from vicinal.operators import objectives as O
from vicinal.operators import paths as P
from vicinal.operators import sampling as S


def test_alias_tables_have_the_law_of_the_weights(spark, tmp_path):
    rng = np.random.default_rng(0)
    w = np.r_[rng.random(500) ** 4 * 10, 0.0, 300.0]
    rows = spark.createDataFrame([(i, f"k{i % 7}", float(x)) for i, x in enumerate(w)], "i long, k string, w double")
    t = A.build(rows, ["i", "k"], "w", str(tmp_path / "a"), shard_rows=40)
    law = {r.i: r.p for r in t.law().collect()}
    w = np.maximum(w, A.LEAST)
    assert len(law) == len(w) and all(abs(law[i] - x / w.sum()) < 1e-12 for i, x in enumerate(w))
    again = A.load(spark, str(tmp_path / "a"), ["i", "k"])
    drawn = again.draw(20_000, 3).collect()
    assert sorted(r.draw for r in drawn) == list(range(20_000)) and all(r.k == f"k{r.i % 7}" for r in drawn)
    seen = np.bincount([r.i for r in drawn], minlength=len(w))
    want = 20_000 * w / w.sum()
    big = want > 20
    assert (np.abs(seen - want)[big] < 5 * np.sqrt(want[big])).all() and seen[500] == 0
    assert [r.i for r in again.draw(50, 3).orderBy("draw").collect()] == [r.i for r in sorted(drawn)[:50]]
    assert A.build(rows.limit(1), ["i"], "w").draw(5).count() == 5
    with pytest.raises(ValueError):
        A.build(rows.limit(0), ["i"], "w")


@pytest.mark.parametrize("n", [1, 2, 5, 64, 100, 777])
def test_hashed_permutations_are_permutations(n):
    out = T.permuted(np.arange(n), n, T.keys(20, 4))
    assert all(sorted(row.tolist()) == list(range(n)) for row in out)
    assert n < 64 or len({tuple(r) for r in out.tolist()}) == 20
    if n == 777:  # no place is favoured
        means = T.permuted(np.arange(n), n, T.keys(2000, 1)).mean(0)
        assert np.abs(means - (n - 1) / 2).max() < 5 * n / np.sqrt(12 * 2000)


def test_batch_test_is_brute_force_over_the_same_labels(spark):
    rng = np.random.default_rng(2)
    calib, batch = np.round(rng.normal(size=90), 1), np.round(rng.normal(size=40) + 0.4, 1)
    df = lambda x: spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "id long, s double")
    got = T.batch_test(df(calib), df(batch), 500, 9).first()
    pool = sorted([(v, i, 0) for i, v in enumerate(calib)] + [(v, i, 1) for i, v in enumerate(batch)])
    rank = lambda flags: sum(k + 1 for k, f in enumerate(flags) if f) - 40 * 41 / 2
    seen = rank([x[2] for x in pool])
    places = T.permuted(np.arange(130), 130, T.keys(500, 9))
    ge = sum(rank(row < 40) >= seen for row in places)
    assert got.statistic == seen and got.p_global == (1 + ge) / 501 and (got.n_calib, got.n_batch) == (90, 40)
    assert abs(got.median_shift - (np.sort(batch)[19] - np.sort(calib)[44])) < 1e-12
    same = T.batch_test(df(calib), df(calib + 0.0), 200).first()
    assert same.p_global > 0.05
    assert T.batch_test(df([]), df([]), 10).first().p_global == 1.0


@pytest.mark.parametrize("d", [2, 3])
def test_alignment_is_found(spark, d):
    rng = np.random.default_rng(d)
    y = rng.normal(size=(50, d))
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    q[:, 0] *= np.sign(np.linalg.det(q))
    z = 2.5 * y @ q + 3
    rows = lambda z: spark.createDataFrame([(i, z[i].tolist(), y[i].tolist()) for i in range(50)], "id long, z array<double>, y array<double>").repartition(3)
    out, fit = O.procrustes(rows(z))
    assert np.allclose(fit["rotation"], q) and abs(fit["scale"] - 2.5) < 1e-9 and fit["loss"] < 1e-12
    assert all(np.allclose(r.aligned, r.z) for r in out.collect())
    out, fit = O.procrustes(rows(z + rng.normal(size=z.shape)))
    got = out.collect()
    assert abs(fit["loss"] - np.mean([(np.array(r.aligned) - r.z) ** 2 for r in got])) < 1e-9


def test_class_order_without_pairs(spark):
    rng = np.random.default_rng(5)
    lo, hi = np.round(rng.normal(size=70), 1), np.round(rng.normal(size=45) + 0.5, 1)
    df = lambda x: spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, s double")
    got = O.class_order(df(lo), df(hi), 0.5).first()
    a, b = np.repeat(lo, len(hi)), np.tile(hi, len(lo))
    s = np.std(np.r_[a, b], ddof=1)
    short = np.maximum(0.5 - (b - a) / s, 0)
    assert abs(got.loss - short.mean()) < 1e-9 and abs(got.active - (short > 1e-12).mean()) < 1e-9


def test_path_loss(spark):
    rng = np.random.default_rng(6)
    x = rng.random((200, 5)) + 0.01
    df = spark.createDataFrame(x.tolist(), "d_near double, d_mid double, d_far double, dt_near double, dt_mid double")
    n, m, f, a, b = x.T
    for log_space, floor in ((False, 0.0), (True, 0.3)):
        got, s = P.path_loss(df, log_space=log_space, floor=floor).first(), f.mean()
        rel = np.maximum(m, floor * s) / b / (np.maximum(n, floor * s) / a)
        r = np.log(rel) if log_space else rel
        low, high = (np.log(0.25), np.log(4)) if log_space else (0.25, 4)
        want = np.maximum(0.05 - (m - n) / s, 0).mean() + np.maximum(0.05 - (f - m) / s, 0).mean() + (np.maximum(low - r, 0) + np.maximum(r - high, 0)).mean()
        assert abs(got.loss - want) < 1e-9 and abs(got.ord_frac - ((n < m) & (m < f)).mean()) < 1e-12
    assert P.path_loss(df.limit(0)).first().loss == 0.0


def test_draws_are_where_the_running_sum_is_in_ranges_and_goes(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 700)  # three goes
    data = [(k % 7 if k % 11 else None, f"t{k:03}", float(1 + k % 13)) for k in range(300)]
    rows = spark.createDataFrame(data, "a long, b string, w double")
    got = {(r.a, r.b): r.draws for r in S.draw(rows, 2000, 5).collect()}
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ends = np.cumsum([r[2] for r in ordered])
    at = [int(hashlib.md5(f"5:{k}".encode()).hexdigest()[:13], 16) / 2**52 * ends[-1] for k in range(2000)]
    want = np.bincount(np.searchsorted(ends, at, side="right"), minlength=300)
    assert got == {r[:2]: n for r, n in zip(ordered, want.tolist(), strict=True) if n}
    assert S.draw(rows, 0, 5).count() == 0
