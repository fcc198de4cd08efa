"""Pairs of rows by kernels, and neighbours that a task keeps over all blocks it meets."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinal.functions import metrics as V
from vicinal.operators import knn as K


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, x)], "id long, v array<double>")


SPECS = [*V.METRICS.values(), V.composite_spec([(0, 2, "l2", 2.0), (2, 5, "l1", 0.5)], [1.5, 4.0]), V.factor_spec(V.scale_quotient(2, 1.0, 0.5))]


@pytest.mark.parametrize("m", SPECS, ids=lambda m: m.name)
def test_kernels_are_the_expressions(spark, m):
    x = np.random.default_rng(5).normal(size=(40, 5))
    x[3], x[4], x[5] = 0, 1, x[6]
    e = vectors(spark, x)
    got = {(r.i, r.j): r.d for r in K.pair_distances(e.where("id % 5 < 3"), e, m, F.col("i") != F.col("j")).collect()}
    pairs = e.where("id % 5 < 3").select(F.col("id").alias("i"), F.col("v").alias("x")).crossJoin(e.select(F.col("id").alias("j"), F.col("v").alias("y"))).where("i != j")
    want = {(r.i, r.j): r.d for r in pairs.select("i", "j", m(F.col("x"), F.col("y")).alias("d")).collect()}
    assert m.kernel is not None and set(got) == set(want)
    assert max(abs(got[p] - want[p]) for p in want) < 1e-7


def test_a_task_keeps_the_first_k_over_its_blocks():
    x = np.random.default_rng(6).normal(size=(700, 4))
    x[100:140] = x[7]
    ids = np.arange(700)
    raw = lambda a, t: a.astype(t).tobytes()
    batch = pa.RecordBatch.from_pydict({"qi": [raw(ids, "<i8")] * 7, "qm": [raw(x, "<f8")] * 7, "ci": [raw(ids[k::7], "<i8") for k in range(7)], "cm": [raw(x[k::7], "<f8") for k in range(7)]})
    ((qi, a, others),) = ((qi, a, list(o)) for qi, a, o in K.runs(iter([batch])))
    best = K.Nearest(qi, a, 5, True)
    for ci, b in others:
        best.add(ci, b)
    row, j, d = best.out()
    assert len(row) == 700 * 5  # before: as many for each block
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(full, np.inf)
    assert (j.reshape(700, 5) == np.array([np.lexsort((ids, full[i]))[:5] for i in range(700)])).all()


def test_ranks_around_probes_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "RANKED", 3000)  # several groups
    x = np.random.default_rng(8).normal(size=(90, 4))
    x[50] = x[51]
    e = vectors(spark, x)
    got = {r.i: r for r in K.probe_ranks([e, e.select("id", F.slice("v", 1, 2).alias("v"))], F.col("id") % 10 == 0, 5).collect()}
    assert sorted(got) == list(range(0, 90, 10))
    for i, r in got.items():
        other = [j for j in range(90) if j != i]
        order = [sorted(other, key=lambda j, y=y: (np.sqrt(((y[i] - y[j]) ** 2).sum()), j)) for y in (x, x[:, :2])]
        places = [[o.index(j) for j in other] for o in order]
        assert abs(r.rho - np.corrcoef(*places)[0, 1]) < 1e-12 and r.n == len({*order[0][:5]} & {*order[1][:5]}) and r.m == 89


def test_bands_end_at_exact_quantiles(spark, monkeypatch):
    from vicinal.operators import evaluate as Q

    monkeypatch.setattr(Q.F, "percentile", lambda *_: pytest.fail("all values would meet in one task"))
    g = np.random.default_rng(9).normal(size=300)
    rows = spark.createDataFrame([(float(a), float(a * a)) for a in g], "g double, e double")
    q = np.quantile(g, [0, 1 / 3, 2 / 3, 1])
    got = {r.band: r.n for r in Q.shepard_banded(rows).collect()}
    assert got == {k + 1: int(((g >= q[k]) & (g <= q[k + 1])).sum()) for k in range(3)}


@pytest.mark.parametrize("name", ["braycurtis", "jensenshannon"])
def test_all_distances_are_both_orders_of_all_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(K, "BLOCK", 32)
    x = np.random.default_rng(6).normal(size=(150, 4))
    e = vectors(spark, x, [*range(149), 0])  # an id twice
    rows = lambda df: sorted((r.i, r.j, round(r.d, 12)) for r in df.collect())
    got = rows(K.all_distances(e, name))
    assert got == rows(K.pair_distances(e, e, name, F.col("i") != F.col("j"))) and len(got) == 150 * 149 - 2


def test_class_sums_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 32)
    monkeypatch.setattr(K, "SUMS", 500)  # given out along the way
    rng = np.random.default_rng(9)
    x, label = rng.normal(size=(150, 4)), rng.integers(0, 4, 150)
    x[20:30] = x[3]
    rows = spark.createDataFrame([(i, [float(c) for c in v], None if i % 10 == 0 else int(label[i])) for i, v in enumerate(x)], "id long, v array<double>, label int")
    got = {(r.i, r.label): (r.n, r.s0, r.s1) for r in K.class_sums(rows, [None, 2]).collect()}
    for i in range(150):
        for c in range(4):
            own = [j for j in range(150) if j != i and j % 10 and label[j] == c]
            want = (len(own), *(np.sqrt(((x[own, :k] - x[i, :k]) ** 2).sum(1)).sum() for k in (4, 2)))
            assert np.allclose(got[i, c], want, rtol=1e-9, atol=1e-9)
    assert len(got) == 600
