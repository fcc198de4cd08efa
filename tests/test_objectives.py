"""Spanning trees, bucketed neighbours and the checks of vectors."""

import random

import numpy as np
import pytest

from vicinal.operators import knn as K
from vicinal.operators import objectives as O


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_vectors_of_other_length_or_infinite_are_errors(spark):
    for bad in ([1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [1.0, float("inf"), 0.0], [float("nan"), 0.0, 0.0]):
        with pytest.raises(Exception, match="vector"):
            K.checked(vectors(spark, [[0, 0, 1], [1, 1, 1], bad])).collect()
    assert K.checked(vectors(spark, [[0, 0, 1]])).count() == 1 and K.checked(vectors(spark, [[0]]).limit(0)).count() == 0


def test_bucketed_neighbours_are_those_of_shared_buckets(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(120, 5)), 2)
    x[40:60] = x[3]  # ties by id
    e = K.checked(vectors(spark, x))
    got = {(r.i, r.rk): r.j for r in K.knn_bucketed(e, e.where("id < 6"), 4, 2, 2).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(d[:, :6], 1, kind="stable")[:, :2]
    for i in range(120):
        js = [j for j in range(120) if j != i and set(near[i]) & set(near[j])]
        js = js if len(js) >= 4 else [j for j in range(120) if j != i]
        assert [got[i, k] for k in (1, 2, 3, 4)] == sorted(js, key=lambda j: (d[i, j], j))[:4]


def test_spanning_tree_in_rounds_is_the_small_one(spark):
    rnd = random.Random(2)
    rows = [(i, j, float(rnd.randrange(20))) for i in range(14) for j in range(i + 1, 14) if rnd.random() < 0.4 and (i < 10) == (j < 10)]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = spark.createDataFrame(rows, "i long, j long, d double")
    got = O.spanning_tree(edges, spark.range(14)).collect()
    assert sorted(map(tuple, got)) == sorted(O.small_tree(edges.collect()))
