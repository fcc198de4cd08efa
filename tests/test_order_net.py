"""Nets over the whole order of rows, where bunches save nothing."""

import numpy as np
import pytest
from test_structure import greedy, islands, vectors

from vicinal.operators import cover as N


@pytest.mark.parametrize("size", [8192, 16])
def test_net_in_order_is_the_sequential_one(spark, monkeypatch, size):
    monkeypatch.setattr(N, "ROUND", size)
    x, radii = islands(1), [0.1, 0.3, 0.7, 2.0, 50.0]
    got = N.in_order(vectors(spark, x), radii).collect()
    for k, r in enumerate(radii):
        assert {row.id for row in got if row.reps >> k & 1} == greedy(x, r)


def test_crowded_bunches_are_not_copied(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(120, 16))
    e = vectors(spark, x)
    monkeypatch.setattr(N, "placed", lambda *_: pytest.fail("rows were copied to all bunches"))
    got = {r.radius: r.n for r in N.cover_counts(e, e.where("id < 16"), [3.0, 4.5], 8).collect()}
    assert got == {r: len(greedy(x, r)) for r in (3.0, 4.5)}
