"""Orders of classes along a coordinate or a direction of vectors.

An ``Axis`` says which classes come before which, and where: on a coordinate that it
pins, or along whatever direction parts its classes best. Tables are (id, v, label);
rows without a vector, a label or a rank of the axis are left out. Only class means,
one matrix and the counts of pairs of classes are gathered, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.operators import evaluate as Q
from vicinal.operators import knn as K
from vicinal.operators.lineage import cut
from vicinal.operators.objectives import class_order
from vicinal.operators.sums import summed

#: Share of the mean variance that is added to each coordinate's before solving.
RIDGE = 1e-3


@dataclass(frozen=True)
class Axis:
    """An order of classes: ``rank`` by class, where equal ranks are not ordered and
    distances mean nothing. ``coordinate`` is the pinned one, or none. A free axis may
    be kept ``square`` to the pinned coordinates, and its direction is taken in the
    metric of the spread within ranks (``whiten``). ``weight`` is for objectives."""

    rank: dict[int, float] = field(hash=False)
    coordinate: int | None = None
    name: str = "class"
    weight: float = 1.0
    square: bool = False
    whiten: bool = True


def grouped(groups: Sequence[Iterable[int]], coordinate: int | None = None, **rest) -> Axis:
    """An axis of groups of classes from low to high; each class is in one of them."""
    groups = [list(g) for g in groups]
    rank = {c: float(k) for k, g in enumerate(groups) for c in g}
    if len(rank) < sum(map(len, groups)):
        raise ValueError("a class is in two groups")
    if len(groups) < 2 or not all(groups):
        raise ValueError("an order needs two groups or more, none of them empty")
    return Axis(rank, coordinate, **rest)


def ordinal(order: Iterable[int], coordinate: int | None = None, **rest) -> Axis:
    """An axis of single classes from low to high."""
    return grouped([[c] for c in order], coordinate, **rest)


def check(axes: Sequence[Axis], width: int, classes: Iterable[int]) -> int:
    """Raise ValueError unless the axes can hold together in ``width`` coordinates:
    pinned ones are distinct and leave one coordinate or more, there are no more axes
    than coordinates, and each orders just the given classes by finite ranks that
    differ. Returns how many directions are left to the data."""
    pinned, classes = [a.coordinate for a in axes if a.coordinate is not None], set(classes)
    if len(axes) and len(pinned) >= width:
        raise ValueError(f"{len(pinned)} pinned axes leave no coordinate of {width} free")
    if len(axes) > width:
        raise ValueError(f"{len(axes)} axes in {width} coordinates")
    if len(set(pinned)) < len(pinned):
        raise ValueError("two axes pin one coordinate")
    for a in axes:
        if a.coordinate is not None and not 0 <= a.coordinate < width:
            raise ValueError(f"axis {a.name}: no coordinate {a.coordinate}")
        if not a.weight > 0 or not math.isfinite(a.weight):
            raise ValueError(f"axis {a.name}: weight {a.weight}")
        if set(a.rank) != classes:
            raise ValueError(f"axis {a.name} ranks other classes than there are")
        if not all(map(math.isfinite, a.rank.values())) or len(set(a.rank.values())) < 2:
            raise ValueError(f"axis {a.name}: ranks must be finite and differ")
    return width - len(axes)


def _ranked(rows: DataFrame, axis: Axis) -> DataFrame:
    """The rows (v, label) that the axis orders."""
    return rows.where(F.col("v").isNotNull() & F.col("label").isin(list(axis.rank))).select("v", F.col("label").cast("long").alias("label"))


def direction(rows: DataFrame, axis: Axis, pinned: Sequence[int] = ()) -> np.ndarray:
    """The unit direction along which the axis's ranks come apart, from low to high.

    The means of the ranks (of each rank its classes' means, alike for small and large
    ones) are weighted by rank less the mean rank; with ``whiten`` the sum is taken in the
    metric of the covariance within ranks, for two ranks Fisher's discriminant. With ``square``
    the pinned coordinates are left out from the start. Where no direction parts the
    ranks, as with one rank only, it is the first coordinate not pinned. No rows at all
    are an error. Two passes over the rows: means, then products about them."""
    known = _ranked(rows, axis)

    def sums(v: np.ndarray, label: np.ndarray) -> dict:
        return {int(c): np.r_[np.sum(label == c), v[label == c].sum(0)] for c in np.unique(label)}

    by_class = summed(known, sums)
    if not by_class:
        raise ValueError(f"axis {axis.name}: no rows of its classes")
    ranks = sorted({axis.rank[c] for c in by_class})
    of = {r: [by_class[c] for c in by_class if axis.rank[c] == r] for r in ranks}
    means = np.array([np.mean([s[1:] / s[0] for s in of[r]], 0) for r in ranks])
    delta = (np.array(ranks) - np.mean(ranks)) @ means
    free = [j for j in range(len(delta)) if j not in set(pinned)]
    use = free if axis.square else list(range(len(delta)))
    u = np.zeros(len(delta))
    u[use] = delta[use]
    if axis.whiten and len(use) > 1:
        total = {r: np.sum(of[r], 0) for r in ranks}
        centre = {c: total[axis.rank[c]][1:] / total[axis.rank[c]][0] for c in by_class}

        def products(v: np.ndarray, label: np.ndarray) -> dict:
            c, at = np.unique(label, return_inverse=True)
            x = (v - np.array([centre[k] for k in c.tolist()])[at])[:, use]
            return {0: (x.T @ x).ravel()}

        n = sum(t[0] for t in total.values())
        s = summed(known, products)[0].reshape(len(use), -1) / max(n - 1, 1)
        s += RIDGE * max(np.diag(s).mean(), 1e-12) * np.eye(len(use))
        u[use] = np.linalg.solve(s, delta[use])
    size = np.linalg.norm(u)
    if not np.isfinite(size) or size < 1e-12:
        u[:] = 0.0
        u[free[0]] = size = 1.0
    return u / size


def tilt(u: np.ndarray, pinned: Sequence[int]) -> float:
    """Degrees by which a unit direction leans into the pinned coordinates (0 to 90)."""
    return math.degrees(math.asin(min(1.0, float(np.linalg.norm(np.asarray(u)[list(pinned)]))))) if len(pinned) else 0.0


def along(v: Column, u: np.ndarray) -> Column:
    """The coordinate of a vector column along ``u``; coordinates of weight 0 are not read."""
    terms = [v[j] * float(x) for j, x in enumerate(u) if x != 0]
    return sum(terms[1:], terms[0])


def _line(rows: DataFrame, axis: Axis, pinned: Sequence[int]) -> np.ndarray:
    """What the axis is read along: its coordinate's unit vector, or its direction."""
    if axis.coordinate is None:
        return direction(rows, axis, pinned)
    first = rows.where("v IS NOT NULL").select(F.size("v").alias("n")).first()
    if first is None:
        raise ValueError(f"axis {axis.name}: no rows")
    return np.eye(first.n)[axis.coordinate]


def report(rows: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """How well each axis's order holds: (name, order_auc, adjacent, tilt, direction).

    ``order_auc`` is the mean, over pairs of classes of unlike rank, of the probability
    that of a row of each the one of the higher rank lies higher (ties one half), and
    ``adjacent`` that over pairs of consecutive ranks among the classes that have rows; null if there is no
    such pair. A free direction is fitted to the same rows, so chance lies above 0.5."""
    rows = cut(rows.select("v", "label"))
    pinned, spark, out = [a.coordinate for a in axes if a.coordinate is not None], rows.sparkSession, None
    for a in axes:
        u = _line(rows, a, pinned)
        known = _ranked(rows, a)
        present = [r.label for r in known.select("label").distinct().collect()]
        place = {r: k for k, r in enumerate(sorted({a.rank[c] for c in present}))}
        side = lambda c: spark.createDataFrame([(k, place[a.rank[k]]) for k in present], f"{c} long, p_{c} long")  # noqa: B023, E731
        pairs = Q.auc_pairs(known.select("label", along(F.col("v"), u).alias("s")))
        pairs = pairs.join(F.broadcast(side("lo")), "lo").join(F.broadcast(side("hi")), "hi").where("p_lo <> p_hi")  # a row a class
        right = F.when(F.col("p_lo") < F.col("p_hi"), F.col("auc")).otherwise(1 - F.col("auc"))
        one = pairs.agg(F.avg(right).alias("order_auc"), F.avg(F.when(F.abs(F.col("p_lo") - F.col("p_hi")) == 1, right)).alias("adjacent"))
        one = one.select(F.lit(a.name).alias("name"), "order_auc", "adjacent", F.lit(0.0 if a.coordinate is not None else tilt(u, pinned)).alias("tilt"), F.array(*(F.lit(float(x)) for x in u)).alias("direction"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no axes")
    return out


def direction_loss(rows: DataFrame, axis: Axis, pinned: Sequence[int] = (), margin: float = 0.5) -> DataFrame:
    """The hinge of ``class_order`` along the direction of an axis of two ranks, over
    all pairs of a row of each: (loss, active)."""
    low, high = sorted(set(axis.rank.values()))
    u = _line(rows, axis, pinned)
    s = lambda r: rows.where(F.col("v").isNotNull() & F.col("label").isin([c for c in axis.rank if axis.rank[c] == r])).select("id", along(F.col("v"), u).alias("s"))
    return class_order(s(low), s(high), margin)


@dataclass
class Readout:
    """Where rows lie on an order: ``u`` is what it is read along, ``places`` the
    classes' medians there with their ranks, ``rows`` the (id, v, label) of training."""

    u: np.ndarray
    places: list[tuple[float, float]]
    rows: DataFrame

    @staticmethod
    def fit(rows: DataFrame, axis: Axis, axes: Sequence[Axis] = ()) -> Readout:
        """Read from training rows; the pinned coordinates are those of ``axes``."""
        u = _line(rows, axis, [a.coordinate for a in axes if a.coordinate is not None])
        known = _ranked(rows, axis).select("label", along(F.col("v"), u).alias("s"))
        places = sorted((float(r.position), axis.rank[r.label]) for r in Q.class_positions(known).collect())  # a row a class
        if not places:
            raise ValueError(f"axis {axis.name}: no rows of its classes")
        return Readout(u, places, rows)

    def position(self, rows: DataFrame) -> DataFrame:
        """(id, position): ranks between the classes' medians by straight lines, those of the ends
        beyond them; at equal medians the highest rank. Null without a vector."""
        s, n = along(F.col("v"), self.u), len(self.places)
        at, rank = (F.array(*(F.lit(p[k]) for p in self.places)) for k in (0, 1))
        low, high = (F.get(x, F.col("_k") - 1) for x in (at, rank)), (F.get(x, F.col("_k")) for x in (at, rank))
        (x0, y0), (x1, y1) = low, high
        between = y0 + (F.col("_s") - x0) / (x1 - x0) * (y1 - y0)
        k = rows.select("id", s.alias("_s")).withColumn("_k", F.size(F.filter(at, lambda x: x <= F.col("_s"))))
        position = F.when(F.col("_s").isNull(), None).when(F.col("_k") == 0, F.lit(self.places[0][1])).when(F.col("_k") == n, F.lit(self.places[-1][1])).otherwise(between)
        return k.select("id", position.alias("position"))

    def region(self, rows: DataFrame, k: int = 5) -> DataFrame:
        """(id, label, score): the distance to the k-th nearest training row of each
        class, other than the row itself; of a smaller class to its farthest."""
        near = K.class_nearest(rows, self.rows.where("label IS NOT NULL"), k)
        return near.groupBy(F.col("i").alias("id"), "label").agg(F.max("d").alias("score"))
