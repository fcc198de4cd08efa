"""A whole neighbour graph: net, multiplicities, neighbours, union and backbone in one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators import cover
from vicinal.operators import graph as G
from vicinal.operators import knn as K
from vicinal.operators import objectives as O
from vicinal.operators.lineage import cut


#: Components that are merged on the driver at most.
FEW = 1 << 18
#: Neighbours of each row among which its shortest edge out of its component is sought first.
LIST = 16


@dataclass(frozen=True)
class Graph:
    """``members`` (id, rep, d), ``reps`` (id, weight: rows it stands for), ``knn`` of
    the representatives (i, rk, j, d) and ``edges`` (src, dst, w), src < dst."""

    members: DataFrame
    reps: DataFrame
    knn: DataFrame
    edges: DataFrame


def with_backbone(edges: DataFrame, backbone: DataFrame) -> DataFrame:
    """The larger weight of each pair in either table, over the largest of all."""
    spine = backbone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    both = edges.select("src", "dst", "w").unionByName(spine).groupBy("src", "dst").agg(F.max("w").alias("w"))
    top = both.agg(F.max("w").alias("top"))
    return both.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("w") / F.col("top")).alias("w")).where("w > 0")  # one row


def graph(df: DataFrame, landmarks: DataFrame, delta: float, k: int, bunches: int = 8, backbone: float = 0.01, closed_form: bool = False, seed: int = 0) -> Graph:
    """Net of ``df`` (id, v) at ``delta`` by bunches, the k neighbours of its
    representatives, their fuzzy union weighted by multiplicities, and the landmarks'
    spanning tree in it. The same graph for any number of bunches."""
    members = cut(cover.owned_net(df, landmarks, delta, bunches, seed))
    reps = cut(members.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("weight")))
    rows = cut(df.join(reps.select("id"), "id", "left_semi"))
    knn = cut(K.knn(rows, k))
    edges = G.fuzzy_union(knn, G.smooth(knn, closed_form=closed_form), reps)
    return Graph(members, reps, knn, with_backbone(edges, O.backbone(landmarks, rows, backbone)))


def contracted(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(root, new): components joined by ``edges`` (i, j) between them; at most ``FEW``
    are joined on the driver, to the same result."""
    if sizes.limit(FEW + 1).count() > FEW:
        return K.components(sizes.select(F.col("root").alias("id")), edges.select("i", "j")).select(F.col("id").alias("root"), F.col("root").alias("new"))
    up = {r.root: r.root for r in sizes.select("root").collect()}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in edges.select("i", "j").collect():  # an edge a component at most
        a, b = sorted((top(r.i), top(r.j)))
        up[b] = a
    return sizes.sparkSession.createDataFrame([(x, top(x)) for x in up], "root long, new long")


def between(query: DataFrame, corpus: DataFrame) -> DataFrame:
    """(root, d, lo, hi): the shortest pair from each component of ``query`` (id, v,
    root) to another in ``corpus``, ties by ids. A task keeps one for each component of a
    block over all blocks that it meets; components ride with the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, a, others in K.runs(batches):
            ra, a = a[:, -1].astype("<i8"), a[:, :-1]
            roots, own = np.unique(ra, return_inverse=True)
            norm = (a * a).sum(1)
            left = np.hstack([-2 * a, norm[:, None], np.ones((len(a), 1))])
            d, lo, hi = np.full(len(roots), np.inf), np.zeros(len(roots), np.int64), np.zeros(len(roots), np.int64)
            for ci, b in others:
                rb, b = b[:, -1].astype("<i8"), b[:, :-1]
                other = (b * b).sum(1)
                right, off, most = np.hstack([b, np.ones((len(b), 1)), other[:, None]]).T, K.ROUNDING * (norm + other.max()), (d**2)[own]
                found = []
                for at in range(0, len(a), K.STRIP):
                    strip = slice(at, at + K.STRIP)
                    g, bound = left[strip] @ right, most[strip]
                    if not np.isfinite(bound).all():
                        bound = np.minimum(bound, np.where(ra[strip, None] == rb[None], np.inf, g).min(1) + off[strip])
                    found.append(np.flatnonzero(g <= (bound + off[strip])[:, None]) + at * len(ci))
                row, col = np.divmod(np.concatenate(found), len(ci))
                apart = ra[row] != rb[col]
                row, col = row[apart], col[apart]
                e, x, y, r = K.exact(a, b, row, col), np.minimum(qi[row], ci[col]), np.maximum(qi[row], ci[col]), own[row]
                e, x, y, r = np.r_[d, e], np.r_[lo, x], np.r_[hi, y], np.r_[np.arange(len(roots)), r]
                order = np.lexsort((y, x, e, r))
                first = order[np.searchsorted(r[order], np.arange(len(roots)))]
                d, lo, hi = e[first], x[first], y[first]
            some = np.isfinite(d)
            yield pa.RecordBatch.from_pydict({"root": roots[some], "d": d[some], "lo": lo[some], "hi": hi[some]})

    packed = lambda df: df.select("id", F.concat("v", F.array(F.col("root").cast("double"))).alias("v"))
    some = K.block_pairs(packed(query), packed(corpus)).mapInArrow(run, "root long, d double, lo long, hi long")
    return some.groupBy("root").agg(F.min(F.struct("d", "lo", "hi")).alias("b")).select("root", "b.*")


def bridges(df: DataFrame, pairs: DataFrame, near: DataFrame | None = None, k: int = LIST) -> DataFrame:
    """(src, dst, d): the fewest and shortest edges that make the graph ``pairs`` (i,
    j) over ``df`` (id, v) connected: each round every component but the largest takes
    its shortest edge out, ties by ids, so the number of components at least halves.
    Ids below 2**53.

    The ``k`` neighbours of each row, ``near`` (i, rk, j, d) if given, are taken once. A row's
    first neighbour outside its component is its shortest edge out; a row without one
    among its neighbours has none shorter than to the last of them, so only those
    are compared with all rows whose component has found no shorter edge."""
    df = df.select("id", "v")
    near = cut(K.knn(df, k)) if near is None else near
    rows = cut(K.components(df, pairs))
    found = rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d")).limit(0)
    edge = F.struct("d", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    while True:
        sizes = cut(rows.groupBy("root").agg(F.count("*").alias("n")))
        if sizes.limit(2).count() < 2:
            return found
        large = sizes.agg(F.max(F.struct("n", "root")).alias("m")).first().m.root
        held = rows.where(F.col("root") != large).withColumnRenamed("id", "i").join(near, "i", "left").join(rows.select(F.col("id").alias("j"), F.col("root").alias("_other")), "j", "left")
        per = cut(held.groupBy("i", "root").agg(F.min(F.when(F.col("root") != F.col("_other"), edge)).alias("b"), F.max("d").alias("reach"), F.count("j").alias("c")))
        best = per.groupBy("root").agg(F.min("b").alias("b"))
        far = per.where(F.col("b").isNull() & (F.col("c") == k)).select("i", "root", "reach").join(best, "root").where(F.col("b").isNull() | (F.col("reach") <= F.col("b.d")))
        far = cut(far.select(F.col("i").alias("id"), "root"))
        best = best.where("b IS NOT NULL").select("root", "b.*")
        if not far.isEmpty():
            best = best.unionByName(between(far.join(df, "id"), rows.join(df, "id"))).groupBy("root").agg(F.min(F.struct("d", "lo", "hi")).alias("b")).select("root", "b.*")
        edges = cut(best.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "d").distinct())
        found = cut(found.unionByName(edges))
        joined = edges.join(rows.withColumnsRenamed({"id": "src", "root": "i"}), "src").join(rows.withColumnsRenamed({"id": "dst", "root": "j"}), "dst")
        merged = contracted(joined, sizes)
        rows = cut(rows.join(merged, "root").select("id", F.col("new").alias("root")))


@dataclass(frozen=True)
class Level:
    """A level of a pyramid: ``edges`` (src, dst, w), ``reps`` (id, weight) and
    ``mapping`` (id, to) from the representatives of the level below."""

    edges: DataFrame
    reps: DataFrame
    mapping: DataFrame | None


def pyramid(df: DataFrame, landmarks: DataFrame, finest: Graph, scales: int = 3, ratio: float = 4.0, least: int = 256, bridge: float = 1.0, mode: str = "rational_q99", bunches: int = 8, grid: int = 12, seed: int = 0) -> list[Level]:
    """``finest`` and up to ``scales`` coarser levels, each of at most the size of the
    first over ``ratio`` ** level (or ``least``): the largest net of the level below
    that fits, among radii counted in one pass. Weights between cells add up and are
    squashed; a coarsest level in parts is joined by its shortest bridges, of weight
    ``bridge``. Levels stop where one would not be smaller."""
    levels = [Level(finest.edges, finest.reps, None)]
    first = size = finest.reps.count()
    rows = cut(df.join(finest.reps.select("id"), "id", "left_semi").select("id", "v"))
    for level in range(1, scales + 1):
        target = max(round(first / ratio**level), least)
        if target >= size:
            break
        near = K.one_nn(rows).agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
        wide = max(near.b, 1e-12) * 2.0
        radii = [near.a + (wide - near.a) * k / grid for k in range(1, grid + 1)]
        sized = cover.bunched(rows, landmarks, max(radii), bunches, seed + level)
        reps = cover.greedy(sized, radii)
        fits = sorted((r.radius, r.n) for r in cover.counts(reps, radii).collect() if r.n <= target)
        if not fits:
            break
        at = radii.index(fits[0][0])
        chosen = reps.where(F.getbit("reps", F.lit(at)) == 1)
        mapping = cut(cover.members(sized, chosen).select("id", F.col("rep").alias("to")))
        edges = cut(G.coarsen(levels[-1].edges, mapping, mode))
        weights = mapping.join(levels[-1].reps, "id").groupBy(F.col("to").alias("id")).agg(F.sum("weight").alias("weight"))
        levels.append(Level(edges, cut(weights), mapping))
        rows = cut(rows.join(weights.select("id"), "id", "left_semi"))
        size = rows.count()
        if size <= least:
            break
    if bridge > 0 and len(levels) > 1:
        top = levels[-1]
        more = bridges(rows, top.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"))).select("src", "dst", F.lit(bridge).alias("w"))
        levels[-1] = Level(cut(top.edges.unionByName(more)), top.reps, top.mapping)
    return levels
