"""Objectives of a map as aggregates, spanning trees, shares and plans.

Tables of pairs have (i, j, d) with ids and an original distance; a map is
(id, v). Everything is a join and an aggregate; only ``spanning_tree`` iterates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions.metrics import METRICS
from vicinal.operators import knn as K
from vicinal.operators.lineage import cut
from vicinal.operators.order import before

TINY, LEAST_PROB = 1e-12, 1e-7
#: Landmarks whose pairs may be sorted on the driver.
FEW = 512


def mapped(pairs: DataFrame, z: DataFrame) -> DataFrame:
    """Pairs (i, j, ...) with ``e``, their distance in the map."""
    x, y = z.select(F.col("id").alias("i"), F.col("v").alias("_x")), z.select(F.col("id").alias("j"), F.col("v").alias("_y"))
    return pairs.join(x, "i").join(y, "j").withColumn("e", METRICS["l2"](F.col("_x"), F.col("_y"))).drop("_x", "_y")


def scale_free_stress(pairs: DataFrame) -> DataFrame:
    """Residual of e against s * d at the least-squares s, over the mean e * e:
    the local isometry of edges, the geodesic stress of landmark pairs."""
    ee, ed, dd = (F.sum(F.col(a) * F.col(b)) for a, b in (("e", "e"), ("e", "d"), ("d", "d")))
    s = pairs.agg(ee.alias("ee"), ed.alias("ed"), dd.alias("dd"), F.count("*").alias("n"))
    scale = F.col("ed") / F.greatest("dd", F.lit(TINY))
    left = F.col("ee") - 2 * scale * F.col("ed") + scale * scale * F.col("dd")
    return s.select(scale.alias("scale"), F.coalesce(left / F.greatest("ee", F.col("n") * TINY), F.lit(0.0)).alias("loss"))


def affinity(e: Column, a: float, b: float) -> Column:
    """1 / (1 + a * d ** (2 b)), kept off 0 and 1."""
    q = 1 / (1 + a * F.pow(e * e + 1e-10, b))
    return F.least(F.greatest(q, F.lit(LEAST_PROB)), F.lit(1 - LEAST_PROB))


def fuzzy_cross_entropy(edges: DataFrame, apart: DataFrame, a: float, b: float) -> DataFrame:
    """Attraction of edges (w, e) and repulsion of the pairs ``apart`` (e)."""
    pull = edges.agg((-F.avg(F.col("w") * F.ln(affinity(F.col("e"), a, b)))).alias("attraction"))
    push = apart.agg((-F.avg(F.ln(F.greatest(1 - affinity(F.col("e"), a, b), F.lit(LEAST_PROB))))).alias("repulsion"))
    return pull.crossJoin(push).withColumn("loss", F.col("attraction") + F.col("repulsion"))  # one row each


def ordinal_triplets(rows: DataFrame, prior: float = 1.0) -> DataFrame:
    """-log sigmoid of ordered gaps of (near, mid, far), over a running scale
    that was ``prior``."""
    scale = rows.agg(F.greatest(0.9 * prior + 0.1 * F.avg("far"), F.lit(1e-6)).alias("scale"))
    soft = lambda x: F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    loss = soft((F.col("mid") - F.col("near")) / F.col("scale")) + soft((F.col("far") - F.col("mid")) / F.col("scale"))
    return rows.crossJoin(F.broadcast(scale)).agg(F.avg(loss).alias("loss"), F.max("scale").alias("scale"))  # one row


def mean_affinity(a: DataFrame) -> DataFrame:
    """(l, a): the mean of each landmark's affinities (id, l, a)."""
    return a.groupBy("l").agg(F.avg("a").alias("a"))


def landmark_regularisation(a: DataFrame, eta: float = 1.0) -> DataFrame:
    """Soft quantisation error of (id, l, d, a) less the entropy of the mean affinities."""
    quant = a.groupBy("id").agg(F.sum(F.col("a") * F.col("d")).alias("q")).agg(F.avg("q").alias("quant"))
    m = F.greatest("a", F.lit(TINY))
    ent = mean_affinity(a).agg((-F.sum(m * F.ln(m))).alias("entropy"))
    return quant.crossJoin(ent).withColumn("loss", F.col("quant") - eta * F.col("entropy"))  # one row each


def affinity_stats(a: DataFrame) -> DataFrame:
    """Quantiles of the rows' perplexities, and the entropy of the landmarks' use."""
    m = F.greatest("a", F.lit(TINY))
    perp = a.groupBy("id").agg(F.exp(-F.sum(F.col("a") * F.ln(m))).alias("p"))
    low = perp.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p)").alias("perp_median"), F.percentile("p", F.lit(0.1)).alias("perp_p10"), F.percentile("p", F.lit(0.9)).alias("perp_p90"))
    mass = mean_affinity(a)
    p = F.greatest(F.col("a"), F.lit(TINY))
    use = mass.agg((-F.sum(F.col("a") * F.ln(p))).alias("usage_ent"), F.count("*").alias("n"))
    use = use.select("usage_ent", (F.col("usage_ent") / F.ln("n")).alias("usage_frac_of_max"))
    return low.crossJoin(use)  # one row each


def class_order(lo: DataFrame, hi: DataFrame, margin: float) -> DataFrame:
    """Mean hinge on the gaps hi - lo over all pairs of (id, s) of two classes, over
    the pairs' spread, and the share of pairs that are short of the margin.

    No pair is formed: for each hi the lo above hi - margin * spread are counted and
    summed in one order of both."""
    n = lambda df, c: df.agg(F.count("*").alias(f"n{c}"), F.sum("s").alias(f"s{c}"), F.sum(F.col("s") * F.col("s")).alias(f"q{c}"))
    t = n(lo, 0).crossJoin(n(hi, 1))  # one row each
    pairs, total = F.col("n0") * F.col("n1"), F.col("n1") * F.col("s0") + F.col("n0") * F.col("s1")
    square = F.col("n1") * F.col("q0") + F.col("n0") * F.col("q1")
    spread = F.sqrt(F.greatest(square - total * total / (2 * pairs), F.lit(0.0)) / (2 * pairs - 1))
    t = t.withColumns({"pairs": pairs, "s": F.when(spread > 0, F.greatest(spread, F.lit(1e-6))).otherwise(1.0)}).select("pairs", "s0", "n0", F.col("s").alias("spread"))
    events = lo.select(F.col("s").alias("key"), F.lit(0).alias("side"), "id", F.lit(1).cast("long").alias("c"), F.col("s").alias("v"), F.lit(None).cast("double").alias("hi"))
    asked = hi.crossJoin(F.broadcast(t)).select((F.col("s") - margin * F.col("spread")).alias("key"), F.lit(1).alias("side"), "id", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("v"), F.col("s").alias("hi"))  # one row
    order = ["key", "side", "id"]
    counted = cut(before(events.unionByName(asked), order, F.col("c")).withColumnRenamed("before", "under").drop("stretch"))
    both = before(counted, order, F.col("v")).where("side = 1").crossJoin(F.broadcast(t))  # one row
    above, sums = F.col("n0") - F.col("under"), F.col("s0") - F.col("before")
    short = above * (margin - F.col("hi") / F.col("spread")) + sums / F.col("spread")
    return both.agg((F.sum(F.when(above > 0, short).otherwise(0.0)) / F.max("pairs")).alias("loss"), (F.sum(above) / F.max("pairs")).alias("active"))


def best_rotation(m: np.ndarray) -> tuple[np.ndarray, float]:
    """The rotation R that maximises trace(R' m), and that trace; in the plane in
    closed form."""
    if m.shape == (2, 2):
        c, s = m[0, 0] + m[1, 1], m[1, 0] - m[0, 1]
        size = float(np.hypot(c, s))
        c, s = (c / size, s / size) if size > TINY else (1.0, 0.0)
        return np.array([[c, -s], [s, c]]), size
    u, w, vt = np.linalg.svd(m)
    if np.linalg.det(u @ vt) < 0:
        u[:, -1], w[-1] = -u[:, -1], -w[-1]
    return u @ vt, float(w.sum())


def procrustes(rows: DataFrame) -> tuple[DataFrame, dict]:
    """Rows (id, z, y) with ``aligned``, y turned, scaled and moved onto z, and the
    rotation, scale, shift and loss (mean squared coordinate left). Tasks add up the
    cross-covariance; a matrix a task reaches the driver, and no row."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.columns)
                part = [np.array([len(z), (z * z).sum(), (y * y).sum()]), z.sum(0), y.sum(0), y.T @ z]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": [np.concatenate([x.ravel() for x in total]).tobytes()]})

    parts = [np.frombuffer(r.m, "<f8") for r in rows.select("z", "y").mapInArrow(moments, "m binary").collect()]
    if not parts:
        raise ValueError("no rows to align")
    t = np.sum(parts, 0)
    d = int(round((-2 + (4 + 4 * (len(t) - 3)) ** 0.5) / 2))
    n, zz, yy, zs, ys, m = t[0], t[1], t[2], t[3 : 3 + d], t[3 + d : 3 + 2 * d], t[3 + 2 * d :].reshape(d, d)
    zm, ym = zs / n, ys / n
    rotation, trace = best_rotation(m - n * np.outer(ym, zm))
    left, right = zz - n * zm @ zm, yy - n * ym @ ym
    scale = trace / max(right, TINY)
    shift = zm - scale * ym @ rotation
    turned = F.array(*(sum((F.col("y")[k] * float(scale * rotation[k, j]) for k in range(d)), F.lit(float(shift[j]))) for j in range(d)))
    loss = max(left - 2 * scale * trace + scale * scale * right, 0.0) / (n * d)
    return rows.withColumn("aligned", turned), {"rotation": rotation, "scale": float(scale), "shift": shift, "loss": float(loss)}


def pinball(y: Column, yhat: Column, tau: float) -> Column:
    e = y - yhat
    return F.greatest(tau * e, (tau - 1) * e)


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(((y >= lo) & (y <= hi)).cast("double"))


def pair_fidelity(pairs: DataFrame, delta: float, eps: float) -> DataFrame:
    """Share of the pairs within ``delta`` that are within ``eps``."""
    return pairs.agg((F.count_if(F.col("d") <= eps) / F.count_if(F.col("d") <= delta)).alias("fidelity"))


def ramp(t: Column, start: float, end: float, down: bool = False) -> Column:
    """0 until ``start``, linear to 1 by ``end`` (``down``: the other way); with
    both 0 always 1."""
    if start == 0 and end == 0:
        return F.lit(1.0)
    if end <= start:
        return F.lit(0.0) if down else F.when(t < start, 0.0).otherwise(1.0)
    up = F.when(t < start, 0.0).when(t >= end, 1.0).otherwise((t - start) / (end - start))
    return 1 - up if down else up


def cap_ratio(ratio: Column, cap: float) -> Column:
    return F.least(F.greatest(ratio, F.lit(1 / cap)), F.lit(cap))


def cover_passes(rows: DataFrame, active: int, overlap: float, visits: int = 1) -> DataFrame:
    """Epochs until every row was active about ``visits`` times."""
    n = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    size = F.greatest(F.least(F.lit(active), F.col("n")), F.lit(1))
    kept = min(max(overlap, 0.0), 1.0)
    fresh = (1 - kept) * size
    epochs = F.when(fresh > TINY, F.ceil(visits * F.col("n") / fresh)).otherwise(F.when(size >= F.col("n"), visits).otherwise(10**18))
    return n.select("n", size.cast("long").alias("active_size"), fresh.alias("fresh_per_epoch"), epochs.cast("long").alias("epochs"), F.ceil(visits * F.col("n") / size).cast("long").alias("epochs_slots"))


def star_neighbours(edges: DataFrame, m: int) -> DataFrame:
    """(id, k, nbr): up to ``m`` neighbours of each node of (src, dst), by id."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).union(edges.select("dst", "src"))
    first = both.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("nbr")), 1, m).alias("ns"))
    return first.select("id", F.posexplode("ns").alias("k", "nbr"))


def spanning_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The minimum spanning forest (i, j, d) of edges i < j, ties by (i, j): each
    round every component takes its shortest edge out, so rounds are few."""
    tree, labels = None, nodes.select("id", F.col("id").alias("root"))
    while True:
        a, b = labels.select(F.col("id").alias("i"), F.col("root").alias("ri")), labels.select(F.col("id").alias("j"), F.col("root").alias("rj"))
        out = edges.select("i", "j", "d").join(a, "i").join(b, "j").where("ri != rj")
        ends = out.select(F.col("ri").alias("r"), "i", "j", "d").union(out.select("rj", "i", "j", "d"))
        best = ends.groupBy("r").agg(F.min(F.struct("d", "i", "j")).alias("b")).select("b.i", "b.j", "b.d").distinct().checkpoint()
        if best.isEmpty():
            return best if tree is None else tree
        tree = best if tree is None else tree.union(best)
        labels = K.components(nodes, tree.select("i", "j"))


def small_tree(rows: list) -> list[tuple]:
    """The same tree of a few edges (i, j, d), on the driver."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for d, i, j in sorted((r["d"], r["i"], r["j"]) for r in rows):
        if (a := top(i)) != (b := top(j)):
            root[a] = b
            out.append((i, j, d))
    return out


def backbone(landmarks: DataFrame, reps: DataFrame, weight: float = 0.01) -> DataFrame:
    """(src, dst, w): the landmarks' spanning tree between their nearest
    representatives, both ways; where both ends meet there is no edge."""
    pairs = K.pair_distances(landmarks, landmarks, where=F.col("i") < F.col("j"))
    near = K.nearest(landmarks, reps, 1, skip_equal_id=False).select("i", F.col("j").alias("rep"))
    if landmarks.limit(FEW + 1).count() <= FEW:  # as a rule: landmarks are few
        tree = landmarks.sparkSession.createDataFrame(small_tree(pairs.collect()), "i long, j long, d double")
    else:
        tree = spanning_tree(pairs, landmarks)
    ends = tree.join(near.withColumnRenamed("rep", "src"), "i").join(near.select(F.col("i").alias("j"), F.col("rep").alias("dst")), "j").where("src != dst")
    both = ends.select("src", "dst").union(ends.select("dst", "src"))
    return both.groupBy("src", "dst").agg((F.count("*") * weight).alias("w"))
