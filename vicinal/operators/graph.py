"""Fuzzy neighbour graphs, coarsening and densities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def rho(knn: DataFrame, local_connectivity: int = 1) -> DataFrame:
    """(i, rho): the lc-th smallest positive distance; the largest if there are
    fewer, 0 without any."""
    pos = F.array_sort(F.collect_list(F.when(F.col("d") > 0, F.col("d"))))
    return knn.groupBy("i").agg(pos.alias("p")).select("i", F.coalesce(F.try_element_at("p", F.lit(local_connectivity)), F.try_element_at("p", F.lit(-1)), F.lit(0.0)).alias("rho"))


def smooth(knn: DataFrame, local_connectivity: int = 1, closed_form: bool = False, tolerance: float = 1e-5) -> DataFrame:
    """(i, rho, sigma). Sigma solves sum exp(-max(0, d - rho) / sigma) = log2(k)
    by bracketing and bisection in an Arrow kernel; ``closed_form`` takes the mean
    excess instead."""
    base = rho(knn, local_connectivity)
    if closed_form:
        means = knn.groupBy("i").agg(F.avg("d").alias("m"))
        return base.join(means, "i").select("i", "rho", F.greatest(F.col("m") - F.col("rho"), F.lit(TINY)).alias("sigma"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, r in zip(f["ds"], f["rho"], strict=True):
                e, target = np.maximum(np.asarray(d) - r, 0), math.log2(max(len(d), 2))
                low, high = 0.0, 1.0
                while np.exp(-e / high).sum() < target and high < 2.0**64:
                    high *= 2
                for _ in range(64):
                    mid = (low + high) / 2
                    got = np.exp(-e / max(mid, TINY)).sum()
                    if abs(got - target) < tolerance:
                        break
                    low, high = (mid, high) if got < target else (low, mid)
                out.append(max((low + high) / 2, TINY))
            yield pd.DataFrame({"i": f["i"], "rho": f["rho"], "sigma": out})

    lists = knn.groupBy("i").agg(F.collect_list("d").alias("ds")).join(base, "i")
    found = lists.select("i", "rho", "ds").mapInPandas(solve, "i long, rho double, sigma double")
    floor = found.agg((1e-3 * F.avg("rho")).alias("floor"))
    return found.crossJoin(F.broadcast(floor)).select("i", "rho", F.greatest("sigma", "floor").alias("sigma"))  # one row


def fuzzy_union(knn: DataFrame, scales: DataFrame, weights: DataFrame | None = None, beta: float = 0.5) -> DataFrame:
    """(src, dst, w), src < dst: p + q - p q over both directions, times
    (multiplicities)**beta, over the largest weight."""
    p = knn.join(scales, "i").select("i", "j", F.exp(-F.greatest(F.col("d") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("p"))
    both = p.groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg((1 - F.coalesce(F.max(F.when(F.col("i") < F.col("j"), 1 - F.col("p"))), F.lit(1.0)) * F.coalesce(F.max(F.when(F.col("i") > F.col("j"), 1 - F.col("p"))), F.lit(1.0))).alias("w"))
    if weights is not None:
        a = weights.select(F.col("id").alias("src"), F.col("weight").alias("wa"))
        b = weights.select(F.col("id").alias("dst"), F.col("weight").alias("wb"))
        both = both.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") * F.pow(F.col("wa") * F.col("wb"), beta)).alias("w"))
    top = both.agg(F.max("w").alias("top"))
    return both.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("w") / F.col("top")).alias("w")).where("w > 0")  # one row


def squash(w: Column, q: Column, mode: str) -> Column:
    """``rational`` anchors (q a quantile of w): w / (w + q); ``clamp``: min(w / q, 1)."""
    return F.least(w / q, F.lit(1.0)) if mode == "quantile_clamp" else w / (w + q)


def coarsen(edges: DataFrame, mapping: DataFrame, mode: str = "rational_q99") -> DataFrame:
    """Galerkin sum of the weights between coarse cells of ``mapping`` (id, to),
    squashed."""
    a = mapping.select(F.col("id").alias("src"), F.col("to").alias("a"))
    b = mapping.select(F.col("id").alias("dst"), F.col("to").alias("b"))
    sums = edges.join(a, "src").join(b, "dst").where("a != b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w"))
    p = 0.5 if mode == "rational" else 0.99
    positive = F.percentile(F.when(F.col("w") > 0, F.col("w")), F.lit(0.5))
    anchor = sums.agg(F.percentile("w", F.lit(p)).alias("q"), positive.alias("m")).select(F.when(F.col("q") > 0, F.col("q")).when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("q"))
    return sums.crossJoin(F.broadcast(anchor)).select("src", "dst", squash(F.col("w"), F.col("q"), mode).alias("w"))  # one row


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "w")
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("w").alias("mass"))


def basin_weights(edges: DataFrame, basin: DataFrame, mix: float = 0.5) -> DataFrame:
    """Edge weights balanced by the edge mass of the endpoints' basins (id, l)."""
    a = basin.select(F.col("id").alias("src"), F.col("l").alias("la"))
    b = basin.select(F.col("id").alias("dst"), F.col("l").alias("lb"))
    e = edges.join(a, "src").join(b, "dst")
    mass = e.select(F.explode(F.array("la", "lb")).alias("l"), "w").groupBy("l").agg(F.sum("w").alias("mu"))
    e = e.join(mass.select(F.col("l").alias("la"), F.col("mu").alias("ma")), "la").join(mass.select(F.col("l").alias("lb"), F.col("mu").alias("mb")), "lb")
    e = e.withColumn("inv", 0.5 * (1 / F.col("ma") + 1 / F.col("mb")))
    mean = e.agg(F.avg("inv").alias("mean"))
    return e.crossJoin(F.broadcast(mean)).select("src", "dst", (F.col("w") * ((1 - mix) + mix * F.col("inv") / F.col("mean"))).alias("w"))  # one row


def log_radius(knn: DataFrame) -> DataFrame:
    return knn.groupBy("i").agg(F.ln(F.greatest(F.max("d"), F.lit(TINY))).alias("log_r"))


def star_log_radius(knn: DataFrame) -> DataFrame:
    return knn.groupBy("i").agg((0.5 * F.ln(F.greatest(F.avg(F.col("d") * F.col("d")), F.lit(1e-24)))).alias("log_r"))


def intrinsic_dimension(knn: DataFrame) -> DataFrame:
    """Levina-Bickel: 1 / mean of the rows' mean log ratios to the farthest."""
    far = Window.partitionBy("i")
    ratios = knn.where("d > 0").withColumn("r", F.max("d").over(far)).where("d < r").groupBy("i").agg(F.avg(F.ln(F.col("r") / F.col("d"))).alias("m"))
    return ratios.agg((1 / F.avg("m")).alias("dim"))


def cut_mass(edges: DataFrame, part: DataFrame) -> DataFrame:
    a = part.select(F.col("id").alias("src"), F.col("part").alias("pa"))
    b = part.select(F.col("id").alias("dst"), F.col("part").alias("pb"))
    e = edges.join(a, "src").join(b, "dst")
    return e.agg((F.coalesce(F.sum(F.when(F.col("pa") != F.col("pb"), F.col("w"))), F.lit(0.0)) / F.sum("w")).alias("cut"))


def epsilon(nn1: DataFrame, q: float = 0.01) -> DataFrame:
    """The q-quantile of the 1-NN distances; if it is 0 the median positive one."""
    return nn1.agg(F.percentile("d", F.lit(q)).alias("e"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN d > 0 THEN d END)").alias("m")).select(F.when(F.col("e") > 0, F.col("e")).otherwise(F.coalesce("m", F.lit(TINY))).alias("epsilon"))
