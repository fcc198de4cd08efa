"""How alike several maps (id, v) of the same rows are.

Coordinates of two maps are compared after the best turn, scale and shift, fitted on
anchors and scored on the other rows; neighbourhoods by the order of all rows around each
probe. Rows that a map lacks are left out of its pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions.metrics import METRICS
from vicinal.operators import evaluate as Q
from vicinal.operators import knn as K
from vicinal.operators.lineage import cut
from vicinal.operators.objectives import procrustes
from vicinal.operators.sums import quantiles

TINY = 1e-12
#: Anchors that a fit needs.
LEAST = 3


def disagreement(a: DataFrame, b: DataFrame, anchor: Column) -> dict[str, float | None]:
    """Median and 0.9 quantile of the distance that is left between ``b`` and the aligned
    ``a``, over the median distance of ``b`` from its mean, and the scale. The fit takes the rows where
    ``anchor`` (a condition on id) holds, the rest the others; None of all with fewer than
    three anchors or no other row."""
    rows = cut(a.select("id", F.col("v").alias("y")).join(b.select("id", F.col("v").alias("z")), "id").where("y IS NOT NULL AND z IS NOT NULL"))
    fit_on, others = rows.where(anchor), rows.where(~anchor)
    if len(fit_on.take(LEAST)) < LEAST or not others.take(1):
        return {"median": None, "p90": None, "scale": None}
    _, fit = procrustes(fit_on)
    r, s, shift = fit["rotation"], fit["scale"], fit["shift"]
    d = len(shift)
    turned = F.array(*(sum((F.col("y")[k] * float(s * r[k, j]) for k in range(d)), F.lit(float(shift[j]))) for j in range(d)))
    mean = others.agg(*(F.avg(F.col("z")[j]).alias(f"m{j}") for j in range(d))).first()
    left = cut(others.select(METRICS["l2"](turned, F.col("z")).alias("left"), METRICS["l2"](F.array(*(F.lit(m) for m in mean)), F.col("z")).alias("spread")))
    (spread,), (median, p90) = quantiles(left, "spread", [0.5], False), quantiles(left, "left", [0.5, 0.9], [False, True])
    size = max(spread, TINY)
    return {"median": median / size, "p90": p90 / size, "scale": s}


def neighbourhoods(a: DataFrame, b: DataFrame, probe: Column, k: int = 15) -> DataFrame:
    """One row: the mean rank correlation of all rows around the probes (a condition on id) in
    both maps, the mean Jaccard index of their k nearest, and how many probes there are."""
    return _means(K.probe_ranks([a, b], probe, k), k).select("spearman", "jaccard", "n_probe")


def _means(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("a", "b").agg(F.avg("rho").alias("spearman"), F.avg(F.col("n") / (2 * k - F.col("n"))).alias("jaccard"), F.count("*").alias("n_probe"))


def persistence(maps: dict[str, DataFrame], anchor: Column, probe: Column, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """For each pair of maps (a, b): median, p90, scale, spearman and jaccard; and the means
    and the worst of them, which is what a claim that maps come out alike has to bear."""
    if len(maps) < 2:
        raise ValueError("at least two maps are needed")
    spark, out = next(iter(maps.values())).sparkSession, []
    kept = {n: cut(m.select("id", "v")) for n, m in maps.items()}
    for a, b in combinations(kept, 2):
        c = disagreement(kept[a], kept[b], anchor)
        n = neighbourhoods(kept[a], kept[b], probe, k).first()
        out.append((a, b, c["median"], c["p90"], c["scale"], n.spearman, n.jaccard, n.n_probe))
    pairs = spark.createDataFrame(out, "a string, b string, median double, p90 double, scale double, spearman double, jaccard double, n_probe long")
    best = [f(c).alias(n) for c, n, f in (("median", "coordinates_mean", F.avg), ("median", "coordinates_worst", F.max), ("spearman", "spearman_mean", F.avg), ("spearman", "spearman_worst", F.min), ("jaccard", "jaccard_mean", F.avg), ("jaccard", "jaccard_worst", F.min))]
    return pairs, pairs.agg(F.lit(len(maps)).cast("long").alias("n_maps"), F.count("*").alias("n_pairs"), *best)
