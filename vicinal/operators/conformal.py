"""Landmark scores, conformal p-values, thresholds and prediction sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.operators.order import MOST, before, bucket, stretches

TINY = 1e-12


def affinities(dist: DataFrame, tau: float = 1.0) -> DataFrame:
    """Softmax of -d / tau over the landmarks of each row: (id, l, d, a)."""
    own = Window.partitionBy("id")
    e = F.exp(-(F.col("d") - F.min("d").over(own)) / tau)
    return dist.withColumn("e", e).select("id", "l", "d", (F.col("e") / F.sum("e").over(own)).alias("a"))


def scores(dist: DataFrame, tau: float = 1.0) -> DataFrame:
    """One row each: cover, soft_cover, entropy and max_neg."""
    a = affinities(dist, tau)
    soft = F.min("d") - tau * F.ln(F.sum(F.exp(-(F.col("d") - F.col("m")) / tau)))
    base = a.withColumn("m", F.min("d").over(Window.partitionBy("id")))
    return base.groupBy("id").agg(F.min("d").alias("cover"), soft.alias("soft_cover"), (-F.sum(F.col("a") * F.ln(F.greatest("a", F.lit(TINY))))).alias("entropy"), (-F.max("a")).alias("max_neg"))


def consistency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the L1 distance between two affinity tables of the same rows."""
    other = b.select("id", "l", F.col("a").alias("b"))
    return a.join(other, ["id", "l"]).groupBy("id").agg((0.5 * F.sum(F.abs(F.col("a") - F.col("b")))).alias("consistency"))


def counted(rows: DataFrame, groups: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """One row for each different score s of (s, c): n (the sum of c), le (the sum
    up to s) and total; by group where given.

    Scores are summed first, then cut at ``parts`` - 1 quantiles (as many as their
    number asks for, if not given); each stretch is
    summed by a window of its own, and the stretches before it are added, so
    neither all rows nor equal scores meet in one task."""
    groups = groups or []
    per = rows.where(F.col("s").isNotNull()).groupBy(*groups, "s").agg(F.sum("c").alias("n"))
    fine = parts or MOST
    seen = per.agg(F.count("*").alias("n"), F.percentile_approx("s", [k / fine for k in range(1, fine)] or [0.5]).alias("q")).first()  # MOST numbers
    step = fine // (parts or stretches(seen["n"]))
    cuts = sorted(set(seen["q"] or [])) if step <= 1 else sorted(set((seen["q"] or [])[step - 1 :: step]))
    per = per.withColumn("part", bucket([F.lit(x) for x in cuts] if fine > 1 else [], F.col("s")))
    sums = per.groupBy(*groups, "part").agg(F.sum("n").alias("m"))
    other = sums.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("part").alias("_part"), F.col("m").alias("_m"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    pairs = sums.join(other, same) if same else sums.crossJoin(F.broadcast(other))  # parts rows a group
    lower = pairs.groupBy(*groups, "part").agg(F.coalesce(F.sum(F.when(F.col("_part") < F.col("part"), F.col("_m"))), F.lit(0)).alias("lower"), F.sum("_m").alias("total"))
    lower = lower.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("part").alias("_part"), "lower", "total")
    at = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("part") == F.col("_part")]
    up = Window.partitionBy(*groups, "part").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    summed = per.withColumn("own", F.sum("n").over(up)).join(lower if groups else F.broadcast(lower), at)
    return summed.select(*groups, "s", "n", (F.col("lower") + F.col("own")).alias("le"), "total")


def p_values(test: DataFrame, calib: DataFrame, groups: list[str] | None = None, sided: str = "upper") -> DataFrame:
    """(1 + calibration scores at least as large) / (n + 1) for rows (id, s);
    ``two``: twice the smaller tail, at most 1. By group where given. A null
    score has no row. No pair of rows is formed."""
    groups = groups or []
    own = [F.col(g) for g in groups]
    both = test.select(*own, "s", F.lit(0).alias("c")).unionByName(calib.select(*own, "s", F.lit(1).alias("c")))
    found = counted(both, groups).select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("s").alias("_s"), "n", "le", "total")
    rows = test.select(*own, "id", "s").join(found, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("s") == F.col("_s")])
    ge = F.col("total") - F.col("le") + F.col("n")
    hi, lo = (1 + ge) / (F.col("total") + 1), (1 + F.col("le")) / (F.col("total") + 1)
    p = hi if sided == "upper" else F.least(F.lit(1.0), 2 * F.least(hi, lo))
    return rows.select(*groups, "id", "s", p.alias("p"))


def thresholds(calib: DataFrame, alphas: list[float], groups: list[str] | None = None) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score for each alpha; infinity
    beyond n."""
    groups = groups or []
    ranked = counted(calib.withColumn("c", F.lit(1)), groups).withColumn("alpha", F.explode(F.array(*(F.lit(x) for x in alphas))))
    k = F.ceil(F.round((F.col("total") + 1) * (1 - F.col("alpha")), 9))
    found = ranked.groupBy(*groups, "alpha").agg(F.min(F.when(F.col("le") >= k, F.col("s"))).alias("t"), F.max("total").alias("n"))
    return found.select(*groups, "alpha", F.coalesce("t", F.lit(float("inf"))).alias("threshold"), F.col("n").cast("long").alias("n"))


def prediction_sets(p: DataFrame, alpha: float, group: str = "grp") -> DataFrame:
    inside = F.array_sort(F.collect_list(F.when(F.col("p") > alpha, F.col(group))))
    return p.groupBy("id").agg(inside.alias("groups"))


def bh_reject(p: DataFrame, alpha: float) -> DataFrame:
    """Benjamini-Hochberg step-up on (id, p): of equal p the last rank decides."""
    ranked = counted(p.select(F.col("p").alias("s"), F.lit(1).alias("c")))
    cut = ranked.agg(F.max(F.when(F.col("s") <= alpha * F.col("le") / F.col("total"), F.col("s"))).alias("cut"))
    return p.crossJoin(F.broadcast(cut)).select("id", "p", F.coalesce(F.col("p") <= F.col("cut"), F.lit(False)).alias("reject"))  # one row


def mann_whitney_u(rows: DataFrame, x: Column) -> DataFrame:
    """U of the rows (id, s) where ``x`` holds against the others; ties by id, and
    rows of one score and id share their mean rank."""
    per = rows.select("s", "id", F.coalesce(x, F.lit(False)).cast("long").alias("x")).groupBy("s", "id").agg(F.count("*").alias("c"), F.sum("x").alias("x"))
    ranked = before(per, ["s", "id"], F.col("c"))
    n = F.sum("x")
    return ranked.agg((F.sum(F.col("x") * (F.col("before") + (F.col("c") + 1) / 2)) - n * (n + 1) / 2).alias("u"))


def cqr_offset(rows: DataFrame, alpha: float) -> DataFrame:
    """The conformal offset of intervals (lo, hi) for y."""
    e = rows.select(F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")).alias("e"))
    n = e.count()
    return e.agg(F.percentile("e", F.lit(min(1.0, (1 - alpha) * (1 + 1 / max(n, 1))))).alias("offset"))


def lda(rows: DataFrame) -> DataFrame:
    """Fisher direction of two features (f1, f2) between y = 0 and 1: unit
    weights w1, w2, and the midpoint bias."""
    m = lambda c, y: F.avg(F.when(F.col("y") == y, F.col(c)))
    ss = lambda a, b, y: F.covar_pop(F.when(F.col("y") == y, F.col(a)), F.when(F.col("y") == y, F.col(b))) * F.count_if(F.col("y") == y)
    s = rows.agg(*(m(c, y).alias(f"{c}_{y}") for c in ("f1", "f2") for y in (0, 1)), *((ss(a, b, 0) + ss(a, b, 1)).alias(n) for n, a, b in (("s11", "f1", "f1"), ("s12", "f1", "f2"), ("s22", "f2", "f2"))))
    s = s.withColumns({"s11": F.col("s11") + 1e-6, "s22": F.col("s22") + 1e-6, "d1": F.col("f1_1") - F.col("f1_0"), "d2": F.col("f2_1") - F.col("f2_0")})
    s = s.withColumns({"u1": F.col("s22") * F.col("d1") - F.col("s12") * F.col("d2"), "u2": F.col("s11") * F.col("d2") - F.col("s12") * F.col("d1")})
    size = F.greatest(F.sqrt(F.col("u1") * F.col("u1") + F.col("u2") * F.col("u2")), F.lit(TINY))
    s = s.withColumns({"w1": F.col("u1") / size, "w2": F.col("u2") / size})
    bias = -(F.col("w1") * (F.col("f1_0") + F.col("f1_1")) + F.col("w2") * (F.col("f2_0") + F.col("f2_1"))) / 2
    return s.select("w1", "w2", bias.alias("bias"))


def support_radii(assigned: DataFrame, landmarks: DataFrame, floor: float = 1e-3) -> DataFrame:
    """(l, r): the lower median distance of a landmark's rows; the global one if
    it has none; at least ``floor`` times that."""
    low = "percentile_disc(0.5) WITHIN GROUP (ORDER BY d)"
    own = assigned.groupBy("l").agg(F.expr(low).alias("r"))
    every = assigned.agg(F.expr(low).alias("g"))
    out = landmarks.select(F.col("id").alias("l")).join(own, "l", "left").crossJoin(F.broadcast(every))  # one row
    return out.select("l", F.greatest(F.coalesce("r", "g"), floor * F.col("g")).alias("r"))


def support_scores(dist: DataFrame, radii: DataFrame) -> DataFrame:
    return dist.join(radii, "l").groupBy("id").agg(F.min(F.col("d") / F.col("r")).alias("score"))


def repair(rows: DataFrame, landmarks: DataFrame, dist: DataFrame, radii: DataFrame, tau: float) -> DataFrame:
    """Move each row to the ball (of tau radii) that it reaches with least travel."""
    best = dist.join(radii, "l").withColumn("travel", F.greatest(F.col("d") - tau * F.col("r"), F.lit(0.0)))
    best = best.groupBy("id").agg(F.min_by(F.struct("l", "d", "travel"), F.struct("travel", "d", "l")).alias("b")).select("id", "b.*")
    out = best.join(rows, "id").join(landmarks.select(F.col("id").alias("l"), F.col("v").alias("c")), "l")
    share = F.when(F.col("d") > 0, F.col("travel") / F.col("d")).otherwise(0.0)
    out = out.withColumn("share", share)
    return out.select("id", "l", "travel", F.zip_with("v", "c", lambda x, y: x + (y - x) * F.col("share")).alias("v"))


def threshold_rank(n: int, alpha: float) -> int:
    return math.ceil(round((n + 1) * (1 - alpha), 9))
