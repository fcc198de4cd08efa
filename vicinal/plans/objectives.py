"""Registered queries of map objectives, conformal scores and plans, with SQL.

The tables are those of ``queries``: E, its map Z, landmarks M (ids below 16).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinal.functions import metrics as V
from vicinal.operators import conformal as C
from vicinal.operators import evaluate as Q
from vicinal.operators import knn as K
from vicinal.operators import objectives as O
from vicinal.plans.queries import (
    AF_, CV_, D_, E_, KN_, KNN, KZ_, M_, MARKS, DZ_, W, Z_, dist_to_marks, emb, flat, labels, marks, query, r6, shared, table,
)

A_, B_ = 1.577, 0.8951
_EZ = "EZ AS (SELECT KN.i, KN.j, KN.d, KN.rk, list_distance(a.v, b.v) AS e FROM KN JOIN Z a ON KN.i = a.id JOIN Z b ON KN.j = b.id)"
_EDGES = f"{E_}, {Z_}, {D_}, {KN_}, {_EZ}"
_STRESS = "SELECT round(sum(e * d) / sum(d * d), 6) AS scale, round((sum(e * e) - sum(e * d) * sum(e * d) / sum(d * d)) / sum(e * e), 6) AS loss FROM"


def edges(spark, d):
    e = emb(spark, d)
    return O.mapped(K.knn(e, KNN), flat(e))


@query(W + _EDGES + f" {_STRESS} EZ")
def local_isometry(spark, d):
    return r6(O.scale_free_stress(edges(spark, d)))


def _q(e: str) -> str:
    return f"least(greatest(1 / (1 + {A_}e0 * pow({e} * {e} + 1e-10, {B_}e0)), 1e-7), 1 - 1e-7)"


@query(W + _EDGES + f""", N AS (SELECT count(*) AS n FROM E), NG AS (SELECT list_distance(a.v, b.v) AS e FROM Z a, N, range(1, 6) t(k) JOIN Z b ON b.id = (a.id + 37 * k) % n),
P AS (SELECT -avg(exp(-d) * ln({_q('e')})) AS attraction FROM EZ), Q AS (SELECT -avg(ln(greatest(1 - {_q('e')}, 1e-7))) AS repulsion FROM NG)
SELECT round(attraction, 6) AS attraction, round(repulsion, 6) AS repulsion, round(attraction + repulsion, 6) AS loss FROM P, Q""")
def cross_entropy(spark, d):
    e = emb(spark, d)
    n = e.count()
    apart = e.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select("i", ((F.col("i") + 37 * F.col("k")) % n).alias("j"))
    return r6(O.fuzzy_cross_entropy(edges(spark, d).withColumn("w", F.exp(-F.col("d"))), O.mapped(apart, flat(e)), A_, B_))


@query(W + _EDGES + f""", T AS (SELECT i, max(CASE WHEN rk = 1 THEN e END) AS a, max(CASE WHEN rk = 5 THEN e END) AS b, max(CASE WHEN rk = {KNN} THEN e END) AS c FROM EZ GROUP BY i),
S AS (SELECT 0.9e0 + 0.1e0 * avg(c) AS s FROM T) SELECT round(avg(ln(1 + exp(-(b - a) / s)) + ln(1 + exp(-(c - b) / s))), 6) AS loss, round(max(s), 6) AS scale FROM T, S""")
def ordinal_triplets(spark, d):
    at = lambda k: F.max(F.when(F.col("rk") == k, F.col("e")))
    return r6(O.ordinal_triplets(edges(spark, d).groupBy("i").agg(at(1).alias("near"), at(5).alias("mid"), at(KNN).alias("far"))))


def affinity_table(spark, d):
    return C.affinities(dist_to_marks(emb(spark, d)))


_MA = f"{E_}, {M_}, {AF_}, MA AS (SELECT l, avg(a) AS a FROM AF GROUP BY l)"


@query(W + _MA + " SELECT l, round(a, 6) AS a FROM MA")
def mean_affinity(spark, d):
    return r6(O.mean_affinity(affinity_table(spark, d)))


@query(W + _MA + ", Q AS (SELECT avg(q) AS quant FROM (SELECT id, sum(a * d) AS q FROM AF GROUP BY id)), H AS (SELECT -sum(a * ln(a)) AS entropy FROM MA) SELECT round(quant, 6) AS quant, round(entropy, 6) AS entropy, round(quant - entropy, 6) AS loss FROM Q, H")
def landmark_regularisation(spark, d):
    return r6(O.landmark_regularisation(affinity_table(spark, d)))


@query(W + _MA + ", P AS (SELECT id, exp(-sum(a * ln(a))) AS p FROM AF GROUP BY id), U AS (SELECT -sum(a * ln(a)) AS u, count(*) AS n FROM MA) SELECT round(quantile_disc(p, 0.5), 6) AS perp_median, round(quantile_cont(p, 0.1), 6) AS perp_p10, round(quantile_cont(p, 0.9), 6) AS perp_p90, round(max(u), 6) AS usage_ent, round(max(u) / ln(max(n)), 6) AS usage_frac_of_max FROM P, U")
def affinity_usage(spark, d):
    return r6(O.affinity_stats(affinity_table(spark, d)))


@query(W + f"{E_}, {Z_}, X AS (SELECT a.id, min(list_distance(a.v, b.v)) AS cover FROM Z a JOIN Z b ON b.id < {MARKS} GROUP BY a.id) SELECT id, round(cover, 6) AS cover FROM X")
def map_cover(spark, d):
    z = flat(emb(spark, d))
    return r6(K.assign(z, marks(z)).select("id", F.col("d").alias("cover")))


@query(W + f"{E_}, {M_}, {AF_}, S AS (SELECT id, min(d) AS c, -sum(a * ln(a)) AS h FROM AF GROUP BY id), Q AS (SELECT median(c) AS mc, median(h) AS mh FROM S WHERE id % 2 = 0) SELECT id, round(c / mc + h / mh, 6) AS score FROM S, Q")
def cover_plus_entropy(spark, d):
    s = C.scores(dist_to_marks(emb(spark, d)))
    scale = s.where("id % 2 = 0").agg(F.percentile("cover", F.lit(0.5)).alias("mc"), F.percentile("entropy", F.lit(0.5)).alias("mh"))
    return r6(s.crossJoin(F.broadcast(scale)).select("id", (F.col("cover") / F.col("mc") + F.col("entropy") / F.col("mh")).alias("score")))  # one row


_RAD = "G AS (SELECT quantile_disc(d, 0.5) AS g FROM N1M), RL AS (SELECT l, quantile_disc(d, 0.5) AS r FROM N1M GROUP BY l)"


@query(W + f"{E_}, {M_}, N1M AS (SELECT id, l, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, l) AS rk FROM DM) WHERE rk = 1), {_RAD} SELECT DM.id, DM.l, round(DM.d / greatest(coalesce(r, g), 1e-3 * g), 6) AS score FROM DM LEFT JOIN RL ON DM.l = RL.l, G")
def support_per_landmark(spark, d):
    e = emb(spark, d)
    radii = C.support_radii(K.assign(e, marks(e)).select("id", "l", "d"), marks(e))
    return r6(dist_to_marks(e).join(radii, "l").select("id", "l", (F.col("d") / F.col("r")).alias("score")))


_PV = f"{E_}, {M_}, {CV_}, PV AS (SELECT t.id, (1 + (SELECT count(*) FROM CV c WHERE c.id % 2 = 0 AND c.id >= {MARKS} AND c.s >= t.s)) / CAST((SELECT count(*) FROM CV WHERE id % 2 = 0 AND id >= {MARKS}) + 1 AS DOUBLE) AS p FROM CV t WHERE t.id % 2 = 1 AND t.id >= {MARKS})"


@query(W + _PV + " SELECT id, p > 0.05e0 AS exchangeable FROM PV")
def exchangeable(spark, d):
    e = emb(spark, d)
    s = C.scores(dist_to_marks(e)).where(F.col("id") >= MARKS).select("id", F.col("cover").alias("s"))
    return C.p_values(s.where("id % 2 = 1"), s.where("id % 2 = 0")).select("id", (F.col("p") > 0.05).alias("exchangeable"))


@query(W + _PV + ", R AS (SELECT p, rank() OVER (ORDER BY p) AS lo, count(*) OVER (ORDER BY p) AS hi, count(*) OVER () AS n FROM PV) SELECT round(max(greatest(hi / CAST(n AS DOUBLE) - p, p - (lo - 1) / CAST(n AS DOUBLE))), 6) AS ks FROM R")
def uniformity(spark, d):
    e = emb(spark, d)
    s = C.scores(dist_to_marks(e)).where(F.col("id") >= MARKS).select("id", F.col("cover").alias("s"))
    return r6(Q.ks_uniform(C.p_values(s.where("id % 2 = 1"), s.where("id % 2 = 0"))))


@query(W + f"{E_} SELECT round(avg(greatest(0.9e0 * (v[1] - v[2]), -0.1e0 * (v[1] - v[2]))), 6) AS pinball, round(avg(CASE WHEN v[1] BETWEEN v[2] - 0.1e0 AND v[2] + 0.1e0 THEN 1e0 ELSE 0 END), 6) AS coverage FROM E")
def interval_losses(spark, d):
    y, x = F.col("v")[0], F.col("v")[1]
    return r6(emb(spark, d).agg(F.avg(O.pinball(y, x, 0.9)).alias("pinball"), O.coverage(y, x - 0.1, x + 0.1).alias("coverage")))


_SUP = "SD AS (SELECT a.id, min(list_distance(a.v, b.v)) AS s FROM E a JOIN E b ON a.id % 4 <> 0 AND b.id % 4 = 0 GROUP BY a.id)"


def _support_distance(spark, d):
    e = emb(spark, d)
    return K.nearest(e.where("id % 4 != 0"), e.where("id % 4 = 0"), 1, False).select(F.col("i").alias("id"), F.col("d").alias("s"))


@query(W + f"{E_}, {_SUP} SELECT id, round(s, 6) AS s FROM SD")
def distance_to_support(spark, d):
    return r6(_support_distance(spark, d))


@query(W + f"{E_}, {_SUP}, P AS (SELECT t.id, (1 + (SELECT count(*) FROM SD c WHERE c.id % 4 = 2 AND c.s >= t.s)) / CAST((SELECT count(*) FROM SD WHERE id % 4 = 2) + 1 AS DOUBLE) AS p FROM SD t WHERE t.id % 2 = 1) SELECT id, round(p, 6) AS p, p <= 0.1e0 AS novel FROM P")
def novelty(spark, d):
    s = _support_distance(spark, d)
    return r6(C.p_values(s.where("id % 2 = 1"), s.where("id % 4 = 2")).select("id", "p", (F.col("p") <= 0.1).alias("novel")))


@query(W + f"{E_}, {D_}, {KN_} SELECT round(count(*) FILTER (d <= 1.15e0) / CAST(count(*) FILTER (d <= 1.2e0) AS DOUBLE), 6) AS fidelity FROM KN")
def pair_fidelity(spark, d):
    return r6(O.pair_fidelity(K.knn(emb(spark, d), KNN), 1.2, 1.15))


@query("WITH N AS (SELECT count(*) AS n FROM orders) SELECT n, CAST(least(1000, n) AS BIGINT) AS active_size, round(0.7e0 * least(1000, n), 6) AS fresh_per_epoch, CAST(ceil(2 * n / (0.7e0 * least(1000, n))) AS BIGINT) AS epochs, CAST(ceil(2e0 * n / least(1000, n)) AS BIGINT) AS epochs_slots FROM N")
def cover_passes(spark, d):
    return r6(O.cover_passes(table(spark, d, "orders"), 1000, 0.3, 2))


@query(f"WITH N AS (SELECT count(*) AS n FROM embeddings) SELECT n, CASE WHEN n < 300000 THEN 0 ELSE 1 END AS level, CAST(ceil({MARKS} * 40e0 / 256) AS BIGINT) AS steps FROM N")
def gauge_plan(spark, d):
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    return n.select("n", F.when(F.col("n") < 300_000, 0).otherwise(1).alias("level"), F.ceil(F.lit(MARKS * 40) / 256).cast("long").alias("steps"))


@query(W + f"{E_}, {D_}, {KN_}, B AS (SELECT i AS id, j AS nbr FROM KN UNION SELECT j, i FROM KN) SELECT id, CAST(rk - 1 AS INTEGER) AS k, nbr FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nbr) AS rk FROM B) WHERE rk <= 8")
def star_neighbours(spark, d):
    return O.star_neighbours(K.knn(emb(spark, d), KNN).select(F.col("i").alias("src"), F.col("j").alias("dst")), 8)


@query("SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice / l_quantity / 1000, 1 / 1.2e0), 1.2e0), 6) AS ratio FROM lineitem")
def capped_ratio(spark, d):
    li = table(spark, d, "lineitem")
    return r6(li.select("l_orderkey", "l_linenumber", O.cap_ratio(F.col("l_extendedprice") / F.col("l_quantity") / 1000, 1.2).alias("ratio")))


@query(W + f"{E_}, {M_}, A1 AS (SELECT id, l FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, l) AS rk FROM DM) WHERE rk = 1) SELECT l, count(*) AS n, count(*) FILTER (id % 61 = 0) > 0 AS active FROM A1 GROUP BY l")
def active_cells(spark, d):
    e = emb(spark, d)
    return K.assign(e, marks(e)).groupBy("l").agg(F.count("*").alias("n"), (F.count_if(F.col("id") % 61 == 0) > 0).alias("active"))


@query(W + f"{E_}, {D_} SELECT round(quantile_disc(d, 0.5), 6) AS scale FROM (SELECT min(d) AS d FROM D GROUP BY i)")
def median_nn(spark, d):
    return r6(K.one_nn(emb(spark, d)).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("scale")))


@query(W + f"{E_}, N AS (SELECT id, sqrt(list_sum([x * x for x in v[1:8]])) AS n, list_avg(v[1:8]) AS m, v[1:8] AS v FROM E), C AS (SELECT *, sqrt(list_sum([(x - m) * (x - m) for x in v])) AS s FROM N) SELECT id, round(v[1] / n, 6) AS unit1, round(v[8] / n, 6) AS unit8, round((v[1] - m) / s, 6) AS centred1, round((v[8] - m) / s, 6) AS centred8 FROM C")
def normalised_rows(spark, d):
    v = F.slice("v", 1, 8)
    u, c = V.l2_normalize(v), V.l2_normalize(V.center(v))
    return r6(emb(spark, d).select("id", u[0].alias("unit1"), u[7].alias("unit8"), c[0].alias("centred1"), c[7].alias("centred8")))


@query(W + f"""{E_}, L0 AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM E a JOIN E b ON a.id <> b.id AND a.id < {MARKS} AND b.id < {MARKS}),
""" + ",\n".join(f"L{k} AS MATERIALIZED (SELECT i, j, min(d) AS d FROM (SELECT * FROM L{k - 1} UNION ALL SELECT x.i, y.j, greatest(x.d, y.d) AS d FROM L{k - 1} x JOIN L{k - 1} y ON x.j = y.i AND x.i <> y.j) GROUP BY i, j)" for k in range(1, 5)) + f""",
T AS (SELECT L0.i, L0.j FROM L0 JOIN L4 ON L0.i = L4.i AND L0.j = L4.j WHERE L0.i < L0.j AND L0.d <= L4.d),
R AS (SELECT i, rep FROM (SELECT a.id AS i, b.id AS rep, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rk FROM E a JOIN E b ON a.id < {MARKS} AND b.id >= {MARKS} AND b.id % 2 = 1) WHERE rk = 1),
S AS (SELECT x.rep AS src, y.rep AS dst FROM T JOIN R x ON T.i = x.i JOIN R y ON T.j = y.i WHERE x.rep <> y.rep)
SELECT src, dst, round(count(*) * 0.01e0, 6) AS w FROM (SELECT * FROM S UNION ALL SELECT dst, src FROM S) GROUP BY src, dst""")
def landmark_backbone(spark, d):
    shared(spark)
    e = emb(spark, d)
    return r6(O.backbone(marks(e), e.where((F.col("id") >= MARKS) & (F.col("id") % 2 == 1))))


