"""Registered queries of null models and of the agreement of maps, with SQL.

Three maps of the vectors are compared: the first two coordinates, sums of both halves,
and differences of quarters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinal.operators import agreement as A
from vicinal.operators import nulls as N
from vicinal.plans.queries import E_, KNN, W, emb, flat, query, r6

SEED = 11


@query()
def shuffled_null(spark, d):
    """All rows with each coordinate permuted on its own."""
    return N.shuffled(emb(spark, d), SEED)


@query()
def gaussian_null(spark, d):
    """Normal rows of the same mean and covariance, rounded as sums differ by their order."""
    return N.gaussian(emb(spark, d), SEED).select("id", F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@query(W + f"{E_}, V AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS j FROM E) SELECT CAST(j AS INT) AS j, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS spread, round(min(x), 6) AS low, round(quantile_cont(x, 0.5), 6) AS middle, round(max(x), 6) AS high FROM V GROUP BY j")
def null_marginals(spark, d):
    """Each coordinate's law in the shuffled null, which is the table's own."""
    x = N.shuffled(emb(spark, d), SEED).select(F.posexplode("v").alias("k", "x"))
    some = [F.avg("x").alias("mean"), F.stddev_samp("x").alias("spread"), F.min("x").alias("low"), F.percentile("x", F.lit(0.5)).alias("middle"), F.max("x").alias("high")]
    return r6(x.groupBy((F.col("k") + 1).alias("j")).agg(F.count("*").alias("n"), *some))


@query(W + f"{E_}, V AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM E) SELECT CAST(a.j AS INT) AS j, CAST(b.j AS INT) AS k, round(1e3 * covar_samp(a.x, b.x), 6) + 0 AS cov FROM V a JOIN V b ON a.id = b.id AND a.j <= b.j GROUP BY 1, 2")
def covariance(spark, d):
    """The covariance of the coordinates, in thousandths, which the normal null takes."""
    _, _, cov = N.moments(emb(spark, d))
    return r6(spark.createDataFrame([(j + 1, k + 1, 1e3 * float(cov[j, k])) for j in range(len(cov)) for k in range(j, len(cov))], "j int, k int, cov double"))


def maps(spark, d) -> dict:
    e = emb(spark, d)
    part = lambda at, n: F.aggregate(F.slice("v", at, n), F.lit(0.0), lambda s, x: s + x)
    halves = e.select("id", F.array(part(1, 32), part(33, 32)).alias("v"))
    quarters = e.select("id", F.array(part(1, 16) - part(17, 16), part(33, 16) - part(49, 16)).alias("v"))
    return {"first": flat(e), "halves": halves, "quarters": quarters}


_PAIRS = f"""{E_}, MP AS (SELECT 'first' AS m, id, v[1] AS x, v[2] AS y FROM E UNION ALL SELECT 'halves', id, list_sum(v[1:32]), list_sum(v[33:64]) FROM E
  UNION ALL SELECT 'quarters', id, list_sum(v[1:16]) - list_sum(v[17:32]), list_sum(v[33:48]) - list_sum(v[49:64]) FROM E),
J AS (SELECT s.m AS a, t.m AS b, s.id, s.x AS ax, s.y AS ay, t.x AS bx, t.y AS bw FROM MP s JOIN MP t ON s.m < t.m AND t.id = s.id),
MU AS (SELECT a, b, avg(ax) AS m1, avg(ay) AS m2, avg(bx) AS m3, avg(bw) AS m4 FROM J WHERE id % 2 = 0 GROUP BY 1, 2),
X0 AS (SELECT a, b, m1, m2, m3, m4, sum((ax - m1) * (bx - m3) + (ay - m2) * (bw - m4)) AS c, sum((ay - m2) * (bx - m3) - (ax - m1) * (bw - m4)) AS s, sum((ax - m1) * (ax - m1) + (ay - m2) * (ay - m2)) AS yy FROM J JOIN MU USING (a, b) WHERE id % 2 = 0 GROUP BY ALL),
X AS (SELECT a, b, m1, m2, m3, m4, c / yy AS c, s / yy AS s, sqrt(c * c + s * s) / yy AS k FROM X0),
EV AS (SELECT a, b, avg(bx) AS e3, avg(bw) AS e4 FROM J WHERE id % 2 = 1 GROUP BY 1, 2),
LE AS (SELECT a, b, k, sqrt(pow(bx - m3 - (ax - m1) * c - (ay - m2) * s, 2) + pow(bw - m4 - (ay - m2) * c + (ax - m1) * s, 2)) AS l, sqrt(pow(bx - e3, 2) + pow(bw - e4, 2)) AS w FROM J JOIN X USING (a, b) JOIN EV USING (a, b) WHERE id % 2 = 1),
C AS (SELECT a, b, quantile_disc(l, 0.5) / quantile_disc(w, 0.5) AS median, quantile_cont(l, 0.9) / quantile_disc(w, 0.5) AS p90, max(k) AS scale FROM LE GROUP BY 1, 2),
R AS (SELECT p.m, p.id AS i, o.id AS j, row_number() OVER (PARTITION BY p.m, p.id ORDER BY sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)), o.id) AS rk FROM MP p JOIN MP o ON p.m = o.m AND p.id <> o.id WHERE p.id % 100 = 0),
H AS (SELECT s.m AS a, t.m AS b, s.i, corr(s.rk, t.rk) AS rho, count(*) FILTER (s.rk <= {KNN} AND t.rk <= {KNN}) AS n FROM R s JOIN R t ON s.m < t.m AND s.i = t.i AND s.j = t.j GROUP BY 1, 2, 3),
PA AS (SELECT a, b, median, p90, scale, avg(rho) AS spearman, avg(n / (2e0 * {KNN} - n)) AS jaccard, count(*) AS n_probe FROM C JOIN H USING (a, b) GROUP BY ALL)"""


def _persistence(spark, d):
    return A.persistence(maps(spark, d), F.col("id") % 2 == 0, F.col("id") % 100 == 0, KNN)


@query(W + f"{_PAIRS} SELECT a, b, round(median, 6) AS median, round(p90, 6) AS p90, round(scale, 6) AS scale, round(spearman, 6) AS spearman, round(jaccard, 6) AS jaccard, n_probe FROM PA")
def map_pairs(spark, d):
    """How alike three maps are, two by two; every hundredth row is a probe."""
    return r6(_persistence(spark, d)[0])


@query(W + f"{_PAIRS} SELECT CAST(3 AS BIGINT) AS n_maps, count(*) AS n_pairs, round(avg(median), 6) AS coordinates_mean, round(max(median), 6) AS coordinates_worst, round(avg(spearman), 6) AS spearman_mean, round(min(spearman), 6) AS spearman_worst, round(avg(jaccard), 6) AS jaccard_mean, round(min(jaccard), 6) AS jaccard_worst FROM PA")
def map_persistence(spark, d):
    """The means and the worst of these."""
    return r6(_persistence(spark, d)[1])
