"""Registered queries of nets, covers, whole graphs, paths, draws and scales, with SQL.

The tables are those of ``queries``. A greedy net is a recursive query: the rows in
hash order, each adding itself unless one of its neighbours is in the list.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from vicinal.operators import alias as AL
from vicinal.operators import batch as BT
from vicinal.operators import build as B
from vicinal.operators import conformal as C
from vicinal.operators import cover as N
from vicinal.operators import evaluate as Q
from vicinal.operators import geodesic as A
from vicinal.operators import graph as G
from vicinal.operators import knn as K
from vicinal.operators import objectives as O
from vicinal.operators import paths as P
from vicinal.operators import sampling as S
from vicinal.operators import spectral as SP
from vicinal.operators.lineage import cut, fresh_dir
from vicinal.plans.queries import (
    _ED, _FIGURES, AS_, D_, E_, EPS, FU_, KN_, KNN, M_, MARKS, N1_, ORACLES, RHO_, W, Z_, _bipartite, emb, flat, fuzzy, labels, marks, query, r6, table,
)
from vicinal.sources.store import GraphStore, KnnStore, load_graph, save_graph
from vicinal.streaming import ingest as I
from vicinal.streaming.cells import CellNet
from vicinal.streaming.ingest import refresh_dirty

RADII = [0.9, 1.0, 1.05, 1.1, 1.13, 1.16, 1.2, 1.25, 1.3]
R = "WITH RECURSIVE "


def _net(where: str, name: str = "") -> str:
    """The greedy net of E in hash order: G.reps of the last row; ``where`` says which
    rows see one another."""
    return f"""O{name} AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY md5('0:' || id), id) AS k FROM E),
NB{name} AS MATERIALIZED (SELECT a.id, list(b.id) AS nb FROM E a JOIN E b ON a.id <> b.id AND {where} GROUP BY a.id),
G{name} AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS reps UNION ALL
  SELECT g.k + 1, CASE WHEN list_has_any(coalesce(nb, CAST([] AS BIGINT[])), g.reps) THEN g.reps ELSE list_append(g.reps, o.id) END FROM G{name} g JOIN O{name} o ON o.k = g.k + 1 LEFT JOIN NB{name} n ON n.id = o.id),
RP{name} AS (SELECT unnest(reps) AS rep FROM G{name} WHERE k = (SELECT max(k) FROM O{name}))"""


_NEAR = "list_distance(a.v, b.v) <= {}e0"
_MEMBERS = "ME AS (SELECT id, rep, d FROM (SELECT a.id, rep, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), rep) AS rk FROM E a JOIN RP ON true JOIN E b ON b.id = rep) WHERE rk = 1)"
_OWNED = f"{E_}, {_net(_NEAR.format(EPS))}, {_MEMBERS}"


@query(R + _OWNED + " SELECT id, rep, round(d, 6) AS d FROM ME")
def owned_net(spark, d):
    e = emb(spark, d)
    return r6(N.owned_net(e, marks(e), EPS, 8))


_CELLS = f"{E_}, {M_}, {AS_}, T AS (SELECT id, l FROM A WHERE rk = 1)"
_SAME = "(SELECT l FROM T WHERE T.id = a.id) = (SELECT l FROM T WHERE T.id = b.id)"


@query(R + f"""{_CELLS}, {_net(f"{_NEAR.format(EPS)} AND {_SAME}")}
SELECT id, rep FROM (SELECT a.id, rep, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), rep) AS rk FROM E a JOIN T x ON x.id = a.id JOIN RP ON true JOIN T y ON y.id = rep AND y.l = x.l JOIN E b ON b.id = rep) WHERE rk = 1""")
def epsilon_net(spark, d):
    """A net of each landmark's cell, each row with its nearest representative."""
    e = emb(spark, d)
    return N.epsilon_net(e, marks(e), EPS)


@query(R + f"{E_}, " + ", ".join(_net(_NEAR.format(r), str(k)) for k, r in enumerate(RADII)) + " " + " UNION ALL ".join(f"SELECT {r}e0 AS radius, count(*) AS n FROM RP{k}" for k, r in enumerate(RADII)))
def cover_counts(spark, d):
    """Sizes of greedy covers at nine radii, from one pass."""
    e = emb(spark, d)
    return N.cover_counts(e, marks(e), RADII, 8)


@query()
def delta_choice(spark, d):
    """The radius whose net keeps a quarter to a half of the rows, and how it was found."""
    e = emb(spark, d)
    n = e.count()
    got = N.choose_delta(e, marks(e), (n / 4, n / 2), 0.0, passes=2, grid=12)
    return r6(spark.createDataFrame([(got["mode"], got["delta"], got["eps_ref"], int(got["r_est"]), got["fidelity"])], "mode string, delta double, eps_ref double, r_est long, fidelity double"))


@query(W + f"{E_}, {D_}, {N1_}, Q AS (SELECT quantile_cont(d, 0.01) AS e FROM N1) SELECT round(count(*) FILTER (d <= e) / CAST(count(*) FILTER (d <= 1.2e0) AS DOUBLE), 6) AS fidelity FROM D, Q WHERE i < j")
def pair_fidelity_all(spark, d):
    """Of all pairs within 1.2, the share within epsilon."""
    e = emb(spark, d)
    eps = K.one_nn(e).agg(F.percentile("d", F.lit(0.01))).first()[0]
    return r6(spark.createDataFrame([(N.pair_fidelity(e, 1.2, eps),)], "fidelity double"))


@query(f"""WITH RECURSIVE {E_}, {M_}, {AS_}, C AS (SELECT l, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l) AS k FROM A WHERE rk = 1 GROUP BY l),
P AS (SELECT CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS bunch UNION ALL
  SELECT p.k + 1, list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN c.n ELSE 0 END), c.l, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT) FROM P p JOIN C c ON c.k = p.k + 1)
SELECT l, bunch FROM P WHERE k > 0""")
def bunches_by_mass(spark, d):
    """Landmarks packed into five bunches, the heaviest first to the lightest."""
    e = emb(spark, d)
    return N.longest_first(K.assign(e, marks(e), 1).groupBy("l").agg(F.count("*").alias("n")), 5)


@query("SELECT vec_id AS l, ((row_number() OVER (ORDER BY vec_id) - 1) * 5) // count(*) OVER () AS bunch FROM embeddings WHERE vec_id % 31 = 7")
def landmark_bunches(spark, d):
    """Five blocks of landmarks by position; their ids are no positions."""
    return N.contiguous(emb(spark, d).where("id % 31 = 7"), 5)


GK = 10
_TREE = f"""L0 AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM E a JOIN E b ON a.id <> b.id AND a.id < {MARKS} AND b.id < {MARKS}),
""" + ",\n".join(f"L{k} AS MATERIALIZED (SELECT i, j, min(d) AS d FROM (SELECT * FROM L{k - 1} UNION ALL SELECT x.i, y.j, greatest(x.d, y.d) AS d FROM L{k - 1} x JOIN L{k - 1} y ON x.j = y.i AND x.i <> y.j) GROUP BY i, j)" for k in range(1, 5)) + """,
T AS (SELECT L0.i, L0.j FROM L0 JOIN L4 ON L0.i = L4.i AND L0.j = L4.j WHERE L0.i < L0.j AND L0.d <= L4.d)"""
_WHOLE = f"""{_OWNED}, WT AS (SELECT rep AS id, count(*) AS n FROM ME GROUP BY rep),
RK AS (SELECT * FROM (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rk FROM E a JOIN WT x ON x.id = a.id JOIN WT y ON y.id <> a.id JOIN E b ON b.id = y.id) WHERE rk <= {GK}),
RH AS (SELECT i, coalesce(min(CASE WHEN d > 0 THEN d END), 0) AS rho, greatest(avg(d) - coalesce(min(CASE WHEN d > 0 THEN d END), 0), 1e-12) AS sigma FROM RK GROUP BY i),
PP AS (SELECT RK.i, RK.j, exp(-greatest(d - rho, 0) / sigma) AS p FROM RK JOIN RH ON RK.i = RH.i),
U0 AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, 1 - coalesce(max(CASE WHEN i < j THEN 1 - p END), 1) * coalesce(max(CASE WHEN i > j THEN 1 - p END), 1) AS w FROM PP GROUP BY 1, 2),
U1 AS (SELECT src, dst, w * sqrt(a.n * b.n) AS w FROM U0 JOIN WT a ON a.id = src JOIN WT b ON b.id = dst),
{_TREE},
NR AS (SELECT i, rep FROM (SELECT a.id AS i, b.id AS rep, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rk FROM E a JOIN WT ON true JOIN E b ON b.id = WT.id WHERE a.id < {MARKS}) WHERE rk = 1),
S AS (SELECT least(x.rep, y.rep) AS src, greatest(x.rep, y.rep) AS dst, count(*) * 0.01e0 AS w FROM T JOIN NR x ON T.i = x.i JOIN NR y ON T.j = y.i WHERE x.rep <> y.rep GROUP BY 1, 2),
UB AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w / (SELECT max(w) FROM U1) AS w FROM U1 UNION ALL SELECT * FROM S) GROUP BY 1, 2)"""


@query(R + _WHOLE + " SELECT src, dst, round(w / (SELECT max(w) FROM UB), 6) AS w FROM UB")
def whole_graph(spark, d):
    """Net, multiplicities, neighbours, union and backbone in one table of edges."""
    e = emb(spark, d)
    return r6(B.graph(e, marks(e), EPS, GK, closed_form=True).edges)


@query(R + _OWNED + " SELECT rep AS id, count(*) AS weight FROM ME GROUP BY rep")
def net_multiplicities(spark, d):
    e = emb(spark, d)
    net = N.owned_net(e, marks(e), EPS, 3)
    return net.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("weight"))


_COMP = f"""{E_}, {D_}, N2 AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM D) WHERE rk = 1), BB AS (SELECT i, j FROM N2 UNION SELECT j, i FROM N2),
X AS (SELECT id, id AS root FROM E UNION SELECT BB.j, X.root FROM X JOIN BB ON X.id = BB.i), C AS MATERIALIZED (SELECT id, min(root) AS root FROM X GROUP BY id),
CE AS MATERIALIZED (SELECT x.root AS i, y.root AS j, min(d) AS d, min_by(least(D.i, D.j), d) AS src, min_by(greatest(D.i, D.j), d) AS dst FROM D JOIN C x ON D.i = x.id JOIN C y ON D.j = y.id WHERE x.root <> y.root GROUP BY 1, 2),
""" + "Y0 AS (SELECT i, j, d FROM CE),\n" + ",\n".join(f"Y{k} AS MATERIALIZED (SELECT i, j, min(d) AS d FROM (SELECT * FROM Y{k - 1} UNION ALL SELECT x.i, y.j, greatest(x.d, y.d) AS d FROM Y{k - 1} x JOIN Y{k - 1} y ON x.j = y.i AND x.i <> y.j) GROUP BY i, j)" for k in range(1, 9))


@query(R + _COMP + " SELECT DISTINCT src, dst, round(CE.d, 6) AS d FROM CE JOIN Y8 ON CE.i = Y8.i AND CE.j = Y8.j WHERE CE.d <= Y8.d")
def bridges(spark, d):
    """The shortest edges that connect the components of the nearest-neighbour graph."""
    e = emb(spark, d)
    near = cut(K.knn(e, B.LIST))  # one search of all rows
    return r6(B.bridges(e, near.where("rk = 1").select("i", "j"), near))


# ---- paths along the graph ------------------------------------------------
_SYM = "SY AS MATERIALIZED (SELECT s, t, min(d) AS d FROM (SELECT i AS s, j AS t, d FROM KN UNION ALL SELECT j, i, d FROM KN) GROUP BY 1, 2)"


def _paths(where: str, rounds: int = 14) -> str:
    """F{rounds}: path lengths (a, b, g) from the rows where ``where`` holds, over SY."""
    return f"F0 AS (SELECT id AS a, id AS b, 0e0 AS g FROM E WHERE {where}), " + ", ".join(f"F{k} AS MATERIALIZED (SELECT a, b, min(g) AS g FROM (SELECT * FROM F{k - 1} UNION ALL SELECT f.a, s.t AS b, f.g + s.d AS g FROM F{k - 1} f JOIN SY s ON s.s = f.b) GROUP BY a, b)" for k in range(1, rounds + 1))


_GEO = f"{E_}, {D_}, {KN_}, {_SYM}, {_paths(f'id < {MARKS}')}"


@query(W + _GEO + f" SELECT a, b, round(g, 6) AS g FROM F14 WHERE b < {MARKS}")
def geodesics(spark, d):
    """Path lengths between landmarks, along the graph of all rows."""
    e = emb(spark, d)
    found = A.paths(A.neighbour_graph(e, KNN), marks(e).select("id"))
    own = marks(e).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("g"))
    between = found.where(F.col("id") < MARKS).select(F.col("src").alias("a"), F.col("id").alias("b"), "g")
    return r6(between.unionByName(own))


@query(W + _GEO + f""", {Z_}, LP AS (SELECT f.g AS d, list_distance(x.v, y.v) AS e FROM F14 f JOIN Z x ON x.id = f.a JOIN Z y ON y.id = f.b WHERE f.a < f.b AND f.b < {MARKS})
SELECT round(sum(e * d) / sum(d * d), 6) AS scale, round((sum(e * e) - sum(e * d) * sum(e * d) / sum(d * d)) / sum(e * e), 6) AS loss FROM LP""")
def landmark_stress(spark, d):
    """Stress of the map against path lengths between landmarks."""
    e = emb(spark, d)
    found = A.paths(A.neighbour_graph(e, KNN), marks(e).select("id")).where((F.col("src") < F.col("id")) & (F.col("id") < MARKS))
    return r6(O.scale_free_stress(O.mapped(found.select(F.col("src").alias("i"), F.col("id").alias("j"), F.col("g").alias("d")), flat(marks(e)))))


TARGETS = 64
_FID = f"""{E_}, {Z_}, {D_}, {KN_}, {RHO_}, {FU_}, SY AS MATERIALIZED (SELECT s, t, min(1 / greatest(w, 1e-6)) AS d FROM (SELECT src AS s, dst AS t, w FROM U UNION ALL SELECT dst, src, w FROM U) GROUP BY 1, 2),
{_paths("id % 100 = 0", 20)}, TG AS (SELECT a, b, g FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY g, b) AS rk FROM F20 WHERE a <> b) WHERE rk <= {TARGETS})"""


@query(W + _FID + " SELECT a AS src, b AS id, round(g, 6) AS g, round(list_distance(x.v, y.v), 6) AS e FROM TG JOIN Z x ON x.id = a JOIN Z y ON y.id = b")
def geodesic_pairs(spark, d):
    """From every hundredth row the 64 nearest nodes by memberships, and their distances in the map."""
    e = emb(spark, d)
    return r6(A.fidelity_pairs(fuzzy(e), flat(e), e.where("id % 100 = 0").select("id"), TARGETS))


@query(W + _FID + ", G AS (SELECT g, list_distance(x.v, y.v) AS e FROM TG JOIN Z x ON x.id = a JOIN Z y ON y.id = b)" + _FIGURES.replace(", R AS", ", RR AS").replace("FROM R)", "FROM RR)").replace("FROM R ", "FROM RR "))
def geodesic_fidelity(spark, d):
    """Shepard figures of path lengths against distances in the map."""
    e = emb(spark, d)
    found = A.fidelity_pairs(fuzzy(e), flat(e), e.where("id % 100 = 0").select("id"), TARGETS)
    return r6(Q.shepard(cut(found.select("g", "e"))))


@query()
def geodesic_fps(spark, d):
    return A.geodesic_fps(emb(spark, d), KNN, 8)


@query()
def geodesic_discs(spark, d):
    return A.poisson_landmarks(emb(spark, d), KNN, 8)


# ---- draws, tests, alignment ----------------------------------------------
@query(f"WITH {_ED} SELECT src, dst, round(w / (SELECT sum(w) FROM ED) * 1e3, 6) AS p FROM ED")
def alias_law(spark, d):
    """The probability, in thousandths, that stored alias tables give each row."""
    t = AL.build(_bipartite(spark, d), ["src", "dst"], "w")
    return r6(t.law().select("src", "dst", (F.col("p") * 1e3).alias("p")))


@query()
def alias_draw(spark, d):
    """1,000 draws by alias tables."""
    return AL.build(_bipartite(spark, d), ["src", "dst"], "w").draw(1000, 7)


@query()
def batch_test(spark, d):
    """Are texts of low quality longer or shorter? 999 permutations."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("s"), "quality")
    return r6(BT.batch_test(rows.where("quality = 1").select("id", "s"), rows.where("quality = 0").select("id", "s"), 999, 5))


@query("""WITH R AS (SELECT d.doc_id, n_chars, quality, row_number() OVER (ORDER BY n_chars, d.doc_id) AS rk FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IN (0, 1) AND n_chars IS NOT NULL)
SELECT CAST(sum(rk) FILTER (quality = 0) - count(*) FILTER (quality = 0) * (count(*) FILTER (quality = 0) + 1) / 2 AS DOUBLE) AS statistic, count(*) FILTER (quality = 1) AS n_calib, count(*) FILTER (quality = 0) AS n_batch,
  CAST(quantile_disc(n_chars, 0.5) FILTER (quality = 0) - quantile_disc(n_chars, 0.5) FILTER (quality = 1) AS DOUBLE) AS median_shift FROM R""")
def batch_statistic(spark, d):
    return batch_test(spark, d).drop("p_global")


@query(W + f"""{E_}, M AS (SELECT avg(v[1]) AS z1, avg(v[2]) AS z2, avg(v[3]) AS y1, avg(v[4]) AS y2 FROM E), C AS (SELECT id, v[1] - z1 AS z1, v[2] - z2 AS z2, v[3] - y1 AS y1, v[4] - y2 AS y2 FROM E, M),
X AS (SELECT sum(y1 * z1) + sum(y2 * z2) AS c, sum(y2 * z1) - sum(y1 * z2) AS s, sum(y1 * y1 + y2 * y2) AS yy FROM C), S AS (SELECT c / sqrt(c * c + s * s) AS c, s / sqrt(c * c + s * s) AS s, sqrt(c * c + s * s) / yy AS k FROM X)
SELECT round(atan2(s, c), 6) AS angle, round(k, 6) AS scale, round(avg((pow(z1 - k * (y1 * c + y2 * s), 2) + pow(z2 - k * (y2 * c - y1 * s), 2)) / 2), 6) AS loss FROM C, S GROUP BY s, c, k""")
def procrustes_anchor(spark, d):
    """The rotation and scale that carry coordinates 3 and 4 onto 1 and 2, and what is left."""
    rows = emb(spark, d).select("id", F.slice("v", 1, 2).alias("z"), F.slice("v", 3, 2).alias("y"))
    _, fit = O.procrustes(rows)
    r = fit["rotation"]
    return r6(spark.createDataFrame([(math.atan2(r[1, 0], r[0, 0]), fit["scale"], fit["loss"])], "angle double, scale double, loss double"))


@query("""WITH X AS (SELECT l_orderkey AS o, l_linenumber AS t, min(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
D AS (SELECT abs(a.p - b.p) AS n, abs(a.p - c.p) AS m, abs(a.p - e.p) AS f FROM X a JOIN X b ON a.o = b.o AND b.t = a.t + 1 JOIN X c ON a.o = c.o AND c.t = a.t + 2 JOIN X e ON a.o = e.o AND e.t = a.t + 3), S AS (SELECT avg(f) AS s FROM D)
SELECT round(avg(greatest(0.05e0 - (m - n) / s, 0)) + avg(greatest(0.05e0 - (f - m) / s, 0)) + avg(greatest(0.25e0 - m / 2e0 / greatest(n, 1e-8), 0) + greatest(m / 2e0 / greatest(n, 1e-8) - 4, 0)), 6) AS loss, round(max(s), 6) AS scale, round(avg(CASE WHEN n < m AND m < f THEN 1e0 ELSE 0 END), 6) AS ord_frac FROM D, S""")
def path_loss(spark, d):
    """Order and speed hinges of prices along the lines of an order."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("t")).agg(F.min("l_extendedprice").alias("p"))
    out = x
    for k, n in ((1, "near"), (2, "mid"), (3, "far")):
        out = out.join(x.select("o", (F.col("t") - k).alias("t"), F.col("p").alias(n)), ["o", "t"])
    gaps = out.select(*(F.abs(F.col("p") - F.col(n)).alias(f"d_{n}") for n in ("near", "mid", "far")), F.lit(1.0).alias("dt_near"), F.lit(2.0).alias("dt_mid"))
    return r6(P.path_loss(gaps))


# ---- scales ---------------------------------------------------------------
@query(W + f"{E_}, D1 AS (SELECT list_distance(a.v[1:32], b.v[1:32]) AS x, list_distance(a.v[33:64], b.v[33:64]) AS y FROM E a JOIN E b ON a.id < b.id) SELECT 1 AS block, round(quantile_disc(x, 0.5), 6) AS scale FROM D1 UNION ALL SELECT 2, round(quantile_disc(y, 0.5), 6) FROM D1")
def composite_scales(spark, d):
    """The median distance of all pairs of rows in each half of the vectors."""
    e = emb(spark, d)
    out = [(k, K.median_distance(e.select("id", F.slice("v", 32 * k - 31, 32).alias("v")))) for k in (1, 2)]
    return r6(spark.createDataFrame(out, "block int, scale double"))


_V1 = "F1 AS (SELECT id, [x / sqrt(list_sum([y * y for y in v[1:32]])) for x in v[1:32]] AS v FROM E), F2 AS (SELECT id, [ln(sqrt(list_sum([y * y for y in v[1:32]])))] AS v FROM E)"


@query(W + f"{E_}, {_V1} " + " UNION ALL ".join(f"SELECT '{n}' AS factor, round(quantile_disc(d, 0.5), 6) AS scale FROM (SELECT min(list_distance(a.v, b.v)) AS d FROM F{k} a JOIN F{k} b ON a.id <> b.id GROUP BY a.id)" for k, n in ((1, "direction"), (2, "log_scale"))))
def factor_scales(spark, d):
    """Median nearest distance in the views of direction and length of the first half."""
    half = lambda v: F.slice(v, 1, 32)
    size = lambda v: F.sqrt(F.aggregate(half(v), F.lit(0.0), lambda s, x: s + x * x))
    got = K.view_scales(emb(spark, d), {"direction": lambda v: F.transform(half(v), lambda x: x / size(v)), "log_scale": lambda v: F.array(F.ln(size(v)))})
    return r6(spark.createDataFrame(list(got.items()), "factor string, scale double"))


@query(W + f"{E_}, P AS (SELECT a.v[1] AS lo, b.v[1] AS hi FROM E a JOIN E b ON a.label = 0 AND b.label = 1), S AS (SELECT stddev_samp(u) AS s FROM (SELECT lo AS u FROM P UNION ALL SELECT hi FROM P)) SELECT round(avg(greatest(0.5e0 - (hi - lo) / s, 0)), 6) AS loss, round(avg(CASE WHEN 0.5e0 - (hi - lo) / s > 0 THEN 1e0 ELSE 0 END), 6) AS active FROM P, S")
def class_order_hinge(spark, d):
    rows = emb(spark, d).join(labels(spark, d), "id").select("id", "label", F.col("v")[0].alias("s"))
    return r6(O.class_order(rows.where("label = 0").select("id", "s"), rows.where("label = 1").select("id", "s"), 0.5))


@query("""WITH T AS (SELECT o_orderkey, date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (), CAST(o_orderdate AS DATE)) / CAST(date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (), max(CAST(o_orderdate AS DATE)) OVER ()) AS DOUBLE) AS t FROM orders)
SELECT o_orderkey, round(CASE WHEN t < 0.3e0 THEN 0 WHEN t >= 0.6e0 THEN 1 ELSE (t - 0.3e0) / (0.6e0 - 0.3e0) END, 6) AS up, round(1 - CASE WHEN t >= 0.25e0 THEN 1 ELSE t / 0.25e0 END, 6) AS down FROM T""")
def ramps(spark, d):
    """Weights of two schedules over the time span of the orders."""
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    span = rows.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    t = F.datediff("day", "first") / F.datediff("last", "first")
    return r6(rows.crossJoin(F.broadcast(span)).select("o_orderkey", O.ramp(t, 0.3, 0.6).alias("up"), O.ramp(t, 0.0, 0.25, True).alias("down")))  # one row


# ---- layouts, streams, approximate neighbours -----------------------------
@query()
def spectral_layout(spark, d):
    """Two eigenvectors of the neighbour graph's normalised affinity."""
    z = SP.layout(fuzzy(emb(spark, d)), 2)
    return r6(z.select("id", F.col("z")[0].alias("x"), F.col("z")[1].alias("y")))


@query()
def stream_cells(spark, d):
    """A net by keyed state from a stream of four files of embeddings."""
    e = emb(spark, d)
    uri = fresh_dir(spark, "cells")
    e.repartitionByRange(4, "id").write.parquet(f"{uri}/in")
    stream = spark.readStream.schema("id long, v array<double>").option("maxFilesPerTrigger", 1).parquet(f"{uri}/in")
    net = CellNet(spark, f"{uri}/net", marks(e), EPS)
    net.start(stream).awaitTermination()
    return r6(net.members().select("id", "rep", "l", "d", "spawned", "novel"))


@query()
def knn_projected(spark, d):
    """Approximate neighbours of all rows, at a measured recall of 0.9 or more."""
    return r6(K.knn_projected(emb(spark, d), KNN)[0])


@query(W + f"{E_}, {D_}, {KN_} SELECT i, rk, j, round(d, 6) AS d FROM KN")
def knn_refreshed(spark, d):
    """Neighbours after every seventh row moved here from elsewhere: those of all rows."""
    e = emb(spark, d)
    before = cut(K.knn(e.select("id", F.when(F.col("id") % 7 == 0, F.transform("v", lambda x: -x)).otherwise(F.col("v")).alias("v")), KNN))
    return r6(refresh_dirty(before, e.where("id % 7 = 0").select("id"), e, KNN))


# ---- class regions, stores, pyramids --------------------------------------
_CR = f"""{E_}, {D_}, CR AS (SELECT id, grp, d FROM (SELECT D.i AS id, b.label AS grp, D.d, row_number() OVER (PARTITION BY D.i, b.label ORDER BY D.d, D.j) AS rk FROM D JOIN E b ON D.j = b.id WHERE D.j % 2 = 0) WHERE rk = 5),
CC AS (SELECT CR.grp, CR.d FROM CR JOIN E ON E.id = CR.id AND E.label = CR.grp WHERE CR.id % 2 = 0),
CP AS (SELECT t.id, t.grp, (1 + count(*) FILTER (CC.d >= t.d)) / CAST(count(*) + 1 AS DOUBLE) AS p FROM CR t JOIN CC ON CC.grp = t.grp WHERE t.id % 2 = 1 GROUP BY 1, 2)"""


def _region_p(spark, d):
    """p-values of odd rows in each class's region, calibrated on its own even rows."""
    e = emb(spark, d)
    own = e.join(labels(spark, d), "id").where("id % 2 = 0")
    s = cut(K.class_nearest(e, own, 5).where("rk = 5").select(F.col("i").alias("id"), F.col("label").alias("grp"), F.col("d").alias("s")))
    calib = s.where("id % 2 = 0").join(labels(spark, d), "id").where("label = grp").select("grp", "s")
    return C.p_values(s.where("id % 2 = 1"), calib, ["grp"]).select("id", "grp", "p")


@query(W + _CR + " SELECT id, grp, round(p, 6) AS p FROM CP")
def class_region_p(spark, d):
    return r6(_region_p(spark, d))


@query(W + _CR + " SELECT id, coalesce(string_agg(CAST(grp AS VARCHAR), ',' ORDER BY grp) FILTER (p > 0.4e0), '') AS classes FROM CP GROUP BY id")
def class_region_set(spark, d):
    sets = C.prediction_sets(_region_p(spark, d), 0.4)
    return sets.select("id", F.concat_ws(",", F.transform("groups", lambda x: x.cast("string"))).alias("classes"))


@query(W + f"{E_}, {M_}, {AS_}, H AS (SELECT l, count(*) FILTER (id % 61 = 0) AS c FROM A WHERE rk = 1 GROUP BY l) SELECT l AS cell, CAST(coalesce(sum(greatest(c, 1)) OVER (ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(greatest(c, 1) AS BIGINT) AS n FROM H")
def active_cell_rows(spark, d):
    """Where each landmark cell's active rows (every 61st) stand, one cell after another."""
    e = emb(spark, d)
    return S.active_members(K.assign(e, marks(e), 1).select("id", F.col("l").alias("cell")), e.where("id % 61 = 0"))[1]


@query(W + f"{E_}, {D_}, {KN_}, B AS (SELECT stddev_samp(r) AS s FROM (SELECT ln(greatest(max(d), 1e-12)) AS r FROM KN GROUP BY i)) SELECT (SELECT dim FROM ({ORACLES['intrinsic_dim']})) AS dim, 2 AS d_out, round(s, 6) AS ambient_sd FROM B")
def density_budget(spark, d):
    """Intrinsic dimension, and the spread of log neighbour radii that a map may show."""
    e = emb(spark, d)
    near = cut(K.knn(e, KNN))
    spread = G.log_radius(near).agg(F.stddev_samp("log_r").alias("ambient_sd"))
    return r6(G.intrinsic_dimension(near.where("rk <= 10")).crossJoin(spread).select("dim", F.lit(2).alias("d_out"), "ambient_sd"))  # one row each


@query(W + f"{E_}, {D_}, {KN_} SELECT i, rk, j, round(d, 6) AS d FROM KN")
def knn_stored(spark, d):
    """Neighbours that were filled in four slices, audited, marked complete and read back."""
    e = emb(spark, d)
    store = KnnStore(spark, fresh_dir(spark, "knn"))
    store.create(e.count(), KNN, 4)
    for k in range(4):
        store.write(k, K.nearest(e.where(F.col("id") % 4 == k), e, KNN))
    store.mark_complete()
    return r6(store.load())


@query(R + _WHOLE + " SELECT src, dst, round(w / (SELECT max(w) FROM UB), 6) AS w FROM UB")
def graph_stored(spark, d):
    """The edges of a whole graph, stored and read back."""
    e = emb(spark, d)
    store = GraphStore(spark, fresh_dir(spark, "graph"))
    save_graph(store, B.graph(e, marks(e), EPS, GK, closed_form=True), {"config": {"k": GK, "delta": EPS}})
    return r6(load_graph(store).edges)


@query()
def graph_pyramid(spark, d):
    """Edges of a whole graph and of its coarser levels, the coarsest in one part."""
    e = emb(spark, d)
    levels = B.pyramid(e, marks(e), B.graph(e, marks(e), EPS, GK, closed_form=True), ratio=3.0, least=24)
    out = [x.edges.select(F.lit(k).alias("level"), "src", "dst", "w") for k, x in enumerate(levels)]
    return r6(reduce(lambda a, b: a.unionByName(b), out))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts < time_bucket(INTERVAL '1 hour', (SELECT max(ts) FROM events) - INTERVAL '10 minutes') GROUP BY 1, 2""")
def event_windows(spark, d):
    """Counts and sums by hour and type of the event stream, of the hours that the watermark closed."""
    uri = fresh_dir(spark, "windows")
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(f"{uri}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{uri}/in")  # one batch: no row is late
    counts = I.event_windows(stream).select(F.col("window.start").alias("start"), "event_type", "n", "total")
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{uri}/out/batch={batch}")
    counts.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{uri}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{uri}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
