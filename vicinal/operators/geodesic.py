"""Shortest paths along a neighbour graph: landmarks, discs and fidelity.

Distances spread by rounds of joins with the edges. A round only carries nodes whose
distance became less, so work follows the improvements: a new landmark relaxes the
field of least distances only where it is nearer than those before, and a source of
a bounded search stops where its nearest targets are settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.operators import knn as K
from vicinal.operators.cover import hashed
from vicinal.operators.lineage import cut

INF = float("inf")
#: Open rows of the hash order that a round of disc sampling looks at.
DARTS = 32


def both_ways(edges: DataFrame) -> DataFrame:
    """(s, t, d) of edges (s, t, d) in both directions, the shorter of double ones."""
    return edges.select("s", "t", "d").unionByName(edges.select(F.col("t").alias("s"), F.col("s").alias("t"), "d")).groupBy("s", "t").agg(F.min("d").alias("d"))


def neighbour_graph(df: DataFrame, k: int) -> DataFrame:
    """The symmetric k-neighbour graph (s, t, d)."""
    return cut(both_ways(K.knn(df, k).select(F.col("i").alias("s"), F.col("j").alias("t"), "d")))


def relax(field: DataFrame, both: DataFrame, sources: Column, below: float = INF) -> DataFrame:
    """``field`` (id, g, ...) with the distances from the rows where ``sources`` holds
    where these are less, as far as ``below``."""
    rest = [c for c in field.columns if c not in ("id", "g")]
    state = cut(field.select("id", F.when(sources, 0.0).otherwise(F.col("g")).alias("g"), *rest, sources.alias("fresh")))
    while not (front := state.where("fresh")).isEmpty():
        step = front.join(both, front["id"] == both["s"]).groupBy(F.col("t").alias("id")).agg(F.min(F.col("g") + F.col("d")).alias("to")).where(F.col("to") < below)
        less = F.coalesce(F.col("to") < F.col("g"), F.lit(False))
        state = cut(state.drop("fresh").join(step, "id", "left").select("id", F.when(less, F.col("to")).otherwise(F.col("g")).alias("g"), *rest, less.alias("fresh")))
    return state.drop("fresh")


def start(df: DataFrame, seed: int) -> DataFrame:
    return cut(df.select("id", F.lit(INF).alias("g"), hashed(seed).alias("h")))


def farthest(df: DataFrame, both: DataFrame, count: int, seed: int = 0) -> tuple[list[int], DataFrame]:
    """Ids of ``count`` landmarks, each farthest along the graph from those before, and
    the field (id, g, h) of distances to the nearest. The first is first in hash
    order; rows out of reach are farthest; ties go by hash order."""
    field, picked = start(df, seed), []
    while len(picked) < count:
        last = field.where("g > 0").agg(F.min(F.struct(-F.col("g"), "h", "id")).alias("m")).first().m
        if last is None:
            break
        picked.append(last.id)
        field = relax(field, both, F.col("id") == last.id)
    return picked, field


def geodesic_fps(df: DataFrame, k: int, count: int, seed: int = 0) -> DataFrame:
    """(k, id) of landmarks that are far apart along the neighbour graph of all rows."""
    picked, _ = farthest(df, neighbour_graph(df, k), count, seed)
    return df.sparkSession.createDataFrame(list(enumerate(picked)), "k long, id long")


def discs(df: DataFrame, both: DataFrame, radius: float, count: int | None = None, seed: int = 0) -> list[int]:
    """Rows in hash order, each at least ``radius`` along the graph from all before.

    The first ``DARTS`` open rows are compared by a bounded search; what they cover
    then closes at once."""
    field, out = start(df, seed), []
    while count is None or len(out) < count:
        first = [r.id for r in field.where(F.col("g") >= radius).orderBy("h", "id").limit(DARTS).collect()]
        if not first:
            break
        some = df.sparkSession.createDataFrame([(i,) for i in first], "id long")
        near = paths(both, some, radius=radius).join(F.broadcast(some), "id")  # DARTS rows
        met = {}
        for r in near.where(F.col("g") < radius).collect():  # at most DARTS ** 2
            met.setdefault(r.src, set()).add(r.id)
        new: list[int] = []
        for i in first:
            if not any(j in met.get(i, ()) for j in new):
                new.append(i)
        new = new if count is None else new[: count - len(out)]
        out += new
        field = relax(field, both, F.col("id").isin(new), radius)
    return out


def poisson_landmarks(df: DataFrame, k: int, count: int, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """(k, id): a disc sample whose radius is ``scale`` times the distance that
    ``count`` farthest points leave uncovered."""
    both = neighbour_graph(df, k)
    _, field = farthest(df, both, count, seed)
    radius = field.where(F.col("g") < INF).agg(F.max("g")).first()[0] or 0.0
    picked = discs(df, both, max(radius * scale, 1e-300), count, seed)
    return df.sparkSession.createDataFrame(list(enumerate(picked)), "k long, id long")


def paths(both: DataFrame, sources: DataFrame, targets: int | None = None, radius: float = INF) -> DataFrame:
    """(src, id, g): shortest distances from each of ``sources`` (id) over edges (s, t,
    d) to its ``targets`` nearest other nodes (all if not given), ties by id, that lie
    within ``radius``. A source's search stops where no open node is nearer than its
    ``targets``-th."""
    own = Window.partitionBy("src")
    state = cut(sources.select(F.col("id").alias("src"), "id", F.lit(0.0).alias("g"), F.lit(True).alias("fresh")))
    while not (front := state.where("fresh")).isEmpty():
        step = front.join(both, front["id"] == both["s"]).groupBy("src", F.col("t").alias("id")).agg(F.min(F.col("g") + F.col("d")).alias("to")).where(F.col("to") <= radius)
        less = F.coalesce(F.col("to") < F.coalesce("g", F.lit(INF)), F.lit(False))
        state = state.drop("fresh").join(step, ["src", "id"], "full").select("src", "id", F.when(less, F.col("to")).otherwise(F.col("g")).alias("g"), less.alias("fresh"))
        if targets is not None:
            rank = F.row_number().over(own.orderBy("g", "id"))
            state = state.withColumn("rk", rank).withColumn("most", F.max(F.when(F.col("rk") == targets + 1, F.col("g"))).over(own))
            state = state.where("most is null or g <= most").select("src", "id", "g", (F.col("fresh") & F.coalesce(F.col("g") < F.col("most"), F.lit(True))).alias("fresh"))
        state = cut(state)
    found = state.where("src != id").select("src", "id", "g")
    if targets is None:
        return found
    rank = F.row_number().over(own.orderBy("g", "id"))
    return found.withColumn("rk", rank).where(F.col("rk") <= targets).select("src", "id", "g")


def lengths(edges: DataFrame, least: float = 1e-6) -> DataFrame:
    """Both directions of membership edges (src, dst, w), of length 1 / w."""
    return cut(both_ways(edges.select(F.col("src").alias("s"), F.col("dst").alias("t"), (1 / F.greatest("w", F.lit(least))).alias("d"))))


def fidelity_pairs(edges: DataFrame, z: DataFrame, sources: DataFrame, targets: int) -> DataFrame:
    """(src, id, g, e): path lengths over membership edges, and distances in the map
    ``z`` (id, v), from each source to its nearest ``targets`` nodes."""
    found = paths(lengths(edges), sources, targets)
    x, y = z.select(F.col("id").alias("src"), F.col("v").alias("_x")), z.select("id", F.col("v").alias("_y"))
    far = F.sqrt(F.aggregate(F.zip_with("_x", "_y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return found.join(x, "src").join(y, "id").select("src", "id", "g", far.alias("e"))
