"""How well a map keeps distances, neighbours, densities and orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.operators import knn as K
from vicinal.operators.conformal import counted
from vicinal.operators.lineage import cut
from vicinal.operators.order import stretch
from vicinal.operators.sums import quantiles

#: Counts that a task holds of a slice of values by classes.
SLICE = 1 << 20


def ranked(rows: DataFrame, groups: list[str] | None = None, **columns: str) -> DataFrame:
    """Add the rank from 1, ties averaged, of each column under its given name,
    over the whole table or by group. Rows with a null there have none and go.
    Equal values are counted first and met by a join."""
    groups, out = groups or [], rows
    for name, c in columns.items():
        at = counted(rows.select(*groups, F.col(c).alias("s"), F.lit(1).alias("c")), groups)
        at = at.select(*groups, F.col("s").alias(c), (F.col("le") - (F.col("n") - 1) / 2).alias(name))
        out = out.join(at, [*groups, c])
    return out


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return ranked(pairs.select(a, b), ra=a, rb=b).agg(F.corr("ra", "rb").alias("rho"))


def shepard(pairs: DataFrame) -> DataFrame:
    """rho, alpha and stress of pairs (g: original, e: embedded distance)."""
    s = ranked(pairs.select("g", "e"), rg="g", re="e")
    s = s.agg(F.corr("rg", "re").alias("rho"), F.sum(F.col("g") * F.col("e")).alias("ge"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.sum(F.col("g") * F.col("g")).alias("gg"))
    alpha = F.col("ge") / F.col("ee")
    left = alpha * alpha * F.col("ee") - 2 * alpha * F.col("ge") + F.col("gg")
    return s.select("rho", alpha.alias("alpha"), F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("gg")).alias("stress"))


def shepard_banded(pairs: DataFrame, bands: int = 3, least: int = 32) -> DataFrame:
    """Spearman within bands of g between its quantiles (edges in both bands);
    null for a band of ``least`` pairs or fewer."""
    edges = quantiles(pairs, "g", [k / bands for k in range(bands + 1)])
    if edges[0] is None:
        return pairs.select(F.lit(0).alias("band"), F.lit(None).cast("double").alias("rho"), F.lit(0).cast("long").alias("n")).limit(0)
    split = pairs.withColumn("q", F.array(*map(F.lit, edges))).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands))))
    split = split.where((F.col("g") >= F.element_at("q", F.col("band"))) & (F.col("g") <= F.element_at("q", F.col("band") + 1)))
    each = ranked(split.select("band", "g", "e"), ["band"], rg="g", re="e")
    return each.groupBy("band").agg(F.when(F.count("*") > least, F.corr("rg", "re")).alias("rho"), F.count("*").alias("n"))


def ranks(dist: DataFrame) -> DataFrame:
    return dist.select("i", "j", F.row_number().over(Window.partitionBy("i").orderBy("d", "j")).alias("rk"))


def trust_continuity(original: DataFrame, embedded: DataFrame, k: int) -> DataFrame:
    """Trustworthiness and continuity of a map (id, v) of the rows (id, v): only
    the ranks that the k neighbours of one have in the other are counted."""
    n = original.count()
    loss = lambda near, other: K.ranks(near, other).agg(F.coalesce(F.sum(F.when(F.col("rk") > k, F.col("rk") - k)), F.lit(0)).alias("s"))
    trust, continuity = loss(K.knn(embedded, k), original), loss(K.knn(original, k), embedded)
    scale = 2.0 / (n * k * (2 * n - 3 * k - 1))
    one = trust.withColumnRenamed("s", "t").crossJoin(continuity)  # one row each
    return one.select((1 - scale * F.col("t")).alias("trust"), (1 - scale * F.col("s")).alias("continuity"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Means over rows of |A and B| / k and of the Jaccard index of neighbour
    sets (i, j)."""
    hit = a.select("i", "j").join(b.select("i", "j"), ["i", "j"]).groupBy("i").agg(F.count("*").alias("n"))
    rows = a.select("i").distinct().join(hit, "i", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return rows.agg(F.avg(F.col("n") / k).alias("overlap_at_k"), F.avg(F.col("n") / (2 * k - F.col("n"))).alias("jaccard_at_k"))


def rank_agreement(original: DataFrame, embedded: DataFrame) -> DataFrame:
    """Mean over query rows of the correlation of the ranks that all others have
    by distance (i, j, d) in both spaces; all pairs of a query row are ranked, so
    queries should be few."""
    both = ranks(original).withColumnRenamed("rk", "ro").join(ranks(embedded).withColumnRenamed("rk", "re"), ["i", "j"])
    return both.groupBy("i").agg(F.corr("ro", "re").alias("r")).agg(F.avg("r").alias("rank_agreement"))


def local_density(knn: DataFrame) -> DataFrame:
    return knn.groupBy("i").agg((1 / F.greatest(F.avg("d"), F.lit(1e-12))).alias("density"))


def density_correspondence(a: DataFrame, b: DataFrame) -> DataFrame:
    """OLS of log10 densities (b on a), Pearson and Spearman. The densities are
    stored once for their ranks."""
    x = local_density(a).select("i", F.log10("density").alias("x"))
    y = local_density(b).select("i", F.log10("density").alias("y"))
    both = ranked(x.join(y, "i").select("x", "y").checkpoint(), rx="x", ry="y")
    return both.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def spacing(embedded: DataFrame, original: DataFrame) -> DataFrame:
    """Spread of the k-th neighbour radius in the map, and of its log ratio to
    the original one."""
    z = embedded.groupBy("i").agg(F.max("d").alias("rz"))
    x = original.groupBy("i").agg(F.max("d").alias("rx"))
    return z.join(x, "i").agg((F.stddev_pop("rz") / F.avg("rz")).alias("spacing_cv"), F.stddev_pop(F.ln(F.col("rz") / F.col("rx"))).alias("area_sd"))


def auc_pairs(rows: DataFrame) -> DataFrame:
    """For all pairs of classes (label) with lo < hi: P(s of hi > s of lo) plus
    half the ties: (lo, hi, auc).

    Rows are counted by value and dealt to stretches of the order of values, once for
    all classes. A task goes through a stretch with a running count for each class
    and sums up the pairs within it; those between stretches follow from the
    stretches' counts. Classes and sums of their pairs are what a task holds."""
    per = cut(rows.where(F.col("label").isNotNull() & F.col("s").isNotNull()).groupBy("label", "s").agg(F.count("*").alias("c")))
    dealt = cut(per.withColumn("p", stretch(per, ["s"])))
    size = per.groupBy("label").agg(F.sum("c").alias("n"))
    classes = pa.array([r.label for r in size.select("label").orderBy("label").collect()])  # their pairs are the result
    k = len(classes)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, run, u, last, held = None, np.zeros(k), np.zeros((k, k)), None, np.zeros(k)

        def out() -> pa.RecordBatch:
            below, above = np.divmod(np.flatnonzero(u), k)
            return pa.RecordBatch.from_pydict({"a": below, "b": above, "u": u[below, above]})

        def take(own: np.ndarray, s: np.ndarray, c: np.ndarray) -> None:
            # values that end a slice are held until it is known that no more follow
            nonlocal run, u, last, held
            values, at = np.unique(s, return_inverse=True)
            m = np.zeros((len(values), k))
            np.add.at(m, (at, own), c)
            if last is not None and values[0] == last:
                m[0] += held
            elif last is not None:
                m = np.vstack([held, m])
            last, held, m = values[-1], m[-1], m[:-1]
            before = np.cumsum(m, 0) - m + run
            u += (before + m / 2).T @ m
            run = run + m.sum(0)

        def close() -> None:
            nonlocal run, u, last, held
            u += np.outer(run + held / 2, held)
            run, last, held = np.zeros(k), None, np.zeros(k)

        step = max(1, SLICE // max(k, 1))
        for batch in batches:
            part, s, c = (batch.column(n).to_numpy() for n in (0, 2, 3))
            own = pc.index_in(batch.column(1), classes).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i < j and part[i] != p:
                    close()
                    p = part[i]
                for x in range(i, j, step):
                    y = min(x + step, j)
                    take(own[x:y], s[x:y], c[x:y])
        close()
        yield out()

    ordered = dealt.select("p", "label", F.col("s").cast("double").alias("s"), "c").repartition("p").sortWithinPartitions("p", "s")
    inside = ordered.mapInArrow(within, "a long, b long, u double")
    name = rows.sparkSession.createDataFrame(list(enumerate(classes.to_pylist())), T.StructType([T.StructField("k", T.LongType()), rows.schema["label"]]))
    inside = inside.where("a < b").join(F.broadcast(name.select(F.col("k").alias("a"), F.col("label").alias("lo"))), "a").join(F.broadcast(name.select(F.col("k").alias("b"), F.col("label").alias("hi"))), "b")  # a row a class
    own = dealt.groupBy("p", "label").agg(F.sum("c").cast("double").alias("n"))
    grid = own.select("p").distinct().crossJoin(size.select("label")).join(own, ["p", "label"], "left")  # a row a stretch and class
    ahead = F.sum("n").over(Window.partitionBy("label").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    ahead = grid.select("p", F.col("label").alias("lo"), ahead.alias("m")).where("m > 0")
    between = ahead.join(own.withColumnRenamed("label", "hi"), "p").where("lo < hi").select("lo", "hi", (F.col("m") * F.col("n")).alias("u"))
    won = inside.select("lo", "hi", "u").unionByName(between).groupBy("lo", "hi").agg(F.sum("u").alias("u"))
    sizes = size.select(F.col("label").alias("lo"), F.col("n").alias("n_lo")).join(size.select(F.col("label").alias("hi"), F.col("n").alias("n_hi")), F.col("lo") < F.col("hi"))
    auc = F.coalesce("u", F.lit(0.0)) / (F.col("n_lo").cast("double") * F.col("n_hi"))
    return sizes.join(won, ["lo", "hi"], "left").select("lo", "hi", auc.alias("auc"))


def class_positions(rows: DataFrame) -> DataFrame:
    """The median s of each label (the mean of the two in the middle), from ranks by
    stretches, so that a large class is many tasks. Null s do not count."""
    at = counted(rows.where("s IS NOT NULL").select("label", "s", F.lit(1).alias("c")), ["label"])
    reached = lambda r: F.min(F.when(F.col("le") >= r, F.col("s")))
    return at.groupBy("label").agg(((reached(F.floor((F.col("total") + 1) / 2)) + reached(F.floor(F.col("total") / 2) + 1)) / 2).alias("position"))


def label_accuracy(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of rows whose neighbours' commonest label (ties: smallest) is theirs."""
    votes = knn.join(labels.select(F.col("id").alias("j"), "label"), "j").groupBy("i", "label").agg(F.count("*").alias("n"))
    won = votes.groupBy("i").agg(F.min_by("label", F.struct((-F.col("n")).alias("m"), "label")).alias("won"))
    return won.join(labels.select(F.col("id").alias("i"), "label"), "i").agg(F.avg((F.col("won") == F.col("label")).cast("double")).alias("accuracy"))


def silhouette(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean silhouette of rows (id, v) by their labels (id, label), from the mean
    distances to each class; 0 for a row alone in its class."""
    return silhouettes(rows, labels, {"silhouette": None})


def silhouettes(rows: DataFrame, labels: DataFrame, views: dict[str, int | None]) -> DataFrame:
    """The same by the first so many coordinates (None: all), a column for each view, from one
    meeting of all rows."""
    sums = K.class_sums(rows.join(labels, "id").select("id", "v", "label"), list(views.values()))
    own = sums.withColumnRenamed("label", "lj").join(labels.select(F.col("id").alias("i"), "label"), "i")
    mean = lambda k: F.col(f"s{k}") / F.col("n")
    s = own.groupBy("i").agg(*(x for k in range(len(views)) for x in (F.max(F.when(F.col("lj") == F.col("label"), mean(k))).alias(f"a{k}"), F.min(F.when(F.col("lj") != F.col("label"), mean(k))).alias(f"b{k}"))))
    return s.agg(*(F.avg(F.when(F.col(f"a{k}").isNull(), 0.0).otherwise((F.col(f"b{k}") - F.col(f"a{k}")) / F.greatest(f"a{k}", f"b{k}"))).alias(name) for k, name in enumerate(views)))


def quantile_bins(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """Add ``bin``: how many inner quantiles the value reaches."""
    edges = rows.agg(F.percentile(column, F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("q"))
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("q", lambda e: F.col(column) >= e)).cast("long")).drop("q")  # one row


def ks_uniform(p: DataFrame) -> DataFrame:
    """The largest gap between (id, p) and the uniform law."""
    ranked = counted(p.select(F.col("p").alias("s"), F.lit(1).alias("c")))
    above, below = F.col("le") / F.col("total") - F.col("s"), F.col("s") - (F.col("le") - F.col("n")) / F.col("total")
    return ranked.agg(F.max(F.greatest(above, below)).alias("ks"))
