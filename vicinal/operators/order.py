"""Running sums and ranks over a whole table's order, without a window over one partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.operators.lineage import cut

#: Rows of a stretch, about, stretches at least and at most, and keys that their ends
#: are chosen from.
ROWS, LEAST, MOST, KEYS = 50_000, 64, 1024, 4096
#: Cuts that are compared one by one.
FEW = 64


def stretches(n: int) -> int:
    """How many stretches ``n`` rows are cut into."""
    return max(LEAST, min(MOST, -(-n // ROWS)))


def bucket(cuts: list[Column], key: Column) -> Column:
    """How many of the rising ``cuts`` lie below ``key``; many are compared in two steps."""
    below = lambda some: F.size(F.filter(some, lambda x: x < key))
    if not cuts:
        return F.lit(0)
    if len(cuts) <= FEW:
        return below(F.array(*cuts))
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    at = below(F.array(*(g[0] for g in groups))) - 1
    return F.when(at < 0, 0).otherwise(at * step + below(F.array(*(F.array(*g) for g in groups))[F.greatest(at, F.lit(0))]))


def stretch(rows: DataFrame, order: list[str], parts: int | None = None) -> Column:
    """The number of a row's stretch of the order by the columns, nulls first.

    The ends are even cuts of the ``KEYS`` keys of smallest hash, the only rows
    that reach the driver. They say how even the stretches are, not what
    belongs together: rows of equal keys share one. Their number follows the rows'."""
    dtypes = dict(rows.dtypes)
    some = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(KEYS).orderBy(*order).collect()
    if parts is None:
        parts = LEAST if len(some) < KEYS else stretches(rows.count())
    ends = [some[k] for k in sorted({len(some) * k // parts for k in range(1, parts)})] if some else []
    key = lambda values: F.struct(*(v.cast(dtypes[c]).alias(c) for c, v in zip(order, values, strict=True)))
    return bucket([key([F.lit(x) for x in end]) for end in ends], key([F.col(c) for c in order]))


def before(rows: DataFrame, order: list[str], value: Column | None = None, parts: int | None = None) -> DataFrame:
    """Add ``before``: the sum of ``value`` (or the count) over the rows ahead in
    the order by the columns, whose keys should be distinct; and ``stretch``, the
    row's own. A sum is taken in each stretch, and those of the stretches ahead
    are added. The rows are stored first, as several jobs read them."""
    rows = cut(rows)
    dealt = rows.withColumn("stretch", stretch(rows, order, parts)).withColumn("_v", F.lit(1).cast("long") if value is None else value)
    sums = dealt.groupBy("stretch").agg(F.sum("_v").alias("_m"))
    other = sums.select(F.col("stretch").alias("_other"), F.col("_m").alias("_n"))
    ahead = sums.crossJoin(F.broadcast(other)).groupBy("stretch").agg(F.sum(F.when(F.col("_other") < F.col("stretch"), F.col("_n"))).alias("_lower"))  # MOST rows
    up = Window.partitionBy("stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_own", F.sum("_v").over(up)).join(F.broadcast(ahead), "stretch")
    return out.select(*rows.columns, "stretch", (F.coalesce("_lower", F.lit(0)) + F.coalesce("_own", F.lit(0))).alias("before"))
