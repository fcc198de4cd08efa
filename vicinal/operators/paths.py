"""Sequences: path triplets, collinear runs, group helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.operators.order import before


def collapse_ties(rows: DataFrame, policy: str = "first") -> DataFrame:
    """Of rows (grp, t, id) with the same grp and t: the first or last by id, or
    none (``drop``)."""
    if policy == "drop":
        return rows.withColumn("n", F.count("*").over(Window.partitionBy("grp", "t"))).where("n = 1").drop("n")
    order = F.col("id").asc() if policy == "first" else F.col("id").desc()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("grp", "t").orderBy(order))).where("n = 1").drop("n")


def triplets(rows: DataFrame, lag: int = 3, policy: str = "first") -> DataFrame:
    """(a, near, mid): rows of a group at t, t + 1 and t + lag exactly."""
    if lag < 2:
        raise ValueError("lag must be 2 at least")
    own = collapse_ties(rows, policy)
    near = own.select("grp", (F.col("t") - 1).alias("t"), F.col("id").alias("near"))
    mid = own.select("grp", (F.col("t") - lag).alias("t"), F.col("id").alias("mid"))
    return own.join(near, ["grp", "t"]).join(mid, ["grp", "t"]).select("grp", F.col("id").alias("a"), "near", "mid")


def remap(found: DataFrame, keep: DataFrame) -> DataFrame:
    """Triplets whose three ends are kept, renumbered by the order of ids."""
    number = before(keep.select("id").distinct(), ["id"]).select("id", F.col("before").alias("k"))
    out = found
    for c in ("a", "near", "mid"):
        out = out.join(number.select(F.col("id").alias(c), F.col("k").alias(f"{c}_k")), c)
    return out.select(*(F.col(f"{c}_k").alias(c) for c in ("a", "near", "mid")))


def collinear(rows: DataFrame, max_gap: float) -> DataFrame:
    """Three consecutive points (img, line, c) with both gaps in (0, max_gap]."""
    order = Window.partitionBy("img", "line").orderBy("c")
    out = rows.select("img", "line", "c", F.lead("c", 1).over(order).alias("c1"), F.lead("c", 2).over(order).alias("c2"))
    gap = lambda a, b: (F.col(b) - F.col(a) > 0) & (F.col(b) - F.col(a) <= max_gap)
    return out.where(gap("c", "c1") & gap("c1", "c2"))


def parse_index(c: Column) -> Column:
    """Digits and '-' of a sequence id as a number; null if none."""
    return F.regexp_replace(c, "[^0-9-]", "").try_cast("long")


def dense_ids(rows: DataFrame, *columns: str) -> DataFrame:
    """Add ``gid``: dense ids from 0 of the columns' values in order."""
    own = rows.withColumn("_name", F.concat_ws("|", *columns))
    ids = before(own.select("_name").distinct(), ["_name"]).select("_name", F.col("before").alias("gid"))
    return own.join(ids, "_name").drop("_name")


def subset_by_group(groups: DataFrame, n_keep: int, seed: int | None = None) -> DataFrame:
    """Whole groups (grp, n), by id or by a seeded hash, until n_keep rows are reached."""
    order = ["grp"] if seed is None else ["_h", "grp"]
    own = groups if seed is None else groups.withColumn("_h", F.xxhash64("grp", F.lit(seed)))
    return before(own, order, F.col("n")).where(F.col("before") < n_keep).select(*groups.columns)


def order_share(rows: DataFrame) -> DataFrame:
    """Share of rows with d_near < d_mid < d_far."""
    return rows.agg(F.avg(((F.col("d_near") < F.col("d_mid")) & (F.col("d_mid") < F.col("d_far"))).cast("double")).alias("ord_frac"))


def path_loss(rows: DataFrame, low: float = 0.25, high: float = 4.0, margin: float = 0.05, log_space: bool = False, floor: float = 0.0) -> DataFrame:
    """Ordinal hinges on d_near < d_mid < d_far, over the mean d_far, plus hinges that
    keep the speeds d / dt of the two nearer points within [low, high] of each other
    (``log_space``: of their logs); distances at least ``floor`` of the scale. One
    row: loss, scale, ord_frac. Without rows the loss is 0."""
    mean = rows.agg(F.avg("d_far").alias("m")).select(F.greatest(F.when(F.col("m") > 0, F.col("m")).otherwise(1.0), F.lit(1e-6)).alias("s"))
    hinge = lambda x: F.greatest(x, F.lit(0.0))
    near, mid = (F.greatest(F.col(c), floor * F.col("s")) for c in ("d_near", "d_mid"))
    v_near, v_mid = near / F.greatest("dt_near", F.lit(1e-6)), mid / F.greatest("dt_mid", F.lit(1e-6))
    if log_space:
        rel = F.ln(F.greatest(v_mid, F.lit(1e-8))) - F.ln(F.greatest(v_near, F.lit(1e-8)))
        speed = hinge(math.log(low) - rel) + hinge(rel - math.log(high))
    else:
        rel = v_mid / F.greatest(v_near, F.lit(1e-8))
        speed = hinge(low - rel) + hinge(rel - high)
    first, second = hinge(margin - (F.col("d_mid") - F.col("d_near")) / F.col("s")), hinge(margin - (F.col("d_far") - F.col("d_mid")) / F.col("s"))
    ordered = ((F.col("d_near") < F.col("d_mid")) & (F.col("d_mid") < F.col("d_far"))).cast("double")
    out = rows.crossJoin(F.broadcast(mean)).agg((F.avg(first) + F.avg(second) + F.avg(speed)).alias("loss"), F.max("s").alias("scale"), F.avg(ordered).alias("ord_frac"))  # one row
    return out.select(F.coalesce("loss", F.lit(0.0)).alias("loss"), "scale", F.coalesce("ord_frac", F.lit(0.0)).alias("ord_frac"))
