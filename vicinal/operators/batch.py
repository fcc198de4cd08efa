"""Permutation tests whose labels are hashes, so that no permutation shuffles rows.

A keyed Feistel network permutes positions 0 .. n - 1; the rows that it sends below
the batch's size are the batch of that permutation, exactly as many as there are.
Any task can label its rows for any permutation by itself; it adds up the ranks of
the labelled ones, and only these partial sums meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.lineage import cut
from vicinal.operators.order import before

#: Permutations that a task labels at a time, and rounds of the network.
STEP, FEISTEL = 64, 4


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(position: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Where each permutation (a row for each key) sends each position below ``n``."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.broadcast_to(position.astype(np.uint64), (len(key), len(position))).copy()
    live = np.ones(out.shape, bool)
    keys = np.broadcast_to(key.astype(np.uint64)[:, None], out.shape)
    while live.any():  # again for what falls outside: a cycle always comes back in
        left, right, k = out[live] >> half, out[live] & mask, keys[live]
        for r in range(FEISTEL):
            left, right = right, left ^ (_mixed(right ^ _mixed(k + np.uint64(r + 1))) & mask)
        out[live] = (left << half) | right
        live = out >= np.uint64(n)
    return out.astype(np.int64)


def keys(count: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 64)))


def batch_test(calib: DataFrame, batch: DataFrame, permutations: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: p_global, statistic (U of the batch's scores against those of
    calibration), n_calib, n_batch and median_shift, for rows (id, s). Ties go by id,
    calibration first; null scores are left out. p = (1 + permutations with at least
    this U) / (permutations + 1)."""
    one = lambda df, side: df.where(F.col("s").isNotNull()).select("id", "s", F.lit(side).alias("side"))
    pool = before(one(calib, 0).unionByName(one(batch, 1)), ["s", "id", "side"])
    pool = cut(pool.select("side", "s", F.col("before").alias("at")))
    median = lambda side: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN side = {side} THEN s END)")
    seen = pool.agg(F.count("*").alias("n"), F.sum("side").alias("m"), F.sum(F.when(F.col("side") == 1, F.col("at") + 1)).alias("ranks"), median(1).alias("b"), median(0).alias("c")).first()
    n, m = seen.n, seen.m or 0
    statistic = float((seen.ranks or 0) - m * (m + 1) / 2)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = keys(permutations, seed), np.zeros(permutations, np.int64)
        for rows in batches:
            at = rows.column(0).to_numpy()
            for k in range(0, permutations, STEP):
                sums[k : k + STEP] += ((permuted(at, n, key[k : k + STEP]) < m) * (at + 1)).sum(1)
        yield pa.RecordBatch.from_pydict({"p": np.arange(permutations), "ranks": sums})

    per = pool.select("at").mapInArrow(partial, "p long, ranks long").groupBy("p").agg(F.sum("ranks").alias("ranks"))
    least = F.lit(int(seen.ranks or 0))
    ge = F.count_if(F.col("ranks") >= least) if m else F.lit(permutations)  # without a batch all are alike
    out = per.agg(ge.alias("ge"))
    shift = float(seen.b - seen.c) if n and m and m < n else None
    return out.select(((1 + F.col("ge")) / F.lit(permutations + 1)).alias("p_global"), F.lit(statistic).alias("statistic"), F.lit(n - m).cast("long").alias("n_calib"), F.lit(m).cast("long").alias("n_batch"), F.lit(shift).cast("double").alias("median_shift"))
