"""Sums of arrays over all rows, by tasks, and exact quantiles by stretches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.conformal import counted

#: Tasks that sum up the tasks' sums; so many arrays a key reach the driver.
MERGES = 32


def summed(rows: DataFrame, part: Callable[..., dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums by key of ``part(*columns)``, a dict of flat arrays for a batch of rows, where
    list columns are matrices: by task, then by ``MERGES`` tasks, then on the driver.
    Keys should be few."""

    def out(total: dict) -> Iterator[pa.RecordBatch]:
        if total:
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int64()), "x": [x.astype("<f8").tobytes() for x in total.values()]})

    def column(c: pa.Array, n: int) -> np.ndarray:
        return c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, x in part(*(column(c, batch.num_rows) for c in batch.columns)).items():
                    total[k] = total.get(k, 0.0) + x
        yield from out(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[k] = total.get(k, 0.0) + np.frombuffer(x, "<f8")
        yield from out(total)

    total: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(first, "k long, x binary").repartition(MERGES).mapInArrow(merge, "k long, x binary").collect():
        total[r.k] = total.get(r.k, 0.0) + np.frombuffer(r.x, "<f8")
    return total


def quantiles(rows: DataFrame, column: str, at: list[float], between: bool | list[bool] = True) -> list[float | None]:
    """The quantiles of a column, by straight lines between ranks or the lower value
    (``between``, for all or for each); None without values. No task sees all rows."""
    between = [between] * len(at) if isinstance(between, bool) else between
    ranks = counted(rows.select(F.col(column).alias("s"), F.lit(1).alias("c")))
    place = [q * (F.col("total") - 1) for q in at]
    reached = lambda r: F.min(F.when(F.col("le") > r, F.col("s")))
    row = ranks.agg(F.max("total").alias("n"), *(reached(f(p)).alias(f"{side}{k}") for k, p in enumerate(place) for side, f in (("l", F.floor), ("h", F.ceil)))).first()
    if not row.n:
        return [None] * len(at)
    share = [math.modf(q * (row.n - 1))[0] if b else 0.0 for q, b in zip(at, between, strict=True)]
    return [row[f"l{k}"] + (row[f"h{k}"] - row[f"l{k}"]) * s for k, s in enumerate(share)]
