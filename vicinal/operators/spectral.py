"""Leading eigenvectors of a graph's normalised affinity, by block Krylov steps.

A product with the matrix is a join of edges with the last block of columns and a
sum by node. Columns are made orthogonal by Gram matrices: tasks add them up, a small
matrix a task reaches the driver, and a linear map goes back; a node's row holds as
many numbers as the space has columns. The small projected matrix gives the pairs
and their residuals, and steps go on until these are below the tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.lineage import cut

#: Columns of a block, and blocks at most.
BLOCK, STEPS = 8, 24


def gram(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """left' right over array columns; a matrix a task is summed on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if n := batch.num_rows:
                a, b = (c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in batch.columns)
                total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": [total.shape[0]], "m": [np.ascontiguousarray(total).tobytes()]})

    parts = rows.select(left, F.col(right).alias("_r")).mapInArrow(run, "k long, m binary").collect()
    return np.sum([np.frombuffer(r.m, "<f8").reshape(r.k, -1) for r in parts], 0)


def mapped(rows: DataFrame, keep: list[str], maps: list[tuple[str, np.ndarray]], name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of the array columns times their matrices."""
    fields = [f for f in rows.schema.fields if f.name in keep]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), f"{name} array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                of = lambda c, b=batch: b.column(b.schema.get_field_index(c))
                out = sum(of(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) @ m for c, m in maps)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(of(f.name) for f in fields), lists], names=[*(f.name for f in fields), name])

    return rows.mapInArrow(run, schema)


def orthogonal(rows: DataFrame, keep: list[str]) -> tuple[DataFrame, int]:
    """``rows`` (..., q, y) with y made orthonormal, and orthogonal to q, twice over;
    columns that depend on the others go. Also how many are left."""
    for _ in range(2):
        c, g = gram(rows, "q", "y"), gram(rows, "y", "y")
        w, u = np.linalg.eigh(g - c.T @ c)
        some = w > 1e-10 * max(float(np.trace(g)), 1e-300)
        if not some.any():
            return rows, 0
        t = u[:, some] / np.sqrt(w[some])
        rows = cut(mapped(rows, [*keep, "q"], [("y", t), ("q", -c @ t)], "y2")).withColumnRenamed("y2", "y")
    return rows, int(some.sum())


def eigenpairs(edges: DataFrame, count: int, tolerance: float = 1e-6, block: int = BLOCK, steps: int = STEPS, seed: int = 0) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """The ``count`` largest eigenvalues of D^-1/2 W D^-1/2 for edges (src, dst, w),
    rows (id, deg, u) with the unit eigenvectors, and the residuals. The first pair
    is known: value 1, vector sqrt(deg). Rounding hides residuals below some 5e-8."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    deg = cut(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")))
    d = lambda c: deg.select(F.col("id").alias(c), F.col("deg").alias(f"_{c}"))
    a = cut(both.join(d("src"), "src").join(d("dst"), "dst").groupBy("src", "dst").agg(F.sum(F.col("w") / F.sqrt(F.col("_src") * F.col("_dst"))).alias("a")))
    total = deg.agg(F.sum("deg"), F.count("*")).first()
    if total[1] < 2:
        raise ValueError("a graph of two nodes or more is needed")
    noise = F.array(*(F.xxhash64("id", F.lit(seed), F.lit(k)) / F.lit(float(1 << 63)) for k in range(block)))
    rows = cut(deg.select("id", "deg", F.array(F.sqrt(F.col("deg") / total[0])).alias("q"), noise.alias("y")))
    state, width = orthogonal(rows, ["id", "deg"])
    state = state.withColumn("aq", F.col("q"))  # the first pair is exact

    def product(x: DataFrame, width: int) -> DataFrame:
        sums = [F.sum(F.col("a") * F.col("y")[k]).alias(f"s{k}") for k in range(width)]
        out = a.join(x.select(F.col("id").alias("dst"), "y"), "dst").groupBy(F.col("src").alias("id")).agg(*sums)
        return out.select("id", F.array(*(f"s{k}" for k in range(width))).alias("ay"))

    for _ in range(steps):
        if width:
            both_ = state.join(product(state, width), "id")
            state = cut(both_.select("id", "deg", F.concat("q", "y").alias("q"), F.concat("aq", "ay").alias("aq"), F.col("ay").alias("y")))
        m, n = gram(state, "q", "aq"), gram(state, "aq", "aq")
        values, u = np.linalg.eigh((m + m.T) / 2)
        top = np.argsort(-values)[:count]
        values, u = values[top], u[:, top]
        left = np.einsum("ik,ij,jk->k", u, n, u) - 2 * values * np.einsum("ik,ij,jk->k", u, m, u) + values**2
        residual = np.sqrt(np.maximum(left, 0))
        if not width or (len(top) == count and residual.max() <= tolerance):
            break
        state, width = orthogonal(state, ["id", "deg", "aq"])
    return values, mapped(state, ["id", "deg"], [("q", u)], "u"), residual


def layout(edges: DataFrame, dims: int = 2, tolerance: float = 1e-5, seed: int = 0) -> DataFrame:
    """(id, z): the eigenvectors after the first, over sqrt(deg), each with its entry
    of largest size (ties by id) positive."""
    _, rows, _ = eigenpairs(edges, dims + 1, tolerance, seed=seed)
    z = cut(rows.select("id", *((F.col("u")[k] / F.sqrt("deg")).alias(f"z{k}") for k in range(1, dims + 1))))
    tops = [F.max_by(F.col(f"z{k}"), F.struct(F.abs(F.round(f"z{k}", 12)), -F.col("id"))).alias(f"t{k}") for k in range(1, dims + 1)]
    signs = z.agg(*tops).first()
    return z.select("id", F.array(*(F.col(f"z{k}") * (-1.0 if (signs[f"t{k}"] or 0) < 0 else 1.0) for k in range(1, dims + 1))).alias("z"))
