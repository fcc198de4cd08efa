"""Null models of vector tables (id, v): what a map makes of rows without structure.

Both keep the ids and are the same for any number of partitions. Rows without a vector are left
out; an empty table has an empty null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.batch import _mixed, keys, permuted
from vicinal.operators.lineage import cut
from vicinal.operators.order import before
from vicinal.operators.sums import summed

#: Values of a block of rows that a task puts together, at most.
VALUES = 1 << 22


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Every coordinate permuted over all rows on its own: the coordinates' laws stay,
    what joins them goes.

    A keyed Feistel network says where the value of each row (by its place in the
    order of ids) goes, so no coordinate is sorted: all values are shuffled once,
    packed by the block of rows that they go to: as many blocks as shuffle partitions,
    or more, as none holds over ``VALUES`` values."""
    known = rows.where(F.col("v").isNotNull())
    placed = cut(before(known.select("id", "v"), ["id"]).select("id", "v", F.col("before").alias("at")))
    size = placed.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size.n:
        return rows.select("id", "v").limit(0)
    n, d = size.n, size.d
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, key = max(1, min(VALUES // d, -(-n // parts))), keys(d, seed)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
            to = np.vstack([at, permuted(at, n, key)])  # the id stays where it is
            value = np.vstack([ids.astype("<i8").view("<f8"), x.T])
            of = np.repeat(np.arange(d + 1), len(ids))
            to, value = to.ravel(), value.ravel()
            order = np.argsort(to // block, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(to[order] // block) > 0, True])
            runs = [order[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
            pack = lambda a, kind: [a[r].astype(kind).tobytes() for r in runs]
            yield pa.RecordBatch.from_pydict({"block": [int(to[r[0]] // block) for r in runs], "at": pack(to % block, "<i4"), "of": pack(of, "<i4"), "x": pack(value, "<f8")})

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m = None, None

        def done() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(m) if now is not None else 0, 4096):
                part = m[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy().view("<i8")), _lists(part[:, 1:])], names=["id", "v"])

        for batch in batches:
            for b, at, of, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    yield from done()
                    now, m = b, np.zeros((min(block, n - b * block), d + 1))
                m[np.frombuffer(at, "<i4"), np.frombuffer(of, "<i4")] = np.frombuffer(x, "<f8")
        yield from done()

    sent = placed.mapInArrow(send, "block long, at binary, of binary, x binary")
    return sent.repartition("block").sortWithinPartitions("block").mapInArrow(receive, "id long, v array<double>")


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows have a vector, their mean and covariance (over n - 1), in two
    passes; of one row the covariance is zero."""
    known = rows.where(F.col("v").isNotNull()).select("v")
    first = summed(known, lambda v: {0: np.r_[len(v), v.sum(0)]}).get(0)
    if first is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, mean = int(first[0]), first[1:] / first[0]
    products = summed(known, lambda v: {0: ((v - mean).T @ (v - mean)).ravel()})[0]
    return n, mean, products.reshape(len(mean), -1) / max(n - 1, 1)


def normals(ids: np.ndarray, d: int, seed: int) -> np.ndarray:
    """Standard normal numbers (a row for each id) that only the id and the seed decide."""
    pairs = (d + 1) // 2
    key = keys(2 * pairs, seed)
    h = _mixed(_mixed(ids.astype("<i8").view(np.uint64)[:, None] ^ key[None]) + key[None])
    u = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    size, angle = np.sqrt(-2 * np.log(u[:, :pairs])), 2 * np.pi * u[:, pairs:]
    return np.hstack([size * np.cos(angle), size * np.sin(angle)])[:, :d]


def gaussian(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Normal rows of the table's mean and covariance: second moments stay, all else
    goes. Rows of one id are alike."""
    n, mean, cov = moments(rows)
    if not n:
        return rows.select("id", "v").limit(0)
    w, e = np.linalg.eigh(cov)
    root = (e * np.sqrt(np.maximum(w, 0))).T

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = mean + normals(batch.column(0).to_numpy(), len(mean), seed) @ root
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x)], names=["id", "v"])

    return rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id")).mapInArrow(draw, "id long, v array<double>")
