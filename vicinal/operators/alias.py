"""Two-level alias tables: weighted draws by two lookups, from stored tables.

Rows are dealt to shards by a hash of their keys; a task builds Vose's table of one
shard at a time (``ROWS`` rows or so) and stores each slot with its row and its
alias's row. One more table, over the shards' masses (at most ``MOST_SHARDS``),
stays with the caller. A draw picks a shard, then a slot and a coin, all from hashes
of its number, and is a lookup in each; no running sum over the weights is needed,
and the law of the draws is weight over total weight, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.lineage import fresh_dir

#: Rows of a shard, about, and shards at most; the least weight of a row.
ROWS, MOST_SHARDS, LEAST = 1 << 16, 100_000, 1e-12


def vose(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Acceptance probability and alias of each slot."""
    n = len(weights)
    share = weights * (n / weights.sum())
    prob, alias = np.ones(n), np.arange(n)
    small, large = (list(np.flatnonzero(x)) for x in (share < 1, share >= 1))
    while small and large:
        s, g = small.pop(), large[-1]
        prob[s], alias[s] = share[s], g
        share[g] -= 1 - share[s]
        if share[g] < 1:
            small.append(large.pop())
    return prob, alias


def uniform(number: np.ndarray, stream: int, seed: int) -> np.ndarray:
    """Hashed uniforms in [0, 1) of draw numbers; streams are independent."""
    x = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + stream) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)) * 2.0**-53


@dataclass(frozen=True)
class Tables:
    """``slots`` (shard, slot, prob, own columns, alias columns) and the shards' own
    table: ``size``, ``mass``, ``prob`` and ``alias`` by shard."""

    slots: DataFrame
    keys: list[str]
    size: np.ndarray
    mass: np.ndarray
    prob: np.ndarray
    alias: np.ndarray

    def law(self) -> DataFrame:
        """Each row's keys and ``p``, the probability that the tables give it."""
        each = F.broadcast(self.slots.sparkSession.createDataFrame([(k, float(m / self.mass.sum() / n)) for k, (m, n) in enumerate(zip(self.mass, self.size)) if n], "shard long, per_slot double"))
        rows = self.slots.join(each, "shard")
        own = rows.select(*self.keys, (F.col("per_slot") * F.col("prob")).alias("p"))
        other = rows.select(*(F.col(f"alias_{c}").alias(c) for c in self.keys), (F.col("per_slot") * (1 - F.col("prob"))).alias("p"))
        return own.unionByName(other).groupBy(*self.keys).agg(F.sum("p").alias("p"))

    def draw(self, n: int, seed: int = 0) -> DataFrame:
        """(draw, keys): ``n`` independent draws with replacement."""
        size, prob, alias = self.size, self.prob, self.alias

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number = batch.column(0).to_numpy()
                at = (uniform(number, 0, seed) * len(prob)).astype(np.int64)
                shard = np.where(uniform(number, 1, seed) < prob[at], at, alias[at])
                slot = (uniform(number, 2, seed) * size[shard]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"draw": number, "shard": shard, "slot": slot, "coin": uniform(number, 3, seed)})

        drawn = self.slots.sparkSession.range(n).mapInArrow(pick, "draw long, shard long, slot long, coin double")
        found = drawn.join(self.slots, ["shard", "slot"])
        own = F.col("coin") < F.col("prob")
        return found.select("draw", *(F.when(own, F.col(c)).otherwise(F.col(f"alias_{c}")).alias(c) for c in self.keys))


def build(rows: DataFrame, keys: list[str], weight: str, uri: str | None = None, shard_rows: int = ROWS) -> Tables:
    """Build and store the tables of ``rows`` below ``uri`` (a folder that all share;
    a fresh one by default)."""
    spark = rows.sparkSession
    uri = uri or fresh_dir(spark, "alias")
    n = rows.count()
    if not n:
        raise ValueError("no rows to draw from")
    shards = min(MOST_SHARDS, -(-n // shard_rows))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["shard long", "slot long", "prob double", "weight double", *(f"`{c}` {kinds[c]}" for c in keys), *(f"`alias_{c}` {kinds[c]}" for c in keys)])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            s = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(s)), np.flatnonzero(s[1:] != s[:-1]) + 1):
                if held and len(part) and held[0].column(0)[0].as_py() != s[part[0]]:
                    yield table(held)
                    held = []
                if len(part):
                    held.append(batch.slice(part[0], len(part)))
        if held:
            yield table(held)

    def table(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        w = t.column(1).to_numpy()
        prob, alias = vose(w)
        other = t.select(range(2, t.num_columns)).take(pa.array(alias))
        columns = [t.column(0), pa.array(np.arange(len(w))), pa.array(prob), t.column(1), *t.columns[2:], *other.columns]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "slot", "prob", "weight", *keys, *(f"alias_{c}" for c in keys)])

    dealt = rows.select(F.pmod(F.xxhash64(*keys), F.lit(shards)).alias("shard"), F.greatest(F.col(weight).cast("double"), F.lit(LEAST)).alias("weight"), *keys)
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt.repartition(parts, "shard").sortWithinPartitions("shard", *keys).mapInArrow(tables, schema).write.parquet(f"{uri}/slots")
    slots = spark.read.parquet(f"{uri}/slots")
    slots.groupBy("shard").agg(F.sum("weight").alias("mass"), F.count("*").alias("size")).write.parquet(f"{uri}/shards")
    return load(spark, uri, keys, shards)


def load(spark: SparkSession, uri: str, keys: list[str], shards: int | None = None) -> Tables:
    """The tables that ``build`` stored."""
    got = spark.read.parquet(f"{uri}/shards").collect()  # a row a shard
    shards = max(shards or 0, 1 + max(r.shard for r in got))
    size, mass = np.zeros(shards, np.int64), np.zeros(shards)
    for r in got:
        size[r.shard], mass[r.shard] = r.size, r.mass
    return Tables(spark.read.parquet(f"{uri}/slots"), keys, size, mass, *vose(mass))
