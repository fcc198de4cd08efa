"""Graph stores: Parquet tables with a JSON sidecar."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.build import Graph

VERSION = 1


def fingerprint(df: DataFrame, column: str = "v") -> dict[str, Any]:
    """Rows, width and an order-independent hash of a vector table."""
    row = df.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("d"), F.sum(F.xxhash64("id", column).cast("decimal(38,0)")).alias("h")).first()
    return {"n": row["n"], "d": row["d"], "hash": str(row["h"] or 0)}


def needs_rebuild(meta: dict, current: dict, config: dict, keys: tuple[str, ...] = ("metric", "k", "epsilon", "delta", "n_landmarks", "seed")) -> bool:
    """True if the data or any key of the configuration differs; a missing value
    on either side is no difference."""
    if meta.get("fingerprint") != current:
        return True
    for key in keys:
        a, b = meta.get("config", {}).get(key), config.get(key)
        if a is None or b is None:
            continue
        same = math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) or isinstance(b, float) else a == b
        if not same:
            return True
    return False


class GraphStore:
    """A folder with ``edges`` (by level), other named tables and ``meta``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, edges: DataFrame, meta: dict[str, Any], **tables: DataFrame) -> None:
        """``edges`` has level, src, dst, w."""
        edges.repartition("level").write.mode("overwrite").partitionBy("level").parquet(f"{self.path}/edges")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        row = json.dumps({"version": VERSION, "tables": sorted(tables), **meta}, sort_keys=True)
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")

    def meta(self) -> dict[str, Any] | None:
        """None where nothing was saved completely (meta is written last)."""
        try:
            return json.loads(self.spark.read.text(f"{self.path}/meta").first()[0])
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def edges(self, level: int) -> DataFrame:
        """One level; the others aren't read."""
        return self.spark.read.parquet(f"{self.path}/edges").where(F.col("level") == level).drop("level")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


class KnnStore:
    """A neighbour table that is filled slice by slice and only read once complete.

    Slices may be written by separate runs, and again; a slice's folder is replaced
    whole. The mark of completeness is written after an audit, and any later write
    takes it away."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _text(self, name: str) -> dict[str, Any] | None:
        try:
            return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0])
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _put(self, name: str, value: dict[str, Any]) -> None:
        self.spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}")

    def create(self, n: int, k: int, slices: int) -> None:
        """For ``n`` rows with ``k`` neighbours each, of which there may be fewer only
        where there are fewer rows."""
        self._put("complete", {"complete": False})
        self._put("meta", {"version": VERSION, "n": n, "k": min(k, max(n - 1, 0)), "slices": slices})

    def write(self, number: int, knn: DataFrame) -> None:
        """Put the slice ``number`` of (i, rk, j, d)."""
        meta = self._text("meta")
        if meta is None or not 0 <= number < meta["slices"]:
            raise ValueError("no store was created here, or it has no such slice")
        self._put("complete", {"complete": False})
        knn.select("i", "rk", "j", "d").write.mode("overwrite").parquet(f"{self.path}/knn/slice={number}")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("i long, rk int, j long, d double, slice int").parquet(f"{self.path}/knn")

    def audit(self) -> dict[str, int]:
        """Rows that are missing, given twice, or no neighbours at all."""
        meta = self._text("meta")
        try:
            per = self._rows().where(F.col("rk") <= meta["k"]).groupBy("i", "rk").agg(F.count("*").alias("c"), F.count_if((F.col("i") == F.col("j")) | ~(F.col("d") >= 0)).alias("bad"))
            got = per.agg(F.count("*").alias("n"), F.sum(F.col("c") - 1).alias("twice"), F.sum("bad").alias("bad")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {"missing": meta["n"] * meta["k"], "twice": 0, "bad": 0}
        return {"missing": meta["n"] * meta["k"] - got.n, "twice": got.twice or 0, "bad": got.bad or 0}

    def mark_complete(self) -> None:
        """Mark the store complete; an error where the audit finds anything."""
        found = self.audit()
        if any(found.values()):
            raise ValueError(f"the neighbour table is not complete: {found}")
        self._put("complete", {"complete": True})

    def complete(self) -> bool:
        mark = self._text("complete")
        return bool(mark and mark["complete"])

    def load(self) -> DataFrame:
        """(i, rk, j, d); an error unless the store is marked complete."""
        if not self.complete():
            raise ValueError("the neighbour table is not complete")
        return self._rows().drop("slice")


def save_graph(store: GraphStore, graph: Graph, meta: dict[str, Any]) -> None:
    """The state of a whole graph: its edges as level 0 and its tables."""
    store.save(graph.edges.withColumn("level", F.lit(0)), meta, members=graph.members, reps=graph.reps, knn=graph.knn)


def load_graph(store: GraphStore) -> Graph:
    """The graph that ``save_graph`` stored; an error where it was not stored whole."""
    meta = store.meta()
    if meta is None or not {"members", "reps", "knn"} <= set(meta["tables"]):
        raise ValueError("no whole graph is stored here")
    return Graph(store.table("members"), store.table("reps"), store.table("knn"), store.edges(0))


def load_array(spark: SparkSession, path: str, rows: int = 65_536) -> DataFrame:
    """(id, v) of a ``.npy`` or ``.npz`` file (key X, else the first) that all tasks can
    open. Tasks map ``.npy`` files into memory and read their own rows, about ``rows``
    each; a ``.npz`` is opened by each task as a whole. The driver reads the shape only."""
    if not path.endswith((".npy", ".npz")):
        raise ValueError("a .npy or .npz file is expected")

    def opened() -> np.ndarray:
        data = np.load(path, mmap_mode="r")
        if path.endswith(".npz"):
            data = data["X" if "X" in data.files else data.files[0]]
        return data

    n = len(opened())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for batch in batches:
            if len(ids := batch.column(0)):
                data = opened() if data is None else data
                own = np.ascontiguousarray(data[ids.to_numpy()], np.float32).reshape(len(ids), -1)
                values = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel(), pa.float64()), own.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids, values], names=["id", "v"])

    return spark.range(0, n, 1, max(1, -(-n // rows))).mapInArrow(read, "id long, v array<double>")
