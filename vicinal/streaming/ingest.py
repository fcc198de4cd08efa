"""Incremental nets: batches are absorbed by representatives or spawn new ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.operators.knn import assign, nearest
from vicinal.operators.lineage import cut
from vicinal.operators.net import greedy_net



class NetStream:
    """State of a net (members: id, rep; reps: id, v, l) as one Parquet folder a
    batch below ``path``. A batch that is run again overwrites its own folder, so
    a restart from the checkpoint changes nothing."""

    def __init__(self, spark: SparkSession, path: str, landmarks: DataFrame, delta: float):
        self.spark, self.path, self.landmarks, self.delta = spark, path.rstrip("/"), landmarks, delta

    def table(self, name: str, before: int | None = None) -> DataFrame | None:
        try:
            out = self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return out if before is None else out.where(F.col("batch") < before)

    def ingest(self, rows: DataFrame, batch: int) -> None:
        """Rows within ``delta`` of a representative of the batches before join
        the nearest one; the others form a greedy net in their landmark's bucket."""
        reps, delta = self.table("reps", batch), self.delta
        members, left = None, rows
        if reps is not None:
            near = nearest(rows, reps.select("id", "v"), 1, skip_equal_id=False).where(F.col("d") <= delta)
            members = near.select(F.col("i").alias("id"), F.col("j").alias("rep")).checkpoint()
            left = rows.join(members, "id", "left_anti")

        def net(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["h", "id"])
            ids = frame["id"].to_numpy()
            return pd.DataFrame({"id": ids, "rep": ids[greedy_net(np.array(frame["v"].tolist()), delta)], "l": frame["l"].to_numpy()})

        placed = assign(left, self.landmarks, 1).select("id", "l").join(left, "id").select("id", "l", "v", F.xxhash64("id").alias("h"))
        spawned = placed.groupBy("l").applyInPandas(net, "id long, rep long, l long").checkpoint()
        new = spawned.where("id = rep").select("id", "l").join(left, "id").select("id", "v", "l")
        own = spawned.select("id", "rep")
        (own if members is None else own.unionByName(members)).write.mode("overwrite").parquet(f"{self.path}/members/batch={batch}")
        new.write.mode("overwrite").parquet(f"{self.path}/reps/batch={batch}")

    def run(self, stream: DataFrame, checkpoint: str):
        """Ingest all that a stream of (id, v) has now; returns the query."""
        start = stream.writeStream.foreachBatch(lambda df, n: self.ingest(df, n)).option("checkpointLocation", checkpoint)
        return start.trigger(availableNow=True).start()


def refresh_dirty(knn: DataFrame, dirty: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The neighbour table of ``rows`` after those of ``dirty`` ids moved: they, and
    the rows that had one as a neighbour, are searched anew; all others can only gain
    dirty ones, and keep the first k of what they had and of their nearest of these."""
    moved = dirty.select("id").distinct()
    hit = cut(moved.union(knn.join(moved.select(F.col("id").alias("j")), "j", "left_semi").select(F.col("i").alias("id"))).distinct())
    fresh = nearest(rows.join(hit, "id", "left_semi"), rows, k)
    others = rows.join(hit, "id", "left_anti")
    gained = nearest(others, rows.join(moved, "id", "left_semi"), k).select("i", "j", "d")
    both = knn.join(hit.withColumnRenamed("id", "i"), "i", "left_anti").select("i", "j", "d").unionByName(gained)
    rk = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return fresh.unionByName(both.withColumn("rk", rk).where(F.col("rk") <= k).select("i", "rk", "j", "d"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and value sums of an event stream by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
